"""Streams with restarts, exports in two phases, exact selection, longest prefixes."""

import datetime
import random

from pyspark.sql import functions as F

from rollsift.functions import scalars as sc
from rollsift.operators import batches as bt
from rollsift.operators import filters as fl
from rollsift.operators import ordering as od
from rollsift.operators import selection as sel
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr
from rollsift.streaming import groups as st

SF = "/root/testdata/sf0.001"
AWKWARD = "group_id string, arrival long, n int, m long, v double, d decimal(20,5), t timestamp, xs array<double>, s struct<a:long,b:string>, b binary"


def awkward(n=90, seed=3):
    """Rows whose values don't survive a detour by text or by even doubles."""
    r = random.Random(seed)
    when = datetime.datetime(2024, 2, 29, 1, 2, 3, 4567)
    return [
        (f"g{i % 7}", i, None if r.random() < 0.3 else i, (1 << 53) + 1 + i, r.choice([1e-12, 0.12345678901234566, None]), None, when, [1e-300, None], (None, "é"), bytes([0, i]))
        for i in range(n)
    ]


def test_streams_give_what_they_got(spark, tmp_path):
    """Three micro-batches, with a restart from the checkpoint between them, equal the batch form to the bit."""
    rows = awkward()
    df = spark.createDataFrame(rows, AWKWARD)
    source = f"{tmp_path}/in"
    for k in range(3):
        df.where(F.col("arrival").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        st.started(st.stream_groups(stream, 5, order="arrival"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        st.started(st.stream_previous(stream, ["group_id"], "arrival", ["n", "v"]), f"{tmp_path}/prev", f"{tmp_path}/ck2").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for g in range(7):
        mine = [tuple(r) for r in df.where(F.col("group_id") == f"g{g}").orderBy("arrival").collect()]
        want += mine[: len(mine) // 5 * 5]
    assert got == sorted(want)
    first = {r["arrival"] for r in st.finished_groups(df, 5).collect()}
    assert first <= {r[1] for r in got}
    last = {}
    expected = {}
    for row in rows:
        expected[row[1]] = last.get(row[0], (None, None))
        last[row[0]] = (row[2], row[4])
    assert {r["arrival"]: (r["previous_n"], r["previous_v"]) for r in spark.read.parquet(f"{tmp_path}/prev").collect()} == expected


def test_a_streams_groups_are_in_no_one_task(ranges, tmp_path):
    """Two evaluations with all rows of a micro-batch: their rows come from many tasks, and none passes through Python."""
    df = ranges.range(40_000).select("id", (F.col("id") % 2).alias("env_name"), F.lit(1).alias("eval_step"), F.hex(F.col("id") * 7919).alias("text"))
    df.repartition(8).write.parquet(f"{tmp_path}/in")
    stream = ranges.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    st.started(st.stream_evaluations(stream, 64, 4, order="id"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = ranges.read.parquet(f"{tmp_path}/out").select("*", F.input_file_name().alias("file"))
    assert sorted(r["id"] for r in got.collect()) == [*range(20_000 // 256 * 256 * 2)]
    assert got.groupBy("env_name", "file").count().agg(F.max("count")).first()[0] < 10_000


def test_previous_values_need_no_call_a_key(ranges, tmp_path):
    """Nothing that a key holds is asked for by a call of its own: the stream has no Python state, and null keys, orders and
    values are as in a table."""
    rows = [(k, o, None if v % 5 == 0 else v) for v, (k, o) in enumerate((k, o) for k in (None, 1, 2) for o in (None, *range(12)))]
    df = ranges.createDataFrame(rows, "k int, o int, v int")
    df.write.parquet(f"{tmp_path}/in")
    made = st.stream_previous(ranges.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], "o", ["v"])
    st.started(made, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    last, want = {}, []
    for k, o, v in rows:
        want.append((k, o, v, last.get(k)))
        last[k] = v
    got = [tuple(r) for r in ranges.read.parquet(f"{tmp_path}/out").select("k", "o", "v", "previous_v").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert "transformWithState" not in made.stream._jdf.queryExecution().toString()


def in_halves(spark, tmp_path, operator):
    """What a stream gives whose groups of four rows come half in one micro-batch, half in the next; no key is state of its own."""
    df = spark.range(8_000).select("id", F.expr("id div 4").alias("group_id"), (F.col("id") * 7).alias("v"))
    for half in range(2):
        df.where(F.col("id") % 2 == half).repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
        made = operator(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
        q = st.started(made, f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
        assert q.recentProgress and not any(p["stateOperators"] for p in q.recentProgress)
    return spark.read.parquet(f"{tmp_path}/out")


def test_previous_values_of_many_keys_are_no_state(ranges, tmp_path):
    got = in_halves(ranges, tmp_path, lambda stream: st.stream_previous(stream, ["group_id"], "id", ["v"]))
    before = {0: None, 2: 0, 1: 2, 3: 1}  # late rows follow those given
    want = [(i, None if i % 4 == 0 else 7 * (i - i % 4 + before[i % 4])) for i in range(8_000)]
    assert sorted((r["id"], r["previous_v"]) for r in got.collect()) == want


def test_many_groups_in_halves_are_no_state(ranges, tmp_path):
    got = in_halves(ranges, tmp_path, lambda stream: st.stream_groups(stream, 4, order="id"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i // 4, 7 * i) for i in range(8_000)]
    assert ranges.read.parquet(f"{tmp_path}/ck/held/0").count() == 4_000 and ranges.read.parquet(f"{tmp_path}/ck/held/1").count() == 0


def test_a_batch_that_is_done_again_replaces_itself(spark, tmp_path):
    df = spark.range(10).select(F.lit("g").alias("group_id"), F.col("id").alias("arrival"))
    df.write.parquet(f"{tmp_path}/in")
    made = st.stream_groups(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 3, order="arrival")
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    ids = lambda path: sorted(r["arrival"] for r in spark.read.parquet(path).collect())
    for _ in range(2):  # the second time as if the checkpoint hadn't been reached
        st.started(made, out, ck).awaitTermination()
        assert ids(out) == [*range(9)] and ids(f"{ck}/held/0") == [9]
        (tmp_path / "ck" / "commits" / "0").unlink()
        (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)


def test_gauges_count_known_rows(spark, tmp_path):
    for k in range(3):
        spark.range(10 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = st.Gauges(spark, f"{tmp_path}/gauges")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    st.started(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "known").awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    spark.streams.removeListener(listener)
    rows = spark.read.parquet(f"{tmp_path}/gauges").where("query = 'known' and input_rows > 0").orderBy("batch").collect()
    assert sorted(r["input_rows"] for r in rows) == [10, 20, 30] and [r["batch"] for r in rows] == [0, 1, 2]


def _export(spark, steps):
    rows = [(s, s, r, m, f"e{m}", [s, r, m], [True, False, m % 2 == 0]) for s in steps for r in range(3) for m in range(4)]
    return spark.createDataFrame(rows, "step int, export_step int, rank int, micro_step int, env_name string, token_ids array<bigint>, loss_mask array<boolean>")


def _read(spark, path):
    good, bad = rd.token_export(spark, path)
    assert bad.count() == 0
    return sorted((r["step"], r["rank"], r["micro_step"], r["env_name"], tuple(r["token_ids"]), tuple(r["loss_mask"])) for r in good.collect())


def test_an_export_is_published_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    one = _export(spark, [1, 2])
    attempt = wr.staged_export(one, path)
    assert rd.stable_folders(spark, path) == [] and _read(spark, path) == []
    # an executor that is lost while a task writes leaves nothing that counts: the attempt is Spark's own commit
    fails = F.udf(lambda x: 1 // 0, "int")
    try:
        wr.staged_export(one.withColumn("micro_step", fails("micro_step")), path)
        raise AssertionError("the task must fail")
    except Exception as e:
        assert "ZeroDivision" in str(e)
    assert wr.commit_export(spark, attempt, path) == [1, 2]
    want = sorted((r["step"], r["rank"], r["micro_step"], r["env_name"], tuple(r["token_ids"]), tuple(r["loss_mask"])) for r in one.collect())
    assert _read(spark, path) == want
    assert sorted(p.name for p in (tmp_path / "out" / "step_1").iterdir() if not p.name.startswith(".")) == ["STABLE", "rank_0.jsonl", "rank_1.jsonl", "rank_2.jsonl"]
    assert wr.commit_export(spark, attempt, path) == [] and wr.token_export(one, path) == []
    assert wr.token_export(_export(spark, [2, 3]), path) == [3]
    assert len(_read(spark, path)) == 36


def test_a_broken_commit_can_be_done_again(spark, tmp_path):
    """Files of a step without marker are of no attempt that counts: the next one replaces them."""
    path = f"file://{tmp_path}/out"
    folder = tmp_path / "out" / "step_1"
    folder.mkdir(parents=True)
    (folder / "rank_0.jsonl").write_text('{"loss_mask": [true]}\n' * 7)
    assert _read(spark, path) == []
    assert wr.token_export(_export(spark, [1]), path) == [1]
    assert len(_read(spark, path)) == 12


def test_markers_count_for_their_own_run(spark, tmp_path):
    for run in ("a", "b"):
        wr.token_export(_export(spark, [3]), f"file://{tmp_path}/{run}")
    (tmp_path / "b" / "step_3" / "STABLE").unlink()
    assert [f.split("/")[-2:] for f in rd.stable_folders(spark, f"file://{tmp_path}")] == [["a", "step_3"]]
    assert len(_read(spark, f"file://{tmp_path}")) == 12


def test_a_step_of_rollouts_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "step int, x string")
    wr.rollouts(df, f"{tmp_path}/r")
    wr.rollouts(df.where("step = 1").withColumn("x", F.upper("x")), f"{tmp_path}/r")
    got = rd.tabular(spark, f"{tmp_path}/r", "json", "x string, step int").collect()
    assert sorted((r["step"], r["x"]) for r in got) == [(1, "A"), (1, "B"), (2, "c")]


def test_smallest_by_histograms(spark):
    r = random.Random(5)
    values = [r.choice([r.randrange(1 << 60), 7, 1 << 59]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(6)
    for k in (0, 1, 5, 900, 1100, 2999, 3000):
        got = sorted(x["v"] for x in sel.smallest(df, F.col("v"), k, 60, "i").collect())
        assert got == sorted(values)[:k]


def test_samples_need_no_sort(spark):
    df = spark.range(10_000_000)
    got = fl.exact_sample(df, 0.3, "id")
    assert "TakeOrdered" not in got._jdf.queryExecution().toString() and "Sort" not in got._jdf.queryExecution().toString()
    assert got.count() == 3_000_000
    same = spark.createDataFrame([(5, i) for i in range(40)], "k int, i int")
    assert fl.exact_sample(same, 0.25, "k").count() == 10


def test_hash_numbers_are_plain_md5(spark):
    import hashlib

    got = spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string").select(sc.hash_number(F.col("a"), F.col("b"), seed=4)).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in ("4:1:x", "4::y")]


def test_longest_prefixes_of_many_lengths(spark):
    """Thousands of lengths a key, one key with most rows, an empty prefix, repeated queries and prefixes."""
    r = random.Random(8)
    text = [r.randrange(3) for _ in range(3000)]
    queries = [("hot", i, text[: r.randrange(3000)] + [9] * r.randrange(3)) for i in range(40)] + [("b", 100, [1, 2]), ("b", 100, [1, 2]), ("c", 101, [5]), (None, 102, [1]), ("d", 103, [1])]
    prefixes = [("hot", n, text[:n]) for n in range(1, 3000, 2)] + [("hot", 5000, text[:9]), ("b", 7, []), ("b", 6, [2]), ("d", 1, [1, 1]), (None, 3, [1])]
    q = spark.createDataFrame(queries, "key string, qid long, ids array<long>")
    p = spark.createDataFrame(prefixes, "key string, prefix_id long, prefix array<long>")
    want = []
    for key, i, ids in queries:
        fits = [(len(x), -at) for k, at, x in prefixes if k is not None and k == key and ids[: len(x)] == x]
        if fits:
            want.append((i, -max(fits)[1]))
    assert sorted((x["qid"], x["prefix_id"]) for x in od.longest_prefix(q, p, "key").collect()) == sorted(want)


def test_bucketing_and_packing_resume(spark, tmp_path):
    """Stopped and resumed four times, the stream gives what one run over the table gives."""
    r = random.Random(11)
    rows = [(r.choice(["a", "a", "a", None]), i, i + 1000, r.choice([5, 130, 256, 300, 700, 1024, 3000])) for i in range(600)]
    df = spark.createDataFrame(rows, "run string, arrival long, sample_id long, length int")
    for k in range(4):
        df.where(F.col("arrival").between(150 * k, 150 * k + 149)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        st.started(st.stream_stacked(stream, 2048, ["run"], "arrival", timeout=3), f"{tmp_path}/stacked", f"{tmp_path}/ck1").awaitTermination()
        st.started(st.stream_cat_packs(stream, 2048, ["run"], "arrival"), f"{tmp_path}/packs", f"{tmp_path}/ck2").awaitTermination()
    plain = lambda d: sorted((tuple(x) for x in d.collect()), key=repr)
    stacked = bt.stacked(df, 2048, ["run"], "arrival", timeout=3)
    assert plain(spark.read.parquet(f"{tmp_path}/stacked").select(*stacked.columns)) == plain(stacked) and stacked.where("sample_id is null").count() > 0
    packs = bt.cat_packs(df, 2048, ["run"], "arrival")
    assert plain(spark.read.parquet(f"{tmp_path}/packs").select(*packs.columns)) == plain(packs)


def plain_steps(queues, steps, budget):
    """Queues (sample, tokens, step) a run, in turns from step to step."""
    out, position, names = [], 0, sorted(queues)
    ready = lambda q, run: [x for k, x in enumerate(q) if all(y[2] <= steps[run] for y in q[: k + 1])]
    while sum(x[1] for run in names for x in ready(queues[run], run)) >= budget:
        used, taken, full, idle = 0, [], False, 0
        while used < budget and not full and idle < len(names):
            run = names[position]
            if not ready(queues[run], run):
                position, idle = (position + 1) % len(names), idle + 1
                continue
            position, idle = (position + 1) % len(names), 0
            while queues[run] and queues[run][0][2] <= steps[run]:
                sample, tokens, _ = queues[run][0]
                if used + tokens > budget:
                    if not used:
                        queues[run].pop(0)
                        continue
                    full = True
                    break
                queues[run].pop(0)
                taken.append((run, sample))
                used += tokens
        for run in {x[0] for x in taken}:
            if not queues[run] or queues[run][0][2] > steps[run]:
                steps[run] += 1
        out.append(sorted(taken))
        if not taken:
            break
    return out


def test_steps_carry_their_queues(spark):
    r = random.Random(2)
    for budget in (40, 90):
        queues, ids = {}, iter(range(10_000))
        for run in "abc":
            sizes = [r.choice([3, 9, 20, 60]) for _ in range(70)]
            queues[run] = [(next(ids), t, k // 12) for k, t in enumerate(sizes)]
        rows = [(run, n, s, t, k) for run in queues for n, (s, t, k) in enumerate(queues[run])]
        buffer = spark.createDataFrame(rows, "run string, arrival long, sample long, tokens long, step long")
        runs = spark.createDataFrame([(run, n, 0) for n, run in enumerate("abc")], "run string, place long, current_step long")
        want, position = plain_steps(queues, dict.fromkeys("abc", 0), budget)[:6], 0
        for k, chosen in enumerate(want):
            got, buffer, runs, position = bt.next_step(buffer, runs, budget, position)
            assert sorted((x["run"], x["sample"]) for x in got.collect()) == chosen, (budget, k)
        assert len(want) == 6


def test_packed_steps_of_the_whole_table(spark):
    from rollsift.plans import queries
    from rollsift.plans.groups import _lengths

    rows = sorted(_lengths(spark, SF).select("run_id", "sample_id", "length").collect(), key=lambda r: r["sample_id"])
    queues = {run: [(r["sample_id"], r["length"], r["sample_id"] // 8000) for r in rows if r["run_id"] == run] for run in ("run0", "run1")}
    want = plain_steps(queues, dict.fromkeys(queues, 0), sum(r["length"] for r in rows) // 6 + 1)
    got = queries.QUERIES["p15_packed_steps"](spark, SF).collect()
    assert [sorted((r["run"], r["sample"]) for r in got if r["train_step"] == k) for k in range(len(want))] == want and len(want) == 5


def test_steps_come_in_run_order_once(spark, tmp_path):
    """Folders that arrive out of order, over restarts, an unfinished one and a run that comes late."""
    from rollsift.sources.transport import transported

    def put(run, step, stable=True):
        folder = tmp_path / "in" / f"run_{run}" / f"step_{step}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "rank_0.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(step + 1)))
        (folder / "rank_1.jsonl").write_text('{"n": 99}')
        if stable:
            (folder / "STABLE").touch()

    def drain():
        stream = transported(spark, f"file://{tmp_path}/in", "n int")
        st.started(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return sorted((r["run_id"], r["step"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    of = lambda run, steps: [(f"run_{run}", s, n) for s in steps for n in [*range(s + 1), 99]]
    put("a", 0), put("a", 2), put("b", 1)
    assert drain() == of("a", [0])
    put("a", 1), put("b", 0, stable=False)
    assert drain() == of("a", [0, 1, 2])
    put("b", 0), put("c", 0), put("a", 4)
    assert drain() == sorted([*of("a", [0, 1, 2]), *of("b", [0, 1]), *of("c", [0])])
    assert drain() == sorted([*of("a", [0, 1, 2]), *of("b", [0, 1]), *of("c", [0])])
