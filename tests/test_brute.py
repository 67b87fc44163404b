"""Queries that SQL can't say, whole, against plain loops over the same rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollsift.functions import scalars as sc
from rollsift.operators import batches as bt
from rollsift.operators import filters as fl
from rollsift.operators import sampling as sp
from rollsift.operators import trajectories as tj
from rollsift.plans import groups, queries
from rollsift.sources import readers as rd
from tests.test_golden import plain_fit

SF = "/root/testdata/sf0.01"


def by_key(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_bins_and_workers(spark):
    """Bins of the whole table: first fit, then the heaviest in halves until the workers share evenly."""
    samples = by_key(groups._lengths(spark, SF).collect(), "run_id", "step")
    got = by_key(queries.QUERIES["p4_assign"](spark, SF).collect(), "run_id", "step")
    assert set(got) == set(samples)
    for key, rows in samples.items():
        rows.sort(key=lambda r: r["arrival"])
        lengths = [min(r["length"], 24) for r in rows]
        bins = plain_fit([(n, r["mode"], r["multimodal"]) for n, r in zip(lengths, rows, strict=True)], 24)
        while len(bins) % 4:
            heavy = max((sum(lengths[i] for i in b), n) for n, b in enumerate(bins) if len(b) > 1)[1]
            sides, loads = ([], []), [0, 0]
            for i in sorted(bins[heavy], key=lambda i: -lengths[i]):
                k = int(loads[1] < loads[0])
                sides[k].append(i)
                loads[k] += lengths[i]
            bins[heavy : heavy + 1] = [sides[0]]
            bins.append(sides[1])
        want = {frozenset(rows[i]["sample_id"] for i in b) for b in bins}
        real = by_key([r for r in got[key] if not r["is_dummy"]], "bin")
        assert {frozenset(r["sample_id"] for r in b) for b in real.values()} == want
        every = by_key(got[key], "bin")
        turns = defaultdict(set)
        for b in every.values():
            assert len({(r["worker"], r["turn"]) for r in b}) == 1 and sorted(r["position"] for r in b) == list(range(len(b)))
            turns[b[0]["turn"]].add(b[0]["worker"])
        assert all(w == {0, 1, 2, 3} for w in turns.values())


def test_materialised_bins(spark):
    samples = {r["sample_id"]: r for r in bt.prepared(groups._samples(spark, SF), 24).collect()}
    plan = by_key(queries.QUERIES["p4_assign"](spark, SF).collect(), "run_id", "step", "bin")
    packed = bt.materialised(bt.prepared(groups._samples(spark, SF), 24), queries.QUERIES["p4_assign"](spark, SF), multiple=8)
    rows = packed.collect()
    assert len(rows) == len(plan)
    for r in rows:
        parts = [samples[x["sample_id"]] for x in sorted(plan[r["run_id"], r["step"], r["bin"]], key=lambda x: x["position"])]
        ids = [i for p in parts for i in p["input_ids"]]
        pad = -len(ids) % 8
        assert r["input_ids"] == ids + [1] * pad and r["position_ids"] == [i for p in parts for i in p["position_ids"]] + list(range(pad))
        assert r["loss_mask"] == ([False] * len(ids) if r["is_dummy"] else [x for p in parts for x in p["loss_mask"]]) + [False] * pad
        assert r["advantages"] == ([0.0] * len(ids) if r["is_dummy"] else [x for p in parts for x in p["advantages"]]) + [0.0] * pad
        assert r["sequence_lengths"] == [len(p["input_ids"]) for p in parts] + ([pad] if pad else [])


def test_stacked_batches(spark):
    """The rule step by step, with lists."""
    rows = by_key(groups._lengths(spark, SF).collect(), "run_id")
    sizes = [256, 512, 1024]
    want = []
    for (run,), items in rows.items():
        held, since, step = {s: [] for s in sizes}, {}, 0
        for r in sorted(items, key=lambda r: r["arrival"]):
            n = min(r["length"] * 128, 1024)
            at = next(s for s in sizes if n <= s)
            held[at].append((r["sample_id"], n))
            late = at in since and step - since[at] > 10
            if len(held[at]) * at < 1024 and not late:
                since.setdefault(at, step)
                continue
            if late:
                while at < 1024 and (len(held[at]) + len(held[2 * at])) * 2 * at < 1024:
                    held[2 * at] += held[at]
                    held[at] = []
                    del since[at]
                    at *= 2
                    since.setdefault(at, step)
                held[at] += [(None, 1)] * (1024 // at - len(held[at]))
            want += [(run, step, at, p, i, k) for p, (i, k) in enumerate(held[at])]
            held[at] = []
            since.pop(at, None)
            step += 1
    got = [(r["run_id"], r["batch"], r["bucket"], r["position"], r["sample_id"], r["taken"]) for r in queries.QUERIES["p12_stacked"](spark, SF).collect()]
    assert sorted(got) == sorted(want) or sorted(got, key=repr) == sorted(want, key=repr)


def test_merged_steps(spark):
    """A chat whose prompts repeat what was said is one sample; the others have as many as their prompts part."""
    got = by_key(queries.QUERIES["p1_interleaved"](spark, SF).collect(), "rollout_id")
    chats = by_key(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.length("text").alias("n")).collect(), "conv_id")
    for (conv,), turns in chats.items():
        turns.sort(key=lambda t: t["turn"])
        samples = []
        for k, t in enumerate(turns):
            prompt = [x + (k if conv % 5 == 0 else 0) for u in turns[: k + 1] for x in (u["turn"], u["n"])]
            done = [t["n"], t["turn"]]
            fits = [s for s in samples if prompt[: len(s["all"])] == s["all"]]
            if fits:
                s = max(fits, key=lambda s: len(s["all"]))
                new = prompt[len(s["all"]) :]
                s["mask"] += [False] * len(new)
                s["all"] += new
            else:
                s = {"prompt": prompt, "all": list(prompt), "mask": []}
                samples.append(s)
            s["all"] += done
            s["mask"] += [conv % 7 != 0] * 2
        rows = sorted(got.get((conv,), []), key=lambda r: r["sample_idx"])
        assert [(r["prompt_ids"], r["completion_ids"], r["completion_mask"]) for r in rows] == [(s["prompt"], s["all"][len(s["prompt"]) :], s["mask"]) for s in samples]


def test_routes_need_their_prefix():
    steps = [
        {"prompt_ids": [1, 2], "completion_ids": [3], "routed": [[5], [6]], "routed_start": 0},
        {"prompt_ids": [1, 2, 3, 4], "completion_ids": [9], "routed": [[7], [8]], "routed_start": 2},
        {"prompt_ids": [1], "completion_ids": [], "routed": None, "routed_start": None},
    ]
    assert tj.stitched_routes(steps) == [[[5], [6], [0]], [[5], [6], [7], [8], [0]], None]
    with pytest.raises(ValueError):
        tj.stitched_routes([{**steps[1], "prompt_ids": [1, 2, 8, 4]}])


def test_finite_json(spark):
    texts = ['{"a": NaN, "b": [1, Infinity, {"c": -Infinity, "d": 2}], "e": 3}', "NaN", "[[NaN, 1]]", "no json", None, "{}"]
    got = [(r["finite"], r["dropped"]) for r in fl.finite_json(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()]
    assert got == [('{"b": [1, {"d": 2}], "e": 3}', ["a", "b[1]", "b[2].c"]), (None, [""]), ("[[1]]", ["[0][0]"]), ("no json", []), (None, []), ("{}", [])]


def test_packed_step(spark):
    samples = groups._samples(spark, SF).where("step < 2").withColumnRenamed("run_id", "run")
    runs = spark.createDataFrame([("run0", 0, 0), ("run1", 1, 0)], "run string, place long, current_step long")
    rows, after = bt.packed(samples, runs, 400, 24, 2)
    tokens = rows.where("not is_dummy").agg(F.sum(F.size("input_ids"))).first()[0]
    assert 0 < tokens <= 400 and after in (0, 1)
    assert {r["pack"] for r in bt.packed(samples, runs, 400, 24, 2, together=True)[0].collect()} == {"all"}


def test_stamps_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.range(1).select(sc.utc_stamp(F.lit(86399))).first()[0] == "1970-01-01T23:59:59Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weighted_interleave(spark):
    """Rows of each source in order, wrapping around, up to the place that exhausts the last source; blocks of draws don't show."""
    n = [spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "supplier")]
    weights = [("0", 0.8), ("1", 0.2)]
    for until, stop in (("all_exhausted", all), ("first_exhausted", any)):
        length = sp.draws_until(spark, weights, n, until, 5)
        plan = [r["source"] for r in sp.weighted_schedule(spark, weights, length, 5).orderBy("draw").collect()]
        at, ended = [0, 0], [False, False]
        for k, source in enumerate(map(int, plan)):
            assert not stop(ended), (until, k)
            at[source] += 1
            ended[source] |= at[source] % n[source] == 0
        assert stop(ended) and len(plan) == length
    length = sp.draws_until(spark, weights, n, "all_exhausted", 5)
    got = {r["__place"]: r["k"] for r in queries.QUERIES["o5_interleave_by_probability"](spark, SF).collect()}
    assert sorted(got) == list(range(length))
    keys = [sorted(r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    seen = [0, 0]
    for r in sp.weighted_schedule(spark, weights, length, 5).orderBy("draw").collect():
        s = int(r["source"])
        assert r["position"] == seen[s] and got[r["draw"]] == keys[s][seen[s] % n[s]]
        seen[s] += 1
    with pytest.raises(ValueError):
        sp.draws_until(spark, [("0", 1.0), ("1", 0.0)], [3, 3], "all_exhausted")


def test_positions_across_blocks(spark, monkeypatch):
    weights = [("a", 2.0), ("b", 1.0), ("c", 1.0)]
    whole = sorted(tuple(r) for r in sp.weighted_schedule(spark, weights, 300, 2).collect())
    monkeypatch.setattr(sp, "BLOCK_BITS", 4)
    assert sorted(tuple(r) for r in sp.weighted_schedule(spark, weights, 300, 2).collect()) == whole


def test_small_helpers(spark, tmp_path):
    assert bt.attention_coefficients(8, 2, 1, 4, 16, 3, 10) == (3 * (2 * 8 * 4 * 6 + 6 * 8 * 16) + 2 * 8 * 10, 3 * 2 * 2 * 4)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "log.jsonl").write_text('{"level": "INFO", "message": "m", "step": 3, "progress": 0.5, "other": 1}\n{"message": "n"}\n')
    listed = rd.listed_files(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["log.jsonl"] and listed[0]["length"] > 50
    entries = [(r["level"], r["message"], r["step"], r["progress"]) for r in rd.log_entries(spark, str(tmp_path / "deep")).orderBy("message").collect()]
    assert entries == [("INFO", "m", 3, 0.5), (None, "n", None, None)]
