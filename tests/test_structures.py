"""Packing grids, messages, sources, sinks and streams end to end."""

import json

from pyspark.sql import functions as F

from rollsift.operators import batches as bt
from rollsift.operators import messages as ms
from rollsift.operators import sampling as sp
from rollsift.plans import queries
from rollsift.plans.groups import _lengths, _samples
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr
from rollsift.streaming import groups as st

SF = "/root/testdata/sf0.001"


def test_grid_is_even_and_whole(spark):
    got = queries.QUERIES["p4_assign"](spark, SF).toPandas()
    lengths = _lengths(spark, SF).toPandas().set_index("sample_id")
    real = got[~got.is_dummy]
    assert sorted(real.sample_id) == sorted(lengths.index)
    assert len(real) == len(real.drop_duplicates("sample_id"))
    for _, step in got.groupby(["run_id", "step"]):
        per_worker = step.drop_duplicates(["bin"]).groupby("worker").size()
        assert per_worker.nunique() == 1 and len(per_worker) == 4
    filled = real.assign(n=lengths.loc[real.sample_id, "length"].to_numpy(), mode=lengths.loc[real.sample_id, "mode"].to_numpy())
    bins = filled.groupby(["run_id", "step", "bin"])
    assert bins.n.sum().max() <= 24 and bins["mode"].nunique().max() == 1


def test_materialised_bins_keep_alignment(spark):
    packed = bt.materialised(bt.prepared(_samples(spark, SF), 24), queries.QUERIES["p4_assign"](spark, SF), multiple=8)
    same = [F.size(c) == F.size("input_ids") for c in ("loss_mask", "advantages", "position_ids", "temperatures", "env_names", "rewards", "teacher_logprobs", "inference_logprobs")]
    total = F.aggregate("sequence_lengths", F.lit(0), lambda a, x: a + x)
    bad = packed.where(~(F.size("input_ids") % 8 == 0) | (total != F.size("input_ids")) | ~F.expr("true"))
    assert bad.count() == 0
    for c in same:
        assert packed.where(~c).count() == 0
    assert packed.where(F.col("is_dummy") & F.exists("loss_mask", lambda x: x)).count() == 0


def test_messages_win_over_prompt(spark):
    df = spark.createDataFrame([([("user", "a")], "p", "c"), (None, "p", "c")], "messages array<struct<role:string,content:string>>, prompt string, completion string")
    got = [[(m["role"], m["content"]) for m in r["chat"]] for r in ms.resolved(df).collect()]
    assert got == [[("user", "a")], [("user", "p"), ("assistant", "c")]]


def test_missing_messages_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        ms.resolved(spark.createDataFrame([("x",)], "text string"))


def test_render_masked():
    render = lambda msgs, ask: [b for m in msgs for b in (0, ord(m["role"][0]), *m["content"].encode())] + ([0, ord("a")] if ask else [])
    ids, mask = ms.render_masked([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], render)
    assert ids == [0, 117, 104, 105, 0, 97, 121, 111] and mask == [False] * 6 + [True, True]
    unstable = lambda msgs, ask: [len(msgs)] * len(msgs)
    assert ms.render_masked([{"role": "user", "content": ""}, {"role": "assistant", "content": ""}], unstable) is None


def test_interleave_orders(spark):
    a = spark.createDataFrame([("a0", 0)], "x string, __index long")
    b = spark.createDataFrame([("b0", 0), ("b1", 1)], "x string, __index long")
    rows = lambda until: [r["x"] for r in sp.interleave([a, b], until=until).orderBy("__place").collect()]
    assert rows("first_exhausted") == ["a0", "b0"]
    assert rows("all_exhausted") == ["a0", "b0", "a0", "b1"]


def test_probabilities_are_kept(spark):
    picks = sp.weighted_schedule(spark, [("a", 3.0), ("b", 1.0)], 20000, 1).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 20000 for r in picks}
    assert abs(share["a"] - 0.75) < 0.02


def test_subset_splits():
    assert sp.subset_splits(None, None) == [(None, "train")]
    assert sp.subset_splits(["a"], None) == [("a", "train")]
    assert sp.subset_splits(["a", "b"], ["x", "y"]) == [("a", "x"), ("b", "y")]


def test_token_export_reads_stable_steps_only(spark, tmp_path):
    good = {"step": 1, "loss_mask": [True, False], "token_ids": [1, 2]}
    for step, stable in ((1, True), (2, False)):
        folder = tmp_path / f"step_{step}"
        folder.mkdir()
        (folder / "rank_0.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps({**good, "token_ids": [1]})]) + "\n")
        if stable:
            (folder / "STABLE").touch()
    records, bad = rd.token_export(spark, str(tmp_path))
    assert records.count() == 1 and [r["bad"] for r in bad.collect()] == [2]


def test_sample_table_keeps_places(spark, tmp_path):
    rows = [(0, "101", "p", "c", [1], 1.0), (1, "x", "p", None, [1], 1.0), (2, "y", "p", "c", [1], 0.5)]
    df = spark.createDataFrame(rows, "sample_id long, example_id string, prompt string, completion string, trajectory array<int>, reward double")
    df = df.withColumn("env_name", F.lit("e")).withColumn("advantage", F.lit(0.0)).withColumn("num_input_tokens", F.lit(1)).withColumn("num_output_tokens", F.lit(1))
    wr.samples(wr.sample_rows(df, "run", 3, "train"), str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t")).orderBy("sample_id").collect()
    assert [(r["problem_id"], r["sample_id"], r["step"]) for r in got] == [(101, 0, 3), (2, 2, 3)]


def test_exportable_trims_padding(spark):
    df = spark.createDataFrame([([True, False, False], ["e", "", ""], [1.0, float("nan"), 2.0]), ([False], [""], [0.0])], "loss_mask array<boolean>, env_names array<string>, v array<double>")
    (row,) = wr.exportable(df, arrays=("v",)).collect()
    assert row["loss_mask"] == [True] and row["v"] == [1.0]


def test_stream_gives_whole_groups_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"group_id": "a", "n": 1}, {"group_id": "a", "n": 2}, {"group_id": "b", "n": 3}]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("group_id string, n long").json(str(source))
    seen = []
    q = st.write_batches(st.stream_groups(stream, 2), lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r["n"] for r in seen) == [1, 2]
