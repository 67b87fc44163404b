"""Operators that no registered query runs."""

import json

import pytest
from pyspark.sql import functions as F

from rollsift.functions import arrays as ar
from rollsift.functions import scalars as sc
from rollsift.operators import filters as fl
from rollsift.operators import messages as ms
from rollsift.operators import metrics as m
from rollsift.operators import ordering as od
from rollsift.operators import relations as rl
from rollsift.operators import sampling as sp
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_bytes_and_prefixes(spark):
    df = spark.createDataFrame([("AQL/", [1, 2, 3], [1, 2, 9, 9])], "b string, a array<int>, c array<int>")
    assert one(df, ar.decode_bytes("b"), ar.common_prefix_length("a", "c"), ar.common_prefix_length("a", "a")) == ([1, 2, 255], 2, 3)
    assert one(df, ar.align_length("a", 2, F.lit(0)), ar.align_length("a", 5, F.lit(0)), ar.first_non_empty(F.array().cast("array<int>"), "c")) == ([1, 2], [1, 2, 3, 0, 0], [1, 2, 9, 9])
    assert one(df, ar.powers_of_two(F.lit(9)), ar.starts_with("c", F.slice("a", 1, 2))) == ([1, 2, 4, 8], True)


def test_tool_calls_are_parsed(spark):
    schema = f"chat {ms.MESSAGES}"
    call = {"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"x": "1"}'}}
    none = {"id": "2", "type": "function", "function": {"name": "g", "arguments": None}}
    df = spark.createDataFrame([([{"role": "assistant", "content": "", "tool_calls": [call, none], "tool_call_id": None}],)], schema)
    (calls,) = df.select(ms.parsed_arguments(F.col("chat")).alias("c")).first()["c"]
    assert [(c["name"], c["arguments"]) for c in calls] == [("f", {"x": "1"}), ("g", None)]


def test_backfill_cuts_where_renderings_part(spark):
    df = spark.createDataFrame([([1, 2, 3, 7], [1, 2, 3, 4, 5])], "p array<bigint>, f array<bigint>")
    (step,) = df.select(ms.backfilled(F.col("p"), F.col("f"), F.lit(True))).first()
    assert (step["prompt_ids"], step["completion_ids"], step["completion_logprobs"]) == ([1, 2, 3], [4, 5], [0.0, 0.0])
    assert df.select(ms.backfilled(F.col("p"), F.col("f"), F.lit(False))).first()[0] is None


def test_teacher_logprobs_are_flattened(spark):
    df = spark.createDataFrame([([{"a": -0.5}, {}, None],)], "t array<map<string,double>>")
    assert df.select(ms.flattened_teacher_logprobs(F.col("t"))).first()[0] == [-0.5, 0.0, 0.0]


def test_unknown_role_is_an_error(spark):
    with pytest.raises(Exception, match="unknown role"):
        spark.range(1).select(ms.role_mask(F.lit("narrator"))).collect()


def test_io_row_prefers_typed_columns(spark):
    df = spark.createDataFrame([((1, "old"), "new", {"f": True}, [1])], "raw struct<a:int,env_name:string>, env_name string, filter_results map<string,boolean>, samples array<int>")
    got = fl.io_row(df, "raw")
    assert got.columns == ["a", "env_name", "filters"] and got.first()["env_name"] == "new"


def test_empty_trajectories_become_errors(spark):
    df = spark.createDataFrame([([], None), (None, None), ([1], None), ([], "Failed")], "trajectory array<int>, error string")
    assert [r["error"] for r in fl.promote_empty(df).collect()] == ["EmptyTrajectory", "EmptyTrajectory", None, "Failed"]


def test_completion_length_and_usage(spark):
    df = spark.createDataFrame([([([1, 2],), (None,), ([3],)],)], "steps array<struct<completion_ids:array<int>>>")
    assert df.select(m.completion_length("steps")).first()[0] == 3
    assert tuple(df.select(m.usage(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()[0]) == (1, 2, 3)


def test_fake_sources(spark):
    fixed = sp.fake_samples(spark, 3, 50, 16).collect()
    assert all(len(r["input_ids"]) == 16 == len(r["loss_mask"]) == len(r["position_ids"]) and r["input_ids"][1:] == r["target_ids"][:-1] for r in fixed)
    varied = sp.fake_samples(spark, 20, 50, 16, variable=True, increasing=False).collect()
    assert len({len(r["input_ids"]) for r in varied}) > 1 and all(0 <= t < 50 for r in varied for t in r["input_ids"])
    packed = sp.fake_packed(spark, 3, 50, 64).collect()
    assert all(len(r["position_ids"]) == 64 == len(r["input_ids"]) and r["position_ids"][0] == 0 and max(r["position_ids"]) < 8 for r in packed)


def test_epoch_orders_differ_and_repeat(spark):
    df = spark.range(50).withColumnRenamed("id", "__index")
    order = lambda e: [r[0] for r in sp.epoch_order(df, e).orderBy("__shuffle", "__index").select("__index").collect()]
    assert order(0) == order(0) != order(1)


def test_reports_and_merges(spark):
    rows = [("m2", "rl", 1, 5.0, "d", "a", "x"), ("m1", "rl", 1, 5.0, "d", "a", "x"), ("m1", "rl", 1, 9.0, "d", "a", "x")]
    df = spark.createDataFrame(rows, "model_name string, type string, seq_len int, throughput double, device_name string, ac string, attention string")
    assert [(r["model_name"], r["throughput"]) for r in od.report_order(df).collect()] == [("m1", 9.0), ("m1", 5.0), ("m2", 5.0)]
    assert rl.merged_columns(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    d = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>")
    assert d.select(sc.merged("x", "y")).first()[0] == {"a": 1, "b": 3}
    assert one(d, sc.strip_ansi(F.lit("\x1b[31mred\x1b[0m")), sc.short_name(F.lit("NVIDIA H100 80GB"), ["NVIDIA"]), sc.training_label(F.lit("rl"), F.lit(16)), sc.remove_suffix(F.lit("a/v1"), "/v1")) == ("red", "H100 80GB", "RL LoRA(r=16)", "a")


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1]), (2, "b", [2])], "step int, x string, trajectory array<int>")
    wr.rollouts(df, str(tmp_path / "r"))
    assert rd.tabular(spark, str(tmp_path / "r"), "json", "x string, step int").orderBy("step").collect() == [("a", 1), ("b", 2)]
    wr.metric_history(df.select("step", "x"), str(tmp_path / "m"), last_only=True)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [(2, "b")]
    wr.progress(df.select("step").limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert [r["last_step"] for r in wr.logged_sample(df).orderBy("step").collect()] == [1, 2]


def test_benchmark_files(spark, tmp_path):
    record = {"config": {"type": "rl", "model_name": "m", "seq_len": 8}, "metrics": {"mfu": {"mean": 1.0}}}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    assert [r["config"]["model_name"] for r in rd.benchmarks(spark, str(tmp_path)).collect()] == ["m"]


def test_experts(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.4], [0.9, 0.0, 0.0])], "s array<double>, b array<double>")
    chosen = od.top_experts("s", 2, F.col("b"))
    assert df.select(chosen).first()[0] == [0, 1]
    assert df.select(od.normalised_weights("s", chosen, 6.0)).first()[0] == pytest.approx([1.0, 5.0])
