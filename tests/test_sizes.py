"""What shows only on larger tables, on tables made to look like them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rollsift.plans import queries

SF = "/root/testdata/sf0.001"


def sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(queries.SQL[name]).fetchall(), key=repr)


def test_no_training_step_is_an_empty_table(spark, tmp_path):
    """Ids far apart: too few tokens are ready for the first step."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") * 1000)
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["p15_packed_steps"](spark, str(tmp_path))
    assert got.columns == ["train_step", "run", "sample"] and got.collect() == []


def test_pass_at_k_of_large_examples(spark, tmp_path):
    """An example with more than 2048 rows."""
    events = spark.read.parquet(f"{SF}/events.parquet").limit(1).drop("event_id", "value")
    more = spark.range(2100).select((F.col("id") * 1200).alias("event_id"), F.when(F.col("id") < 40, 0.01).otherwise(0.02).alias("value"))
    events.crossJoin(more).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["a18_pass_at_k"](spark, str(tmp_path)).select("env_name", "eval_step", "k", "pass_at_k").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sql("a18_pass_at_k", tmp_path, "events") and len(got) == 11


def plan(df):
    return df._jdf.queryExecution().toString()


def test_custom_advantage_cuts_groups_from_larger_frames(spark):
    """Groups of one row to hundreds, a null one and NaN, across batches of three rows; no frame is moved for each group."""
    from rollsift.operators.advantage import custom_advantage

    key = F.when(F.col("id") % 7 > 0, F.floor(F.sqrt(F.col("id"))) % 20)
    df = spark.range(900).select("id", F.when(key == 3, float("nan")).otherwise(key.cast("double")).alias("group_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = custom_advantage(df, lambda g: [len(g) * 1000 + g["id"].min()] * len(g))
        got = {r["id"]: r["advantage"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in df.collect():
        groups.setdefault(repr(r["group_id"]), []).append(r["id"])
    assert got == {i: len(g) * 1000 + min(g) for g in groups.values() for i in g} and {"None", "nan"} < set(groups)
    assert "FlatMapGroupsInPandas" not in plan(made)


def test_tokenised_chats_are_sent_in_parts(spark):
    """More tokens than are held at once, a chat that isn't stable among them; none of it passes through pandas."""
    from rollsift.operators import messages as ms

    text = F.concat(F.lit("x" * 30_000), F.col("id").cast("string"))
    chats = spark.range(40).coalesce(1).select("id", F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("yes").alias("content"))).alias("chat"))

    def render(messages, ask):
        out = [b for m in messages for b in m["content"].encode()]
        return [len(messages), *out] if messages[0]["content"].endswith("x7") else out

    made = ms.tokenised(chats, render, keep=("id",))
    got = {r["id"]: (r["ids"], r["mask"]) for r in made.collect()}
    asked = {i: list(b"x" * 30_000 + str(i).encode()) for i in range(40) if i != 7}
    assert got == {i: (x + list(b"yes"), [False] * len(x) + [True] * 3) for i, x in asked.items()}
    assert "MapInPandas" not in plan(made)


def test_longest_prefix_moves_no_tokens(spark):
    """A query's tokens aren't dealt over tasks; nulls, words that look spelt and a small table of marks give the same."""
    from rollsift.operators import ordering as od

    words = [["a", None, "1:b"], ["a", "-", "1:b"], ["a", None], ["a1", ":b"], ["a"], [], ["a", None, "1", "b"], None]
    texts = [(k, i * 2 + k, w) for i, w in enumerate(words * 200) for k in (0, 1)] + [(None, 9999, ["a"])]
    asked = spark.createDataFrame([(k, i, w) for k, i, w in texts if i % 3], "key int, q long, ids array<string>")
    given = spark.createDataFrame([(k, i, w) for k, i, w in texts if k and w != ["a"]], "key int, prefix_id long, prefix array<string>")
    made = od.longest_prefix(asked, given, "key")
    first = {}
    for k, i, w in texts:
        if k and w is not None and w != ["a"]:
            first.setdefault(tuple(w), i)
    want = {(i, first[max((p for p in first if tuple(w[: len(p)]) == p), key=len)]) for k, i, w in texts if i % 3 and k and w is not None}
    assert {(r["q"], r["prefix_id"]) for r in made.collect()} == want
    assert "Generate" not in plan(made)


def test_many_step_folders_are_few_tasks():
    """A task takes a range of a run's steps; each step is in one, and few steps are a task each."""
    from rollsift.sources.transport import TASKS, StepReader

    reader = StepReader("/nowhere", 2)
    parts = reader.partitions({"run_a": 5}, {"run_a": 9000, "run_b": 2, "run_c": 3003})
    assert [(p.run, s) for p in parts for s in range(p.first, p.last)] == [("run_a", s) for s in range(5, 9000)] + [("run_c", s) for s in range(2, 3003)]
    assert len(parts) <= TASKS + 2
    assert len(reader.partitions({}, {"run_a": 9})) == 7


def test_an_exports_tasks_arent_cut_by_bytes(spark, tmp_path):
    """Small steps are written by as many tasks as the session names."""
    from rollsift.sources import writers as wr

    df = spark.range(400).select((F.col("id") % 40).alias("export_step"), F.lit(0).alias("rank"), "id")
    attempt = wr.staged_export(df, f"file://{tmp_path}/out")
    names = {r["f"] for r in spark.read.text(attempt).select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).alias("f")).distinct().collect()}
    assert len(names) > 1
    assert wr.commit_export(spark, attempt, f"file://{tmp_path}/out") == [*range(40)]


def test_small_steps_are_written_by_the_tasks_themselves(spark, tmp_path):
    """Names, lines and what a second writing replaces are those of Spark's writer, without its process a file and checksum."""
    from rollsift.sources import writers as wr

    odd = F.element_at(F.array(*[F.lit(x) for x in ("a/b", "", "x=1%", "é {y}", "plain", "two\nlines")]), (F.col("id") % 6 + 1).cast("int"))
    df = spark.range(600).repartition(5).select("id", (F.col("id") % 40).alias("step"), F.when(F.col("id") % 7 > 0, odd).alias("env"), F.when(F.col("id") % 3 > 0, odd).alias("text"), F.array("id").alias("trajectory"), (F.col("id") / 0.7).alias("x"))
    again = df.where("step = 3").withColumn("text", F.lit("again"))
    for by in (("step",), ("step", "env")):
        mine, want = f"{tmp_path}/mine{len(by)}", f"{tmp_path}/want{len(by)}"
        for rows in (df, again):
            wr.rollouts(rows, mine, partition=by)
            rows.drop("trajectory").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(want)
        folders = lambda path: sorted(d[len(path) :] for d, _, f in os.walk(path) if any(x.endswith(".json") for x in f))
        rows = lambda path: sorted((repr(tuple(r)) for r in spark.read.schema("id long, x double, text string, env string, step string").json(path).collect()))
        assert folders(mine) == folders(want) and rows(mine) == rows(want)
        assert not [f for _, _, names in os.walk(mine) for f in names if f.endswith(".crc")] and "_attempts" not in os.listdir(mine)


def test_a_writing_that_fails_changes_no_step(spark, tmp_path):
    from rollsift.sources import writers as wr

    df = spark.range(40).select("id", (F.col("id") % 4).alias("step"))
    wr.rollouts(df, f"{tmp_path}/r")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ZeroDivision"):
        wr.rollouts(df.withColumn("id", F.udf(lambda x: 1 // (x - 39), "long")("id")), f"{tmp_path}/r")
    assert sorted((r["id"], r["step"]) for r in spark.read.json(f"{tmp_path}/r").collect()) == [(i, i % 4) for i in range(40)]


def test_step_folders_are_read_by_their_names(spark, tmp_path):
    """Values are those that Spark's discovery of partitions finds, without it: the plan has no partition columns."""
    from rollsift.sources import readers as rd
    from rollsift.sources import writers as wr

    odd = [None, "a/b", "x=1%", "é {y}", "two\nlines", "a+b c%20d", "__x", "plain"]
    rows = [(i, None if i % 5 == 4 else i % 5 - 1, odd[i % len(odd)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, step int, env string")
    by, path = ("step", "env"), f"{tmp_path}/step=9/a+b/out"
    wr.rollouts(df, path, partition=by)
    made = rd.rollouts(spark, path, "env string, id long, step int", by)
    assert made.columns == ["env", "id", "step"] and sorted(map(repr, made.collect())) == sorted(map(repr, df.select("env", "id", "step").collect()))
    assert sorted(map(repr, made.collect())) == sorted(map(repr, spark.read.schema("id long, step int, env string").json(path).select("env", "id", "step").collect()))
    for df in (made, queries.QUERIES["k1_written_rollouts"](spark, SF)):
        assert df._jdf.queryExecution().analyzed().collectLeaves().head().relation().partitionSchema().length() == 0
