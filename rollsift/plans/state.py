"""Operators that keep state or publish: streams drained into the shared folder, exports in two phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollsift.functions import arrays as ar
from rollsift.operators import batches as bt
from rollsift.operators.admission import rate_limited
from rollsift.plans.groups import _lengths, _samples
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, SEQUENCES, read, rollouts, sequences
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr
from rollsift.sources.scratch import scratch_path, written
from rollsift.sources.transport import transported
from rollsift.streaming import groups as st


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts as a stream of the events' files, with numbers that an even double can't hold."""
    events = read(spark, sf_dir, "events")  # a pattern, as the table may be a file or a folder
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.select(
        F.col("event_id").alias("rollout_id"), F.floor(F.col("event_id") / 4).cast("long").alias("group_id"), F.concat(F.lit("env"), (F.floor(F.col("event_id") / 4) % 3).cast("string")).alias("env_name"),
        (F.floor(F.col("event_id") / 4) % 4).cast("long").alias("eval_step"), (F.col("event_id") + F.lit((1 << 53) + 1)).alias("wide"), (F.col("value") / 3).alias("third"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"), "ts",
    )


_SEEN = "(SELECT event_id AS rollout_id, event_id // 4 AS group_id, 'env' || (event_id // 4 % 3) AS env_name, event_id // 4 % 4 AS eval_step, event_id + 9007199254740993 AS wide, value / 3 AS third, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id, ts FROM events)"


@query(f"WITH n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM {_SEEN}) SELECT rollout_id, wide, third, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM n WHERE n >= 4")
def x1_stream_groups(spark, sf_dir):
    """Whole groups of a stream, every value as it came."""
    whole = st.drained(st.stream_groups(_streamed(spark, sf_dir), 4, order="rollout_id"), "stream-groups")
    return whole.select("rollout_id", "wide", "third", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"))


@query(f"WITH n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY env_name, eval_step ORDER BY rollout_id) AS rn FROM {_SEEN} WINDOW w AS (PARTITION BY env_name, eval_step)) SELECT rollout_id, wide FROM n WHERE rn <= n // 64 * 64")
def x3_stream_evaluations(spark, sf_dir):
    """Evaluations of 16 examples by 4, each as soon as it is whole."""
    return st.drained(st.stream_evaluations(_streamed(spark, sf_dir), 16, 4, order="rollout_id"), "stream-evaluations").select("rollout_id", "wide")


@query(f"SELECT rollout_id, lag(wide) OVER w AS previous_wide, lag(third) OVER w AS previous_third FROM {_SEEN} WINDOW w AS (PARTITION BY group_id ORDER BY rollout_id)")
def j8_stream_previous(spark, sf_dir):
    got = st.drained(st.stream_previous(_streamed(spark, sf_dir), ["group_id"], "rollout_id", ["wide", "third"]), "stream-previous")
    return got.select("rollout_id", "previous_wide", "previous_third")


@query(f"""WITH {ROLLOUTS} SELECT step // 20 AS step, (rollout_id % 4)::INT AS rank, env_name, [rollout_id, len] AS token_ids, [len % 2 = 0, true] AS loss_mask FROM rollouts""")
def x7_published_export(spark, sf_dir):
    """An export is staged twice and committed three times; readers see every row once."""
    path = scratch_path(spark, "export")
    step = F.floor(F.col("step") / 20).cast("int")
    rows = rollouts(spark, sf_dir).select(
        step.alias("step"), step.alias("export_step"), (F.col("rollout_id") % 4).cast("int").alias("rank"), F.col("rollout_id").cast("int").alias("micro_step"), "env_name",
        F.array("rollout_id", "len").alias("token_ids"), F.array(F.col("len") % 2 == 0, F.lit(True)).alias("loss_mask"),
    )
    attempts = [wr.staged_export(rows, path) for _ in range(2)]
    for a in (attempts[0], attempts[1], attempts[0]):
        wr.commit_export(spark, a, path)
    good, _ = rd.token_export(spark, path)
    return good.select(F.col("step").cast("long").alias("step"), "rank", "env_name", "token_ids", "loss_mask")


@query(f"WITH {ROLLOUTS} SELECT step, rollout_id, reward FROM rollouts")
def k1_written_rollouts(spark, sf_dir):
    """Rollouts written by step, one step of them a second time: it replaces itself alone."""
    path = scratch_path(spark, "rollouts")
    rows = rollouts(spark, sf_dir).select("step", "rollout_id", "reward", F.array("len").alias("trajectory"))
    wr.rollouts(rows, path)
    wr.rollouts(rows.where("step = 3"), path)
    return rd.rollouts(spark, path, "rollout_id long, reward double, step long").select("step", "rollout_id", "reward")


@query("SELECT count(*)::BIGINT AS input_rows FROM events")
def x9_gauges(spark, sf_dir):
    """Rows that a listener saw come in, batch by batch."""
    root = scratch_path(spark, "gauges")
    listener = st.Gauges(spark, f"{root}/gauges")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", "4").parquet(f"{sf_dir}/events.parque[t]")
        st.started(stream.select("event_id"), f"{root}/rows", f"{root}/checkpoint", "gauged").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(st.Gauges.SCHEMA).parquet(f"{root}/gauges").where("query = 'gauged'").agg(F.sum("input_rows").alias("input_rows"))


@query()
def p15_packed_steps(spark, sf_dir):
    """Training steps until every sample is in one: (train_step, run, sample).

    A run's steps are 8,000 ids wide, or a quarter of the table's ids if that is more, and count from 0 without gaps. What
    is left of them under the budget isn't waited for, as nothing more will come. No sample is over the budget."""
    lengths = _lengths(spark, sf_dir).select(F.col("run_id").alias("run"), "arrival", F.col("sample_id").alias("sample"), F.col("length").cast("long").alias("tokens"))
    lengths = written(lengths, "lengths")
    total, longest, low, high = lengths.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0)), F.coalesce(F.min("sample"), F.lit(0)), F.coalesce(F.max("sample"), F.lit(0))).first()
    budget = max(total // 6 + 1, longest)
    wide = lengths.withColumn("_wide", F.floor(F.col("sample") / max(8000, (high - low) // 4 + 1)).cast("long"))
    numbers = wide.select("run", "_wide").distinct().withColumn("step", F.dense_rank().over(W.partitionBy("run").orderBy("_wide")).cast("long") - 1)
    samples = written(wide.join(F.broadcast(numbers), ["run", "_wide"]).drop("_wide"), "samples")
    runs = samples.groupBy("run").agg(F.min("step").alias("current_step")).select("run", F.expr("cast(substr(run, 4) as long)").alias("place"), "current_step")
    steps, position = [], 0
    while True:
        taken = bt.next_step(samples, runs, budget, position, wait=False)
        if taken is None:
            break
        chosen, samples, runs, position = taken
        steps.append(chosen.select(F.lit(len(steps)).alias("train_step"), "run", "sample"))
    none = samples.limit(0).select(F.lit(0).alias("train_step"), "run", "sample")
    return reduce(DataFrame.unionByName, steps, none)


@query(f"""WITH {ROLLOUTS}, m AS (SELECT step, 'reward' AS key, sum(reward) AS value FROM rollouts GROUP BY step UNION ALL SELECT step, 'tokens', sum(len)::DOUBLE FROM rollouts GROUP BY step)
    SELECT 'full' AS kind, step, key, value FROM m UNION ALL SELECT 'last', step, key, value FROM m WHERE step = (SELECT max(step) FROM m)""")
def k5_metric_history(spark, sf_dir):
    """All steps' metrics and the last step's, as a run's monitor keeps them."""
    root = scratch_path(spark, "metrics")
    r = rollouts(spark, sf_dir)
    sums = r.groupBy("step").agg(F.sum("reward").alias("reward"), F.sum("len").cast("double").alias("tokens"))
    rows = sums.unpivot("step", ["reward", "tokens"], "key", "value")
    wr.metric_history(rows, f"{root}/full")
    wr.metric_history(rows, f"{root}/last", last_only=True)
    read_back = lambda kind: spark.read.schema(rows.schema).parquet(f"{root}/{kind}").select(F.lit(kind).alias("kind"), "step", "key", "value")
    return read_back("full").unionByName(read_back("last"))


@query(f"WITH {ROLLOUTS} SELECT max(step) AS step, count(*)::BIGINT AS samples, sum(len)::BIGINT AS tokens FROM rollouts")
def k9_progress(spark, sf_dir):
    """A run's counters, written after a half of its steps and again after all: the last ones stay."""
    path = scratch_path(spark, "progress")
    r = rollouts(spark, sf_dir)
    counters = lambda df: df.agg(F.max("step").alias("step"), F.count("*").alias("samples"), F.sum("len").alias("tokens"))
    wr.progress(counters(r.where("step % 2 = 0")), path)
    wr.progress(counters(r), path)
    return spark.read.schema("step long, samples long, tokens long").parquet(path)


@query("SELECT p_brand AS model_name, count(*)::INT AS seq_len, round(sum(p_partkey)::DOUBLE, 3) AS throughput FROM part GROUP BY 1")
def s12_benchmarks(spark, sf_dir):
    """A tree of benchmark records, a file each, and files that are none."""
    path = scratch_path(spark, "benchmarks")
    p = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").cast("int").alias("n"), F.sum("p_partkey").cast("double").alias("keys"))
    record = F.to_json(F.struct(F.struct(F.lit("rl").alias("type"), F.col("p_brand").alias("model_name"), F.col("n").alias("seq_len")).alias("config"), F.struct(F.struct(F.col("keys").alias("mean")).alias("throughput")).alias("metrics")))
    lines = p.select("p_brand", F.explode(F.array(F.struct(F.lit("good").alias("kind"), record.alias("value")), F.struct(F.lit("broken").alias("kind"), F.lit("{no record").alias("value")))).alias("x"))
    lines.select(F.col("x.kind").alias("kind"), "p_brand", "x.value").repartition("kind", "p_brand").write.partitionBy("kind", "p_brand").text(path)
    got = rd.benchmarks(spark, path)
    return got.select(F.col("config.model_name").alias("model_name"), F.col("config.seq_len").alias("seq_len"), F.round("metrics.throughput.mean", 3).alias("throughput"))


@query(f"""WITH {SEQUENCES} SELECT id, string_agg(q, ',' ORDER BY pos) || CASE WHEN last(q ORDER BY pos) = 7 THEN '' ELSE ',7' END AS ids FROM places GROUP BY id""")
def m8_appended_end(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.array_join(ar.append_if_missing(F.transform("xs", lambda x: x["q"]), F.lit(7)), ",").alias("ids"))


_BINS = f"""{SEQUENCES}, s AS (SELECT id, 'run' || (id % 2) AS run_id, id // 500 AS step, row_number() OVER (PARTITION BY id % 2, id // 500 ORDER BY id) - 1 AS rk FROM (SELECT DISTINCT id FROM items)),
    t AS (SELECT run_id, step, rk // 3 AS bin, rk % 3 AS position, p.*, (rk // 3) % 5 = 4 AS dummy, max(CASE WHEN pos = 3 THEN 5 + t END) OVER (PARTITION BY id) AS first3 FROM s JOIN places p USING (id))"""


@query(f"""WITH {_BINS}, b AS (SELECT run_id, step, bin, count(*) AS n, string_agg(token, ',' ORDER BY position, pos) AS ids, string_agg((NOT dummy AND pos > 2 AND q % 3 <> 0)::INT, ',' ORDER BY position, pos) AS mask,
        string_agg(CASE WHEN dummy THEN 0 ELSE id % 5 END, ',' ORDER BY position, pos) AS advantages, string_agg(CASE WHEN pos > 2 THEN -d ELSE 0 END, ',' ORDER BY position, pos) AS logprobs,
        string_agg(CASE WHEN pos > 2 THEN 5 + t ELSE coalesce(first3, 10) END, ',' ORDER BY position, pos) AS temperatures, string_agg(pos - 1, ',' ORDER BY position, pos) AS positions,
        string_agg('env' || (id % 3), ',' ORDER BY position, pos) AS envs, string_agg(id % 2, ',' ORDER BY position, pos) AS rewards, string_agg(CASE WHEN id % 4 = 0 THEN 0 ELSE token % 2 END, ',' ORDER BY position, pos) AS types,
        count(*) FILTER (id % 3 = 0) AS a0, count(*) FILTER (id % 3 = 1) AS a1, count(*) FILTER (id % 3 = 2) AS a2 FROM t GROUP BY ALL), f AS (SELECT *, (-n) % 8 + CASE WHEN n % 8 = 0 THEN 0 ELSE 8 END AS pad FROM b)
    SELECT run_id, step, bin, ids || repeat(',1', pad) AS ids, mask || repeat(',0', pad) AS mask, advantages || repeat(',0', pad) AS advantages, logprobs || repeat(',0', pad) AS logprobs, temperatures || repeat(',10', pad) AS temperatures,
        positions || CASE WHEN pad > 0 THEN ',' || array_to_string(range(pad), ',') ELSE '' END AS positions, envs || repeat(',', pad) AS envs, rewards || repeat(',nan', pad) AS rewards, types || repeat(',0', pad) AS types,
        a0 || ',' || a1 || ',' || (a2 + pad) AS adapter_tokens FROM f""")
def p6_bins(spark, sf_dir):
    """Every array of bins of three samples, padded to eights, with adapters and type ids; each fifth bin is a dummy."""
    s = _samples(spark, sf_dir)
    at = F.row_number().over(W.partitionBy("run_id", "step").orderBy("arrival")).cast("long") - 1
    plan = s.select("run_id", "step", "sample_id", at.alias("at")).select("run_id", "step", "sample_id", F.floor(F.col("at") / 3).alias("bin"), (F.col("at") % 3).alias("position"))
    plan = plan.withColumn("worker", F.col("bin") % 4).withColumn("turn", F.col("bin")).withColumn("is_dummy", F.col("bin") % 5 == 4)
    rows = bt.prepared(s, 24).withColumn("adapter", (F.col("sample_id") % 3).cast("int"))
    rows = rows.withColumn("type_ids", F.when(F.col("sample_id") % 4 != 0, F.transform("input_ids", lambda x: x % 2)))
    bins = bt.materialised(rows, plan, multiple=8, adapters=3)
    whole = lambda c, scale=1: F.array_join(F.transform(c, lambda x: F.when(F.isnan(x.cast("double")), F.lit("nan")).otherwise(F.round(x.cast("double") * scale).cast("long").cast("string"))), ",")
    return bins.select(
        "run_id", "step", "bin", whole("input_ids").alias("ids"), F.array_join(F.transform("loss_mask", lambda x: x.cast("int")), ",").alias("mask"), whole("advantages").alias("advantages"),
        whole("inference_logprobs", 10).alias("logprobs"), whole("temperatures", 10).alias("temperatures"), whole("position_ids").alias("positions"), F.array_join("env_names", ",").alias("envs"),
        whole("rewards").alias("rewards"), whole("type_ids").alias("types"), F.array_join("adapter_tokens", ",").alias("adapter_tokens"),
    )


@query(f"WITH {ROLLOUTS} SELECT 'run_' || env_name AS run_id, step // 20 AS step, rollout_id, len FROM rollouts WHERE env_name <> 'env2' OR step // 20 < 3")
def s7_transported(spark, sf_dir):
    """Each environment's steps as a run's folders; the third run's step 3 isn't whole, and what follows waits."""
    root = scratch_path(spark, "transport")
    r = rollouts(spark, sf_dir).withColumn("step", F.floor(F.col("step") / 20))
    for env in ("env0", "env1", "env2"):
        mine = r.where(F.col("env_name") == env).select(F.col("step").alias("export_step"), F.lit(0).alias("rank"), "rollout_id", "len")
        whole = mine.where("export_step <> 3") if env == "env2" else mine
        wr.token_export(whole, f"{root}/run_{env}")
    return st.drained(transported(spark, root, "rollout_id long, len long"), "transported").select("run_id", "step", "rollout_id", "len")


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS at_s, round(value * 100)::BIGINT % 900 AS cost FROM events),
    s AS (SELECT *, at_s - sum(cost) OVER (PARTITION BY event_type ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
    l AS (SELECT *, s + min(600 - cost - s) OVER (PARTITION BY event_type ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS level FROM s)
    SELECT event_id, level::BIGINT AS level, greatest(-level, 0)::BIGINT AS wait FROM l""")
def x6_rate_limited(spark, sf_dir):
    """Events of a type share a bucket of 600 that gains one a second."""
    e = read(spark, sf_dir, "events")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    rows = e.select("event_id", "event_type", seconds.alias("at_s"), (F.round(F.col("value") * 100).cast("long") % 900).alias("cost"))
    return rate_limited(rows, ["event_type"], "at_s", ["event_id"], "cost", 1, 600).select("event_id", "level", "wait")
