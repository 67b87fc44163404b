"""Trajectories, packing, bucketing, count-triggered groups, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollsift.operators import batches as bt
from rollsift.operators import metrics as m
from rollsift.operators import trajectories as tj
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, SEQUENCES, read, rollouts, sequences, tidy
from rollsift.sources import readers as rd
from rollsift.sources import writers as wr
from rollsift.streaming.groups import finished_evaluations, finished_groups


@query(f"WITH {ROLLOUTS}, n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY rollout_id) AS rn FROM rollouts) SELECT rollout_id FROM n WHERE n >= 4 AND rn <= 4")
def x1_finished_groups(spark, sf_dir):
    return finished_groups(rollouts(spark, sf_dir), 4, order="rollout_id").select("rollout_id")


@query(f"WITH {ROLLOUTS}, n AS (SELECT *, count(*) OVER (PARTITION BY env_name, eval_step) AS n, row_number() OVER (PARTITION BY env_name, eval_step ORDER BY rollout_id) AS rn FROM rollouts) SELECT rollout_id FROM n WHERE n >= 64 AND rn <= 64")
def x3_finished_evaluations(spark, sf_dir):
    return finished_evaluations(rollouts(spark, sf_dir), 16, 4, order="rollout_id").select("rollout_id")


@query(f"""WITH {ROLLOUTS}, s AS (SELECT env_name, step, sum(cents) % 3 <> 0 AS empty FROM rollouts GROUP BY ALL),
    i AS (SELECT *, sum((NOT empty)::INT) OVER (PARTITION BY env_name ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM s),
    r AS (SELECT env_name, step, empty, sum(empty::INT) OVER (PARTITION BY env_name, island ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM i) SELECT env_name, step FROM r WHERE empty AND run >= 2""")
def x5_streak_failures(spark, sf_dir):
    steps = rollouts(spark, sf_dir).groupBy("env_name", "step").agg((F.sum("cents") % 3 != 0).alias("empty"))
    return m.streak_failures(steps, "step", "empty", 2, ["env_name"]).select("env_name", "step")


def _samples(spark, sf_dir):
    """Orders as samples of two runs: line items are prompt and completion tokens."""
    xs, k = F.col("xs"), F.lit(2)
    done = F.slice(xs, F.lit(3), F.greatest(F.size("xs") - 2, F.lit(0)))
    return sequences(spark, sf_dir).select(
        F.col("id").alias("sample_id"), F.col("id").alias("arrival"), F.concat(F.lit("run"), (F.col("id") % 2).cast("string")).alias("run_id"), F.floor(F.col("id") / 500).cast("long").alias("step"),
        F.transform(F.slice(xs, F.lit(1), k), lambda x: x["token"]).alias("prompt_ids"), F.transform(F.slice(xs, F.lit(1), k), lambda x: x["q"] < 0).alias("prompt_mask"),
        F.transform(done, lambda x: x["token"]).alias("completion_ids"), F.transform(done, lambda x: x["q"] % 3 != 0).alias("completion_mask"),
        F.transform(done, lambda x: -x["d"] / 10.0).alias("completion_logprobs"), F.transform(done, lambda x: F.lit(0.5) + x["t"] / 10.0).alias("completion_temperatures"),
        F.lit(None).cast("array<double>").alias("teacher_logprobs"), (F.col("id") % 5).cast("double").alias("advantage"), (F.col("id") % 2).cast("double").alias("reward"),
        F.concat(F.lit("env"), (F.col("id") % 3).cast("string")).alias("env_name"), F.when(F.col("id") % 7 == 0, "sft").otherwise("rl").alias("mode"), (F.col("id") % 11 == 0).alias("multimodal"),
    )


@query(f"""WITH {SEQUENCES}, c AS (SELECT * FROM places WHERE pos <= 6) SELECT id AS sample_id, count(*)::INT AS n, sum(token)::BIGINT AS ids, count(*) FILTER (pos > 2 AND q % 3 <> 0) AS trained,
    round(sum(CASE WHEN pos > 2 THEN -d / 10.0 ELSE 0 END), 6) + 0 AS logprobs, round(sum(CASE WHEN pos <= 2 THEN coalesce(first3, 1.0) ELSE 0.5 + t / 10.0 END), 6) + 0 AS temperatures
    FROM (SELECT *, max(CASE WHEN pos = 3 THEN 0.5 + t / 10.0 END) OVER (PARTITION BY id) AS first3 FROM c) GROUP BY id""")
def p3_prepared(spark, sf_dir):
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    return bt.prepared(_samples(spark, sf_dir), 6).select(
        "sample_id", F.size("input_ids").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"), F.size(F.filter("loss_mask", lambda x: x)).cast("long").alias("trained"),
        tidy(total("inference_logprobs"), 6).alias("logprobs"), tidy(total("temperatures"), 6).alias("temperatures"),
    )


def _lengths(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select("run_id", "step", "sample_id", "arrival", (F.size("prompt_ids") + F.size("completion_ids")).alias("length"), "mode", "multimodal")


@query()
def p4_assign(spark, sf_dir):
    return bt.assign(_lengths(spark, sf_dir), 24, 4)


@query()
def p6_materialised(spark, sf_dir):
    packed = bt.materialised(bt.prepared(_samples(spark, sf_dir), 24), p4_assign(spark, sf_dir), multiple=8)
    return packed.select("run_id", "step", "bin", "worker", "turn", "is_dummy", F.size("input_ids").alias("tokens"), "sequence_lengths")


@query(f"""WITH RECURSIVE {SEQUENCES}, l AS (SELECT id, count(*) AS n, id % 2 AS run FROM items GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY id) AS pos FROM l),
    w AS (SELECT run, id, n, pos, 0::BIGINT AS pack, 0::BIGINT AS start, n AS used FROM r WHERE pos = 1
        UNION ALL SELECT r.run, r.id, r.n, r.pos, CASE WHEN w.used >= 20 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.used >= 20 THEN 0 ELSE w.used END, CASE WHEN w.used >= 20 THEN 0 ELSE w.used END + r.n FROM w JOIN r ON r.run = w.run AND r.pos = w.pos + 1),
    d AS (SELECT *, max(used) OVER (PARTITION BY run, pack) AS total FROM w) SELECT 'run' || run AS run_id, pack, id AS sample_id, start::INT AS start, least(n, 20 - start)::INT AS taken FROM d WHERE total >= 20""")
def p11_cat_packs(spark, sf_dir):
    return bt.cat_packs(_lengths(spark, sf_dir), 20, ["run_id"], "arrival")


@query()
def p12_stacked(spark, sf_dir):
    df = _lengths(spark, sf_dir).withColumn("length", F.col("length") * 128)
    return bt.stacked(df, 1024, ["run_id"], "arrival")


@query(f"""WITH {SEQUENCES}, l AS (SELECT id % 2 AS run, count(*) AS n, id FROM items GROUP BY id) SELECT 'run' || run AS run_id, count(*) FILTER (id % 3 = 0) AS samples, (sum(n) FILTER (id % 3 = 0))::BIGINT AS tokens,
    count(*) FILTER (id % 3 = 1) = 0 AS step_done FROM l GROUP BY run""")
def p14_run_progress(spark, sf_dir):
    s = _lengths(spark, sf_dir).withColumnRenamed("length", "tokens")
    return bt.run_progress(s.where("sample_id % 3 = 0"), s.where("sample_id % 3 = 1"))


@query()
def p1_interleaved(spark, sf_dir):
    """A chat's turns as steps: each prompt repeats what was said, a fifth of the chats change it."""
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))))
    chats = c.groupBy("conv_id").agg(turns.alias("ts"))
    ids = lambda upto: F.flatten(F.transform(upto, lambda t: F.array(t["turn"], t["n"])))
    cut = F.when(F.col("conv_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0))

    def step(t, i):
        prompt = F.transform(ids(F.slice(F.col("ts"), F.lit(1), i + 1)), lambda x: x + cut * i)
        return F.struct(
            prompt.alias("prompt_ids"), F.transform(prompt, lambda _: F.lit(False)).alias("prompt_mask"), F.array(t["n"], t["turn"]).alias("completion_ids"),
            F.array(F.lit(True), F.lit(True)).alias("completion_mask"), F.array(F.lit(-0.1), F.lit(-0.2)).alias("completion_logprobs"),
        )

    df = chats.select(F.col("conv_id").alias("rollout_id"), F.transform("ts", step).alias("steps"), F.when(F.col("conv_id") % 7 == 0, "Failed").alias("error"))
    return tj.interleaved(df)


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS v, CASE role WHEN 'user' THEN 'vllm:prompt_tokens_total' WHEN 'assistant' THEN 'vllm:num_requests_running' ELSE 'other_metric' END AS name, CASE WHEN turn % 3 <> 0 THEN 'e' || (turn % 3) END AS engine FROM conversations)
    SELECT conv_id, coalesce(engine, 'aggregate') AS engine, CASE name WHEN 'vllm:prompt_tokens_total' THEN 'prompt_tokens_total' ELSE 'running_requests' END AS metric,
        CASE WHEN name = 'vllm:prompt_tokens_total' THEN sum(v)::DOUBLE ELSE arg_max(v, turn)::DOUBLE END AS value FROM t WHERE name <> 'other_metric' GROUP BY conv_id, engine, name""")
def s11_scraped(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    name = F.when(F.col("role") == "user", "vllm:prompt_tokens_total").when(F.col("role") == "assistant", "vllm:num_requests_running").otherwise("other_metric")
    label = F.when(F.col("turn") % 3 != 0, F.concat(F.lit('{engine="e'), (F.col("turn") % 3).cast("string"), F.lit('",model="m"}'))).otherwise("")
    line = F.concat(name, label, F.lit(" "), F.length("text").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    text = F.concat(F.lit("# HELP a b\n\n"), F.array_join(lines, "\n"))
    return rd.scraped(c.groupBy("conv_id").agg(text.alias("text")), keys=("conv_id",))


@query("""WITH p AS (SELECT o_orderkey % 50 AS step, bool_or(o_orderkey % 3 = 0) AS stable FROM orders GROUP BY 1) SELECT step, stable FROM p""")
def s13_step_folders(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "STABLE").otherwise("rank_0.jsonl")
    return rd.step_folders(o.select(F.concat(F.lit("/out/step_"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/"), name).alias("path")))


@query(f"WITH {ROLLOUTS}, o AS (SELECT rollout_id, step, min(step) OVER (PARTITION BY env_name) AS oldest FROM rollouts) SELECT rollout_id FROM o WHERE step = oldest")
def s8_oldest_pending(spark, sf_dir):
    return rd.oldest_pending(rollouts(spark, sf_dir), sender="env_name").select("rollout_id")


@query(f"""WITH {ROLLOUTS}, b AS (SELECT DISTINCT env_name AS run_id, step FROM rollouts) SELECT run_id, step FROM b WHERE (run_id = 'env0' AND step = 3) OR (run_id = 'env1' AND step = 5)""")
def s7_pending_batches(spark, sf_dir):
    b = rollouts(spark, sf_dir).select(F.col("env_name").alias("run_id"), "step").distinct()
    runs = spark.createDataFrame([("env0", 3, False), ("env1", 5, False), ("env2", 4, True)], "run_id string, next_step long, ready_to_update boolean")
    return rd.pending_batches(b, runs).select("run_id", "step")


@query(f"""WITH {ROLLOUTS} SELECT CASE WHEN cents % 2 = 0 THEN rollout_id * 7 ELSE rollout_id END AS problem_id, rollout_id AS sample_id, env_name, reward, kind AS prompt, 'eval' AS tag FROM rollouts WHERE stop_condition IS NOT NULL""")
def k3_sample_rows(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    df = r.select(
        F.col("rollout_id").alias("sample_id"), F.when(F.col("cents") % 2 == 0, (F.col("rollout_id") * 7).cast("string")).otherwise("name").alias("example_id"), F.col("kind").alias("prompt"),
        F.col("stop_condition").alias("completion"), F.array("len").alias("trajectory"), "env_name", "reward", F.lit(0.5).alias("advantage"), F.col("len").alias("num_input_tokens"), F.col("len").alias("num_output_tokens"),
    )
    return wr.sample_rows(df, "run", 1, "eval").select("problem_id", "sample_id", "env_name", "reward", "prompt", "tag")


@query("""WITH l AS (SELECT r_regionkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY n_nationkey) AS "table" FROM l GROUP BY r_regionkey""")
def k7_markdown(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return wr.markdown(n.select("r_regionkey", "n_nationkey", "n_name"), ["n_nationkey", "n_name"], "r_regionkey")
