"""Time series and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollsift.operators import timeseries as ts
from rollsift.plans.queries import query
from rollsift.plans.views import ROLLOUTS, SCRAPES, deltas_sql, rollouts, scrapes, tidy


@query(f"WITH {deltas_sql('view')} SELECT ts, round(sum(CASE WHEN d_ts > 0 AND d_view >= 0 THEN d_view / d_ts END), 6) + 0 AS rate FROM deltas GROUP BY ts")
def w1_counter_rate(spark, sf_dir):
    return ts.counter_rate(scrapes(spark, sf_dir), "view").withColumn("rate", tidy("rate", 6))


@query(f"""WITH {deltas_sql('click', 'view')}, s AS (SELECT ts, sum(d_click) FILTER (d_click >= 0 AND d_view >= 0) AS a, sum(d_view) FILTER (d_click >= 0 AND d_view >= 0) AS b FROM deltas GROUP BY ts)
    SELECT ts, CASE WHEN b > 0 THEN a / b END AS ratio FROM s""")
def w2_counter_ratio(spark, sf_dir):
    return ts.counter_ratio(scrapes(spark, sf_dir), "click", "view")


@query(f"""WITH {deltas_sql('click', 'view')}, s AS (SELECT ts, role, sum(d_click) FILTER (d_click >= 0 AND d_view >= 0) AS a, sum(d_view) FILTER (d_click >= 0 AND d_view >= 0) AS b FROM deltas GROUP BY ALL)
    SELECT ts, role, CASE WHEN b > 0 THEN a / b END AS average FROM s""")
def w3_histogram_average(spark, sf_dir):
    renamed = scrapes(spark, sf_dir).withColumn("metric", F.when(F.col("metric") == "click", "wait_sum").when(F.col("metric") == "view", "wait_count").otherwise(F.col("metric")))
    return ts.histogram_average(renamed, "wait", ["role"])


@query(f"""WITH {SCRAPES}, two AS (SELECT 'agg' AS scope, * FROM scrapes UNION ALL SELECT role, * FROM scrapes),
    e AS (SELECT endpoint, role, ts, sum(value) FILTER (metric = 'signup') AS p, sum(value) FILTER (metric = 'error') AS g, sum(value) FILTER (metric = 'purchase') AS c FROM scrapes WHERE metric IN ('signup', 'error', 'purchase') GROUP BY ALL),
    d AS (SELECT role, ts, p - lag(p) OVER w AS dp, g - lag(g) OVER w AS dg, c - lag(c) OVER w AS dc, ts - lag(ts) OVER w AS dt FROM e WINDOW w AS (PARTITION BY endpoint ORDER BY ts)),
    r AS (SELECT scope, ts, sum(dp / dt) FILTER (dp >= 0 AND dt > 0) AS p, sum(dg / dt) FILTER (dg >= 0 AND dt > 0) AS g, sum(dc / dt) FILTER (dc >= 0 AND dt > 0) AS c FROM (SELECT 'agg' AS scope, * FROM d UNION ALL SELECT role, * FROM d) GROUP BY ALL),
    m AS (SELECT scope, ts, coalesce(sum(value) FILTER (metric = 'view'), 0)::DOUBLE AS running, coalesce(sum(value) FILTER (metric = 'click'), 0)::DOUBLE AS waiting,
        max(value) FILTER (metric = 'view') AS rmax, avg(value) FILTER (metric = 'view') AS ravg, max(value) FILTER (metric = 'click') AS wmax, avg(value) FILTER (metric = 'click') AS wavg FROM two WHERE metric IN ('view', 'click') GROUP BY ALL)
    SELECT scope, ts, running AS running_requests, waiting AS waiting_requests, CASE WHEN running IS NOT NULL THEN round(coalesce((rmax - ravg) / nullif(ravg, 0), 0), 6) + 0 END AS running_imbalance,
        CASE WHEN running IS NOT NULL THEN round(coalesce((wmax - wavg) / nullif(wavg, 0), 0), 6) + 0 END AS waiting_imbalance, NULL::DOUBLE AS kv_cache_usage_mean, NULL::DOUBLE AS kv_cache_usage_max, NULL::DOUBLE AS prefix_cache_hit_rate,
        round(CASE scope WHEN 'prefill' THEN p WHEN 'decode' THEN g ELSE coalesce(p + g, p, g) END, 6) + 0 AS throughput, NULL::DOUBLE AS avg_time_seconds, round(c, 6) + 0 AS completed_requests
    FROM m FULL JOIN r USING (scope, ts)""")
def w4_scope_metrics(spark, sf_dir):
    names = {"view": "running_requests", "click": "waiting_requests", "signup": "prompt_tokens_total", "error": "generation_tokens_total", "purchase": "request_success_total"}
    df = scrapes(spark, sf_dir).replace(names, subset=["metric"]).withColumn("value", F.col("value").cast("double"))
    rounded = ("running_imbalance", "waiting_imbalance", "throughput", "completed_requests")
    return ts.scope_metrics(df).withColumns({c: tidy(c, 6) for c in rounded})


@query(f"""WITH {SCRAPES}, g AS (SELECT ts, metric, sum(value)::DOUBLE AS value FROM scrapes GROUP BY ALL), a AS (SELECT ts, metric, CASE WHEN ts % 30 <> 0 THEN value END AS value FROM g),
    n AS (SELECT *, count(value) OVER (PARTITION BY metric ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a)
    SELECT ts, metric, round(avg(value) OVER (PARTITION BY metric ORDER BY n RANGE BETWEEN 19 PRECEDING AND CURRENT ROW), 6) + 0 AS smoothed FROM n""")
def w5_smoothed(spark, sf_dir):
    polls = scrapes(spark, sf_dir).groupBy("ts", "metric").agg(F.sum("value").cast("double").alias("value"))
    gaps = polls.withColumn("value", F.when(F.col("ts") % 30 != 0, F.col("value")))
    return ts.smoothed(gaps).select("ts", "metric", tidy("smoothed", 6).alias("smoothed"))


@query(f"""WITH {ROLLOUTS}, s AS (SELECT env_name, step, sum(len)::BIGINT AS tokens FROM rollouts GROUP BY ALL),
    w AS (SELECT *, step - first(step) OVER w AS span, sum(tokens) OVER w - first(tokens) OVER w AS inside FROM s WINDOW w AS (PARTITION BY env_name ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT env_name, step, CASE WHEN span > 0 THEN inside / span END AS tokens_per_second FROM w""")
def a38_throughput(spark, sf_dir):
    steps = rollouts(spark, sf_dir).groupBy("env_name", "step").agg(F.sum("len").alias("tokens"))
    return ts.throughput(steps, ["env_name"], ts="step").select("env_name", "step", "tokens_per_second")


@query(f"""WITH {ROLLOUTS}, t AS (SELECT step, policy_version AS adapter, sum(len)::BIGINT AS tokens FROM rollouts GROUP BY ALL),
    e AS (SELECT *, sum(tokens) OVER (PARTITION BY step ORDER BY adapter ROWS UNBOUNDED PRECEDING) AS stop FROM t), x AS (SELECT *, unnest(range(4)) AS chunk FROM e)
    SELECT step, adapter, chunk::INT AS chunk, (greatest(least(stop - chunk * 12000, 12000), 0) - greatest(least(stop - tokens - chunk * 12000, 12000), 0))::BIGINT AS chunk_tokens FROM x""")
def w9_chunk_adapter_tokens(spark, sf_dir):
    tokens = rollouts(spark, sf_dir).groupBy("step", F.col("policy_version").alias("adapter")).agg(F.sum("len").alias("tokens"))
    return ts.chunk_adapter_tokens(tokens, 12000, 4, ["step"]).select("step", "adapter", "chunk", "chunk_tokens")


@query(f"WITH {ROLLOUTS} SELECT min(step) FILTER (step > 37) AS next_step FROM rollouts")
def w10_next_step(spark, sf_dir):
    return ts.next_step(rollouts(spark, sf_dir), 37)


@query(f"""WITH {ROLLOUTS}, s AS (SELECT DISTINCT step FROM rollouts) SELECT step, 1.0::DOUBLE AS constant,
    round(CASE WHEN step < 10 THEN 0.1 + 0.9 * step / 10 WHEN step < 60 THEN 1.0 ELSE greatest(1.0 - 0.9 * (step - 60) / 39, 0.1) END, 9) + 0 AS linear,
    round(CASE WHEN step < 10 THEN 1e-8 + (1 - 1e-8) * step / 10 ELSE 0.5 * (1 + cos(pi() * least((step - 10) / 90, 1.0))) END, 9) + 0 AS cosine FROM s""")
def w11_schedules(spark, sf_dir):
    step = F.col("step")
    return rollouts(spark, sf_dir).select("step").distinct().select(
        "step", ts.constant_schedule(step).alias("constant"), tidy(ts.linear_schedule(step, 10, 40, 100, 0.1), 9).alias("linear"), tidy(ts.cosine_schedule(step, 10, 100), 9).alias("cosine")
    )
