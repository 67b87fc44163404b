"""Rates, ratios and rolling means of scraped counters, and schedules by step.

A scrape is a long row (endpoint, role, engine, ts, metric, value). Every
operator windows over one endpoint's or one key's own history, so histories are
the unit of parallelism and nothing is sorted globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMOOTHING = 20
PREFILL, DECODE, AGGREGATE = "prefill", "decode", "agg"


def endpoint_values(scrapes: DataFrame, metrics: list[str]) -> DataFrame:
    """(endpoint, role, ts, a column for each metric): engines summed."""
    chosen = scrapes.where(F.col("metric").isin(metrics))
    return chosen.groupBy("endpoint", "role", "ts").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def _deltas(df: DataFrame, metrics: list[str]) -> DataFrame:
    w = W.partitionBy("endpoint").orderBy("ts")
    for m in metrics:
        df = df.withColumn(f"d_{m}", F.col(m) - F.lag(m).over(w))
    return df.withColumn("d_ts", F.col("ts") - F.lag("ts").over(w))


def counter_rate(scrapes: DataFrame, metric: str, keys: list[str] = ()) -> DataFrame:
    """Per poll, the sum of the endpoints' rates; endpoints without a previous poll, or reset, are skipped."""
    d = _deltas(endpoint_values(scrapes, [metric]), [metric])
    valid = (F.col("d_ts") > 0) & (F.col(f"d_{metric}") >= 0)
    return d.groupBy("ts", *keys).agg(F.sum(F.when(valid, F.col(f"d_{metric}") / F.col("d_ts"))).alias("rate"))


def counter_ratio(scrapes: DataFrame, numerator: str, denominator: str, keys: list[str] = ()) -> DataFrame:
    """Per poll, summed deltas of one counter over those of another; null unless the latter is positive."""
    d = _deltas(endpoint_values(scrapes, [numerator, denominator]), [numerator, denominator])
    a, b = F.col(f"d_{numerator}"), F.col(f"d_{denominator}")
    valid = (a >= 0) & (b >= 0)
    sums = d.groupBy("ts", *keys).agg(F.sum(F.when(valid, a)).alias("a"), F.sum(F.when(valid, b)).alias("b"))
    return sums.select("ts", *keys, F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio"))


def histogram_average(scrapes: DataFrame, name: str, keys: list[str] = ()) -> DataFrame:
    """Average of the observations since the last poll, from a histogram's sum and count."""
    return counter_ratio(scrapes, f"{name}_sum", f"{name}_count", keys).withColumnRenamed("ratio", "average")


def scope_rows(scrapes: DataFrame) -> DataFrame:
    """Rows of scope agg, and of prefill and decode where a poll has endpoints of both roles."""
    roles = scrapes.groupBy("ts").agg((F.array_size(F.array_intersect(F.collect_set("role"), F.array(F.lit(PREFILL), F.lit(DECODE)))) == 2).alias("_both"))
    scoped = scrapes.join(roles, "ts").withColumn("scope", F.explode(F.when(F.col("_both") & F.col("role").isin(PREFILL, DECODE), F.array(F.lit(AGGREGATE), F.col("role"))).otherwise(F.array(F.lit(AGGREGATE)))))
    return scoped.drop("_both")


def scope_metrics(scrapes: DataFrame) -> DataFrame:
    """(scope, ts, gauges, cache hit rate, throughput, average time) per poll; counters as deltas.

    One shuffle to endpoints, one to scopes."""
    counters = [
        "prompt_tokens_total", "generation_tokens_total", "request_success_total", "prefix_cache_hits", "prefix_cache_queries",
        "request_prefill_time_seconds_sum", "request_prefill_time_seconds_count", "request_decode_time_seconds_sum", "request_decode_time_seconds_count",
    ]
    d = _deltas(endpoint_values(scrapes, counters), counters)
    moved = scope_rows(d.withColumn("role", F.col("role")))

    def rate(m: str) -> Column:
        ok = (F.col("d_ts") > 0) & (F.col(f"d_{m}") >= 0)
        return F.sum(F.when(ok, F.col(f"d_{m}") / F.col("d_ts")))

    def ratio(a: str, b: str) -> Column:
        ok = (F.col(f"d_{a}") >= 0) & (F.col(f"d_{b}") >= 0)
        over, under = F.sum(F.when(ok, F.col(f"d_{a}"))), F.sum(F.when(ok, F.col(f"d_{b}")))
        return F.when(under > 0, over / under)

    rates = moved.groupBy("scope", "ts").agg(
        rate("prompt_tokens_total").alias("_p"), rate("generation_tokens_total").alias("_g"), rate("request_success_total").alias("completed_requests"),
        ratio("prefix_cache_hits", "prefix_cache_queries").alias("_hit"),
        ratio("request_prefill_time_seconds_sum", "request_prefill_time_seconds_count").alias("_tp"),
        ratio("request_decode_time_seconds_sum", "request_decode_time_seconds_count").alias("_td"),
    )
    gauges = scope_rows(scrapes.where(F.col("metric").isin("running_requests", "waiting_requests", "kv_cache_usage_perc", "gpu_prefix_cache_hit_rate")))
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    vio = lambda m: F.coalesce(F.when(F.avg(of(m)) != 0, (F.max(of(m)) - F.avg(of(m))) / F.avg(of(m))), F.lit(0.0))
    g = gauges.groupBy("scope", "ts").agg(
        F.coalesce(F.sum(of("running_requests")), F.lit(0.0)).alias("running_requests"), F.coalesce(F.sum(of("waiting_requests")), F.lit(0.0)).alias("waiting_requests"),
        vio("running_requests").alias("running_imbalance"), vio("waiting_requests").alias("waiting_imbalance"),
        F.avg(of("kv_cache_usage_perc")).alias("kv_cache_usage_mean"), F.max(of("kv_cache_usage_perc")).alias("kv_cache_usage_max"),
        F.avg(of("gpu_prefix_cache_hit_rate")).alias("_hit_gauge"),
    )
    both = lambda a, b, how: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(how(F.col(a), F.col(b)))
    throughput = F.when(F.col("scope") == PREFILL, F.col("_p")).when(F.col("scope") == DECODE, F.col("_g")).otherwise(both("_p", "_g", lambda a, b: a + b))
    time = F.when(F.col("scope") == PREFILL, F.col("_tp")).when(F.col("scope") == DECODE, F.col("_td")).otherwise(both("_tp", "_td", lambda a, b: (a + b) / 2))
    out = g.join(rates, ["scope", "ts"], "full")
    return out.select(
        "scope", "ts", "running_requests", "waiting_requests", "running_imbalance", "waiting_imbalance", "kv_cache_usage_mean", "kv_cache_usage_max",
        F.coalesce("_hit", "_hit_gauge").alias("prefix_cache_hit_rate"), throughput.alias("throughput"), time.alias("avg_time_seconds"), "completed_requests",
    )


def smoothed(metrics: DataFrame, keys: list[str] = ("metric",), order: str = "ts", value: str = "value", window: int = SMOOTHING) -> DataFrame:
    """Mean of the key's last ``window`` observations; a poll without one repeats the last mean.

    metrics: a row for each poll and key, null where the key is absent."""
    seen = W.partitionBy(*keys).orderBy(order)
    ranked = metrics.withColumn("_n", F.count(value).over(seen.rowsBetween(W.unboundedPreceding, 0)))
    # a window over observation numbers, not over polls: absent polls share the number of the last one
    recent = W.partitionBy(*keys).orderBy("_n").rangeBetween(-(window - 1), 0)
    return ranked.withColumn("smoothed", F.avg(value).over(recent)).drop("_n")


def throughput(df: DataFrame, keys: list[str], ts: str = "ts", tokens: str = "tokens", window: int = 10) -> DataFrame:
    """Tokens a second over the last ``window`` steps: the first step's tokens lie before the span."""
    w = W.partitionBy(*keys).orderBy(ts)
    span = F.col(ts) - F.first(ts).over(w.rowsBetween(-(window - 1), 0))
    inside = F.sum(tokens).over(w.rowsBetween(-(window - 1), 0)) - F.first(tokens).over(w.rowsBetween(-(window - 1), 0))
    return df.withColumn("tokens_per_second", F.when(span > 0, inside / span))


def chunk_adapter_tokens(df: DataFrame, chunk: int, n_chunks: int, keys: list[str], adapter: str = "adapter", tokens: str = "tokens") -> DataFrame:
    """Tokens of each adapter in each context-parallel chunk: running sums clipped to the chunk."""
    w = W.partitionBy(*keys).orderBy(adapter).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(tokens).over(w)
    rows = df.withColumn("_end", end).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    clip = lambda x: F.greatest(F.least(x - F.col("chunk") * chunk, F.lit(chunk)), F.lit(0))
    return rows.withColumn("chunk_tokens", clip(F.col("_end")) - clip(F.col("_end") - F.col(tokens))).drop("_end")


def next_step(steps: DataFrame, last: int, step: str = "step") -> DataFrame:
    """The smallest step after ``last``; null if none."""
    return steps.agg(F.min(F.when(F.col(step) > last, F.col(step))).alias("next_step"))


def constant_schedule(step: Column) -> Column:
    return F.lit(1.0)


def linear_schedule(step: Column, warmup: int, decay: int, total: int, low: float = 0.0) -> Column:
    """Factor on the learning rate: up from ``low``, flat, down to ``low`` over the last ``decay`` steps."""
    start = low if low > 0 else 1e-8
    up = F.lit(start) + (1 - start) * step / max(warmup, 1)
    begin = total - decay
    down = F.lit(1.0) - (1 - low) * (step - begin) / max(decay - 1, 1)
    return F.when(step < warmup, up).when(step < begin, F.lit(1.0)).otherwise(F.greatest(down, F.lit(low)))


def cosine_schedule(step: Column, warmup: int, total: int, low: float = 0.0) -> Column:
    start = low if low > 0 else 1e-8
    up = F.lit(start) + (1 - start) * step / max(warmup, 1)
    at = F.least((step - warmup) / max(total - warmup, 1), F.lit(1.0))
    return F.when(step < warmup, up).otherwise(low + (1 - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * at)))
