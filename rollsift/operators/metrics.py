"""Aggregations over rollouts, evaluations, tokens and benchmark runs.

Two scopes, "all" and each environment, come from one pass: rows are grouped by
(environment, group) first, which is the only shuffle of detail rows, and the
small result is rolled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollsift.functions.arrays import count_true, pass_at_k

ALL = "all"


def _scoped(df: DataFrame, env: str) -> DataFrame:
    """Each row once as "all" and once as its environment; "all" is no environment's name."""
    return df.withColumn("scope", F.explode(F.array(F.lit(ALL), F.col(env))))


def two_level_means(df: DataFrame, columns: list[str], env: str = "env_name", group: str = "group_id") -> DataFrame:
    """Mean, max and min over groups of the groups' means, for "all" and each environment.

    Sums and counts are kept per group, so that a group that spans environments is one group of "all"."""
    part = df.groupBy(env, group).agg(*[a for c in columns for a in (F.sum(F.col(c).cast("double")).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))])
    groups = _scoped(part, env).groupBy("scope", group).agg(*[(F.sum(f"{c}_s") / F.nullif(F.sum(f"{c}_n"), F.lit(0))).alias(c) for c in columns])
    return groups.groupBy("scope").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def solve_rates(df: DataFrame, sizes: DataFrame, env: str = "env_name", group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Shares of groups without and with only solved rows, and the rest, by scope.

    sizes: (env_name, group_size), a row for each environment; an unknown one is never all solved."""
    groups = df.groupBy(env, group).agg(F.sum(reward).alias("_sum")).join(sizes.select(F.col("env_name").alias(env), "group_size"), env, "left")
    flags = groups.select(env, (F.col("_sum") == 0).cast("double").alias("none"), F.coalesce((F.col("_sum") == F.col("group_size")).cast("double"), F.lit(0.0)).alias("every"))
    rates = _scoped(flags, env).groupBy("scope").agg(F.avg("none").alias("solve_none"), F.avg("every").alias("solve_all"))
    return rates.withColumn("effective", F.lit(1.0) - F.col("solve_none") - F.col("solve_all"))


def value_shares(df: DataFrame, column: str, env: str | None = None) -> DataFrame:
    """Share of each value among the non-null ones, by environment if one is named."""
    keys = [env] if env else []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("total")) if env else counts.agg(F.sum("n").alias("total"))
    joined = counts.join(whole, env) if env else counts.crossJoin(F.broadcast(whole))  # the total is one row
    return joined.select(*keys, column, (F.col("n") / F.col("total")).alias("share"))


def generation_truncated(truncated="is_truncated", stop="stop_condition") -> Column:
    """Truncated, and not because the prompt was too long; an unknown condition counts."""
    return F.col(truncated) & ~F.col(stop).eqNullSafe("prompt_too_long")


def filter_rates(df: DataFrame, names: list[str], hits: str = "filter_results", dropped: str = "is_filtered", env: str = "env_name") -> DataFrame:
    flag = lambda n: F.coalesce(F.try_element_at(F.col(hits), F.lit(n)), F.lit(False)).cast("double")
    return _scoped(df, env).groupBy("scope").agg(F.avg(F.col(dropped).cast("double")).alias("filtered"), *[F.avg(flag(n)).alias(n) for n in names])


def environment_metrics(df: DataFrame, metrics: str = "metrics", env: str = "env_name", group: str = "group_id") -> DataFrame:
    """Per environment and metric key, the mean of the groups' means; missing and NaN values are skipped."""
    long = df.select(env, group, F.explode(metrics).alias("key", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(env, group, "key").agg(F.avg("value").alias("value")).groupBy(env, "key").agg(F.avg("value").alias("value"))


def totals(df: DataFrame, tokens: list[str], env: str = "env_name", group: str = "group_id", example: str = "example_id") -> DataFrame:
    """Rows, distinct groups and problems (exact), and token sums, by scope."""
    return _scoped(df, env).groupBy("scope").agg(
        F.count("*").alias("samples"), F.countDistinct(group).alias("groups"), F.countDistinct(env, example).alias("problems"), *[F.sum(c).alias(c) for c in tokens]
    )


def prefill_decode(df: DataFrame, mask: str = "completion_mask", prompt: str = "prompt_ids", completion: str = "completion_ids") -> DataFrame:
    """decode: trainable completion tokens; prefill: all the others."""
    decode = count_true(mask).cast("long")
    return df.withColumn("decode_tokens", decode).withColumn("prefill_tokens", (F.size(prompt) + F.size(completion)).cast("long") - F.col("decode_tokens"))


def arrivals(df: DataFrame, batch: str = "batch_id", env: str = "env_name", error: str = "error") -> DataFrame:
    return df.groupBy(batch, env).agg(F.count("*").alias("arrived"), F.count(error).alias("errored"))


def eval_metrics(df: DataFrame, keys: list[str], reward: str = "reward", error: str = "error", tokens: str = "completion_len", turns: str = "num_turns", example: str = "example_id") -> DataFrame:
    """Totals, cancelled and errored rows, and statistics of the valid ones."""
    valid, when = F.col(error).isNull(), lambda c: F.when(F.col(error).isNull(), c)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(error) == "Cancelled").alias("cancelled"),
        F.count_if(F.col(error).isNotNull() & (F.col(error) != "Cancelled")).alias("errored"),
        F.avg(when(F.col(reward))).alias("reward_mean"),
        F.avg(when(F.col(tokens))).alias("len_mean"), F.max(when(F.col(tokens))).alias("len_max"), F.min(when(F.col(tokens))).alias("len_min"),
        F.avg(when(F.col("is_truncated").cast("double"))).alias("truncated"),
        F.avg(when((F.coalesce(F.col(tokens), F.lit(0)) == 0).cast("double"))).alias("no_response"),
        F.avg(when(F.col(turns))).alias("turns_mean"), F.min(when(F.col(turns))).alias("turns_min"), F.max(when(F.col(turns))).alias("turns_max"),
        F.countDistinct(F.when(valid, F.col(example))).alias("examples"),
    )


def pass_at_k_by_example(df: DataFrame, keys: list[str], example: str = "example_id", reward: str = "reward", largest: int | None = None) -> DataFrame:
    """keys, k, pass_at_k: means over the examples with k rows or more, k = 1, 2, 4, ... (up to ``largest``, if given)

    Nothing for a key that has rewards other than 0 and 1."""
    per = df.groupBy(*keys, example).agg(F.count("*").alias("n"), F.count_if(F.col(reward) == 1).alias("c"), F.bool_and(F.coalesce(F.col(reward).isin(0.0, 1.0), F.lit(False))).alias("binary"))
    gate = per.groupBy(*keys).agg(F.bool_and("binary").alias("ok")).where("ok").drop("ok")
    ks = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    each = per.join(gate, keys).withColumn("k", F.explode(ks))
    if largest is not None:
        each = each.where(F.col("k") <= largest)
    return each.groupBy(*keys, "k").agg(F.avg(pass_at_k("n", "c", "k")).alias("pass_at_k"))


def policy_versions(df: DataFrame, keys: list[str], version: str = "policy_version") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(version).alias("policy_version"), (F.countDistinct(version) > 1).alias("mixed"))


def step_summary(df: DataFrame, step: str = "step", env: str = "env_name") -> DataFrame:
    """The log line of a step: means, trainable and error shares, largest staleness; by scope."""
    return _scoped(df, env).groupBy(step, "scope").agg(
        F.avg("reward").alias("reward"), F.avg((~F.col("is_filtered") & F.col("error").isNull()).cast("double")).alias("trainable"),
        F.avg("num_turns").alias("turns"), F.max("off_policy_steps").alias("max_off_policy"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("errors"), F.avg(F.col("is_truncated").cast("double")).alias("truncated"),
    )


def token_statistics(df: DataFrame, fields: list[str], mask: str = "loss_mask", keys: list[str] = ()) -> DataFrame:
    """Mean and max of each field over masked tokens with finite values."""
    stats = []
    for f in fields:
        kept = F.filter(F.zip_with(F.col(f), F.col(mask), lambda v, m: F.when(m, v.cast("double"))), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        stats.append(F.struct(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(kept).alias("n"), F.array_max(kept).alias("x")).alias(f))
    rows = df.select(*keys, *stats)
    aggs = [a for f in fields for a in ((F.sum(f"{f}.s") / F.nullif(F.sum(f"{f}.n"), F.lit(0))).alias(f"{f}_mean"), F.max(f"{f}.x").alias(f"{f}_max"))]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def distribution(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Mean, lower median, sample deviation, min and max; null where undefined."""
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def token_means_by_environment(df: DataFrame, fields: list[str], env: str = "env_names", mask: str = "loss_mask") -> DataFrame:
    """Means over masked tokens for "all" and each token's environment."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in (*fields, env, mask)])
    toks = df.select(F.explode(zipped).alias("t")).where(F.col(f"t.{mask}"))
    part = toks.groupBy(F.col(f"t.{env}").alias("env")).agg(*[a for f in fields for a in (F.sum(f"t.{f}").alias(f"{f}_s"), F.count(f"t.{f}").alias(f"{f}_n"))])
    return _scoped(part, "env").groupBy("scope").agg(*[(F.sum(f"{f}_s") / F.nullif(F.sum(f"{f}_n"), F.lit(0))).alias(f) for f in fields])


def kl_entropy_ratio(kl: Column, entropy: Column) -> Column:
    """Aggregate: mean divergence over mean entropy, null unless the latter is positive."""
    return F.when(F.avg(entropy) > 0, F.avg(kl) / F.avg(entropy))


def validation_loss(df: DataFrame, keys: list[str], loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """Token-weighted mean without NaN batches, and how many there were; NaN without tokens."""
    nan = F.isnan(loss)
    n = F.sum(F.when(nan, 0).otherwise(F.col(tokens)))
    total = F.sum(F.when(nan, 0.0).otherwise(F.col(loss) * F.col(tokens)))
    aggs = [F.when(n > 0, total / n).otherwise(F.lit(float("nan"))).alias("loss"), F.count_if(nan).alias("nan_batches")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def progress_shares(df: DataFrame, subset: str = "__subset", split: str = "__split", tokens: str = "tokens") -> DataFrame:
    """Shares of samples and tokens by subset; nothing when there is one subset."""
    key = F.coalesce(F.nullif(F.col(subset), F.lit("")), F.col(split)).alias("key")
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(tokens).alias("t"))
    whole = counts.agg(F.sum("n").alias("tn"), F.sum("t").alias("tt"), F.count("*").alias("keys"))
    joined = counts.crossJoin(F.broadcast(whole)).where("keys > 1")  # one row of totals
    return joined.select("key", (F.col("n") / F.col("tn")).alias("sample_share"), (F.col("t") / F.col("tt")).alias("token_share"))


def max_violation(value: Column) -> Column:
    """Aggregate: (max - mean) / mean, 0 without rows or for a zero mean."""
    return F.coalesce(F.when(F.avg(value) != 0, (F.max(value) - F.avg(value)) / F.avg(value)), F.lit(0.0))


def load_balance(df: DataFrame, drop_top: int = 0, layer: str = "layer", load: str = "tokens", expert: str = "expert") -> DataFrame:
    """Max violation of expert loads by layer, without the ``drop_top`` most loaded."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(layer).orderBy(F.desc(load), expert)))
    return ranked.where(F.col("_r") > drop_top).groupBy(layer).agg(max_violation(F.col(load)).alias("max_vio"))


def mean_normalised(df: DataFrame, value: str, keys: list[str], out: str = "share") -> DataFrame:
    """Each value over its partition's sum; 0 where that isn't positive."""
    whole = F.sum(value).over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(whole > 0, F.col(value) / whole).otherwise(0.0))


def benchmark_description(df: DataFrame, metrics: list[str], keys: list[str], step: str = "step") -> DataFrame:
    """Mean, deviation, min and max without each run's first step."""
    first = F.min(step).over(W.partitionBy(*keys))
    kept = df.withColumn("_first", first).where(F.col(step) > F.col("_first"))
    return kept.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def regression_check(df: DataFrame, value: str, baseline: str, tolerance: float, higher_is_better: bool = True, shown_from: float = 0.01) -> DataFrame:
    """relative change (null under ``shown_from`` or without baseline) and whether it is a regression."""
    v, b = F.col(value), F.col(baseline)
    known = b.isNotNull() & (b != 0)
    worse = v < b * (1 - tolerance) if higher_is_better else v > b * (1 + tolerance)
    change = (v - b) / b
    return df.withColumn("change", F.when(known & (F.abs(change) >= shown_from), change)).withColumn("regressed", known & worse)


def with_baseline(results: DataFrame, baselines: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """Results with the baseline of the same key; of equal keys the last by ``order`` counts."""
    last = baselines.groupBy(*key).agg(*[F.max_by(v, order).alias(f"baseline_{v}") for v in values])
    condition = [results[k].eqNullSafe(last[k]) for k in key]
    joined = results.join(last, condition, "left")
    return joined.select(*[results[c] for c in results.columns], *[F.col(f"baseline_{v}") for v in values])


def dense_counts(df: DataFrame, key_sets: dict[str, list]) -> DataFrame:
    """Counts of every combination of the listed keys, zeros included. The lists are the caller's, hence small."""
    spark, grid = df.sparkSession, None
    for name, values in key_sets.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    counts = df.groupBy(*key_sets).agg(F.count("*").alias("n"))
    return grid.join(counts, list(key_sets), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def in_flight(df: DataFrame, version_now: int, keys: list[str], version: str = "policy_version") -> DataFrame:
    age = F.lit(version_now) - F.col(version)
    return df.groupBy(*keys).agg(F.count("*").alias("in_flight"), F.max(age).alias("max_off_policy"), F.avg(age).alias("mean_off_policy"))


def run_gauges(runs: DataFrame, ready: str = "ready", active: str = "active") -> DataFrame:
    return runs.agg(F.count("*").alias("discovered"), F.count_if(active).alias("active"), F.count_if(ready).alias("ready"))


def packed_totals(df: DataFrame, run: str = "run_id", tokens: str = "tokens") -> DataFrame:
    return df.groupBy(run).agg(F.count("*").alias("samples"), F.sum(tokens).alias("tokens"))


def usage(prompt: Column, completion: Column) -> Column:
    """Token counts of one response."""
    p, c = F.size(prompt), F.size(completion)
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))


def completion_length(steps, ids: str = "completion_ids") -> Column:
    """Completion tokens over all steps; null ones count nothing."""
    return F.aggregate(F.col(steps) if isinstance(steps, str) else steps, F.lit(0), lambda acc, s: acc + F.coalesce(F.when(s[ids].isNotNull(), F.size(s[ids])), F.lit(0)))


def streak_failures(df: DataFrame, order: str, empty: str, limit: int = 10, keys: list[str] = ()) -> DataFrame:
    """Rows at which ``limit`` consecutive empty batches are complete (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(order)
    island = F.sum(F.when(F.col(empty), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("_island", island).withColumn("_run", F.sum(F.col(empty).cast("int")).over(W.partitionBy(*keys, "_island").orderBy(order)))
    return marked.where(F.col(empty) & (F.col("_run") >= limit)).drop("_island", "_run")


def pre_filter_rates(df: DataFrame, names: list[str], hits: str = "filter_results", dropped: str = "is_filtered") -> DataFrame:
    """One row over all rollouts that the filter before batching has seen: how many, the share it dropped, and for each
    filter the share that it hit among those."""
    gone = F.coalesce(F.col(dropped), F.lit(False))
    hit = lambda n: gone & F.coalesce(F.try_element_at(F.col(hits), F.lit(n)), F.lit(False))
    return df.agg(F.count("*").alias("seen"), F.avg(gone.cast("double")).alias("dropped_rate"), *[F.avg(hit(n).cast("double")).alias(f"{n}_rate") for n in names])


def routing_confidence(scores, k: int) -> Column:
    """Share of a token's routing scores that its k best experts hold; null without scores."""
    s = F.col(scores) if isinstance(scores, str) else scores
    add = lambda acc, x: acc + x.cast("double")
    whole = F.aggregate(s, F.lit(0.0), add)
    return F.when(whole != 0, F.aggregate(F.slice(F.sort_array(s, asc=False), 1, k), F.lit(0.0), add) / whole)


def utilisation(tokens_a_second, flops_a_token: float, peak_flops: float, devices: int = 1) -> Column:
    """Percent of the devices' peak that the training work takes."""
    t = F.col(tokens_a_second) if isinstance(tokens_a_second, str) else tokens_a_second
    return t * F.lit(100.0 * flops_a_token / (peak_flops * devices))


def stale_labels(before: DataFrame, now: DataFrame, label: str = "run_id") -> DataFrame:
    """Labels whose gauges are to be taken off: they had a row and have none now."""
    return before.select(label).distinct().join(now.select(label), label, "left_anti")
