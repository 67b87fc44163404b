"""The driver's tables seen as rollouts, samples, scrapes and chats, with the same views in SQL.

Amounts are taken in whole cents, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(column, digits: int = 0):
    """Rounded, and never minus zero."""
    return F.round(column, digits) + F.lit(0.0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in groups of four: rewards, errors, lengths, versions."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    group = F.floor(F.col("event_id") / 4).cast("long")
    return e.select(
        F.col("event_id").alias("rollout_id"), group.alias("group_id"), F.concat(F.lit("env"), (group % 3).cast("string")).alias("env_name"), (group % 50).alias("example_id"),
        (group % 4).alias("eval_step"), F.floor(F.col("event_id") / 100).cast("long").alias("step"), "cents", (F.col("cents") % 2).cast("double").alias("reward"),
        (F.col("cents") % 1000 + 1).alias("len"), (F.col("cents") % 5 + 1).alias("num_turns"), (F.col("cents") % 10).alias("policy_version"),
        (F.col("cents") % 7 == 0).alias("is_truncated"),
        F.when(F.col("cents") % 4 == 1, "stop").when(F.col("cents") % 4 == 2, "length").when(F.col("cents") % 4 == 3, "prompt_too_long").alias("stop_condition"),
        F.when(F.col("cents") % 35 == 0, "Cancelled").when(F.col("cents") % 11 == 0, "Failed").alias("error"), F.lower("event_type").alias("kind"),
    )


ROLLOUTS = """rollouts AS (
    SELECT event_id AS rollout_id, event_id // 4 AS group_id, 'env' || ((event_id // 4) % 3) AS env_name, (event_id // 4) % 50 AS example_id,
           (event_id // 4) % 4 AS eval_step, event_id // 100 AS step, cents, (cents % 2)::DOUBLE AS reward, cents % 1000 + 1 AS len, cents % 5 + 1 AS num_turns,
           cents % 10 AS policy_version, cents % 7 = 0 AS is_truncated,
           CASE cents % 4 WHEN 1 THEN 'stop' WHEN 2 THEN 'length' WHEN 3 THEN 'prompt_too_long' END AS stop_condition,
           CASE WHEN cents % 35 = 0 THEN 'Cancelled' WHEN cents % 11 = 0 THEN 'Failed' END AS error, lower(event_type) AS kind
    FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events))"""

SCOPED = "scoped AS (SELECT 'all' AS scope, * FROM rollouts UNION ALL SELECT env_name, * FROM rollouts)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line items as the tokens of a sequence: ids, masks and log probabilities in line order."""
    items = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct(
            F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("token"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("q"),
            F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.round(F.col("l_tax") * 100).cast("long").alias("t"), F.col("l_returnflag").alias("flag"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        ).alias("x"),
    )
    return items.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))


SEQUENCES = """items AS (
    SELECT l_orderkey AS id, l_linenumber::BIGINT AS n, l_partkey AS token, l_suppkey AS supp, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d,
           round(l_tax * 100)::BIGINT AS t, l_returnflag AS flag, round(l_extendedprice * 100)::BIGINT AS price FROM lineitem),
    places AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, token, supp, q, d, t, flag, price) AS pos, count(*) OVER (PARTITION BY id) AS size FROM items)"""


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of five endpoints: a value for each engine and metric."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    part = e.groupBy(
        F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string")).alias("endpoint"), F.when(F.col("user_id") % 5 < 2, "prefill").otherwise("decode").alias("role"),
        F.concat(F.lit("g"), (F.col("user_id") % 2).cast("string")).alias("engine"), (F.floor(F.col("event_id") / 200) * 10).cast("long").alias("ts"), F.col("event_type").alias("metric"),
    )
    return part.agg(F.sum("cents").alias("value"))


SCRAPES = """scrapes AS (
    SELECT 'e' || (user_id % 5) AS endpoint, CASE WHEN user_id % 5 < 2 THEN 'prefill' ELSE 'decode' END AS role, 'g' || (user_id % 2) AS engine,
           event_id // 200 * 10 AS ts, event_type AS metric, sum(round(value * 100)::BIGINT)::BIGINT AS value FROM events GROUP BY ALL)"""


def deltas_sql(*metrics: str) -> str:
    """CTEs with each endpoint's summed metrics and their changes since its previous poll."""
    sums = ", ".join(f"sum(value) FILTER (metric = '{m}') AS {m}" for m in metrics)
    lags = ", ".join(f"{m} - lag({m}) OVER w AS d_{m}" for m in metrics)
    names = ", ".join(f"'{m}'" for m in metrics)
    return f"""{SCRAPES}, endpoints AS (SELECT endpoint, role, ts, {sums} FROM scrapes WHERE metric IN ({names}) GROUP BY ALL),
        deltas AS (SELECT *, {lags}, ts - lag(ts) OVER w AS d_ts FROM endpoints WINDOW w AS (PARTITION BY endpoint ORDER BY ts))"""
