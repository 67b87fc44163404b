"""Set differences, previous rows and positional pairings as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollsift.functions.arrays import field
from rollsift.operators.scans import scanned


def changes(discovered: DataFrame, known: DataFrame, key: str, evicted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, deleted) keys; evicted ones aren't discovered."""
    found = discovered.select(key).distinct()
    if evicted is not None:
        found = found.join(evicted.select(key), key, "left_anti")
    had = known.select(key).distinct()
    return found.join(had, key, "left_anti"), had.join(found, key, "left_anti")


def stable_steps(steps: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Steps that have a marker."""
    return steps.join(markers.select(*keys), keys, "left_semi")


def latest_step(steps: DataFrame, step: str = "step") -> DataFrame:
    return steps.agg(F.max(step).alias("latest_step"))


def paired_by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Left and right rows of a key, matched by their places in it."""
    at = lambda df, order: df.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return at(left, left_order).join(at(right, right_order), [*keys, "_at"]).drop("_at")


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the same key's previous values."""
    return scanned(df, keys, [order], previous={f"previous_{c}": c for c in columns})


def env_union(*frames: DataFrame, env: str = "env_name") -> DataFrame:
    """Distinct environments of all frames."""
    out = frames[0].select(env)
    for f in frames[1:]:
        out = out.unionByName(f.select(env))
    return out.distinct()


def to_columns(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a key to one row of aligned arrays."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    return packed.select(*keys, *[F.transform("_rows", field(c)).alias(c) for c in rest])


def to_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned arrays to rows with their place."""
    rest = [c for c in df.columns if c not in keys]
    exploded = df.select(*keys, F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in rest])).alias("position", "_row"))
    return exploded.select(*keys, "position", *[F.col(f"_row.{c}").alias(c) for c in rest])


def merged_columns(required: list[str], extra: list[str]) -> list[str]:
    """State columns, required ones first, each once."""
    return list(dict.fromkeys([*required, *extra]))


def concatenated_items(df: DataFrame, keys: list[str], order: str, items: str = "items") -> DataFrame:
    """Each key's lists one after the other in the order of their rows; equal items stay as often as they come."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(items, F.array().cast(df.schema[items].dataType)).alias(items))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(rows, field(items))).alias(items))


def discovered_runs(paths: DataFrame, evicted: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Names of the folders ``run_*`` directly under the output folder, but for evicted ones."""
    found = paths.select(F.regexp_extract(path, r"(?:^|/)(run_[^/]+)(?:/|$)", 1).alias("run_id")).where("run_id <> ''").distinct()
    return found if evicted is None else found.join(evicted.select("run_id"), "run_id", "left_anti")


def with_markers(expected: DataFrame, arrived: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Arrived rows, and for each expected member that has none a row with an error, so that groups always complete.

    expected: keys and ``cancelled``. A member is marked once, however often it is expected or comes."""
    asked = expected.groupBy(*keys).agg(F.max("cancelled").alias("cancelled"))
    missing = asked.join(arrived.select(*keys).distinct(), keys, "left_anti")
    marks = missing.withColumn(error, F.when(F.col("cancelled"), F.lit("Cancelled")).otherwise(F.lit("EmptyTrajectory"))).drop("cancelled")
    return arrived.unionByName(marks, allowMissingColumns=True)
