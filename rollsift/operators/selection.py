"""Rows with the smallest values, by histograms: exact, without a sort and without a task that sees the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsift.operators.scans import dense_index

#: Bits that a round of the histogram tells apart; a round sends as many counts as that has values, 4096, to the driver.
ROUND_BITS = 12


def bound(df: DataFrame, value: Column, k: int, bits: int) -> tuple[int, int]:
    """(bound, left): values under the bound are among the k smallest, and so are ``left`` rows at it.

    value: whole numbers of ``bits`` bits, not negative. Each round counts, inside the range that holds the k-th value,
    its parts; it ends early where a part ends with the k-th row."""
    prefix, left, shift = 0, k, bits
    rows = df.select(value.alias("v"))
    while shift > 0:
        step = min(ROUND_BITS, shift)
        inside = rows if shift == bits else rows.where(F.shiftright("v", shift) == prefix)
        shift -= step
        counts = inside.groupBy(F.shiftright("v", shift).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        for part, n in counts:
            if n >= left:
                prefix = part
                break
            left -= n
        if n == left:
            return (prefix + 1) << shift, 0
    return prefix, left


def smallest(df: DataFrame, value: Column, k: int, bits: int, order: str) -> DataFrame:
    """The k rows with the smallest values; rows of the value at the bound by ``order``, and then as they come."""
    if k <= 0:
        return df.limit(0)
    at, left = bound(df, value, k, bits)
    under = df.where(value < at)
    if not left:
        return under
    ties = dense_index(df.where(value == at), order, "_tie_at")
    return under.unionByName(ties.where(F.col("_tie_at") < left).drop("_tie_at"))
