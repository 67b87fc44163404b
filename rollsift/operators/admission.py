"""Admission by rate: a token bucket over a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.operators.scans import scanned


def rate_limited(df: DataFrame, keys: list[str], time: str, order: list[str], cost: str, rate: int, capacity: int) -> DataFrame:
    """Adds ``level``, what a key's bucket holds after each event, and ``wait``, the time units until the event may go on.

    The bucket is full at the key's first event, gains ``rate`` a time unit up to ``capacity``, and pays each event's cost;
    a level under zero is a debt that the event waits for, rounded up. One event turns a level x into
    min(capacity, x + rate * passed) - cost, and such functions compose to one of their kind: with s, the tokens gained
    less those paid, the level is s + min over the events so far of (capacity - cost - s). So it takes a running sum and a
    running minimum, both in two levels, and no key's events meet in a task. Whole numbers; a null cost is none."""
    names = df.columns
    paid = F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long"))
    sums = scanned(df.withColumn("_paid", paid), keys, [time, *order], sums={"_before": "_paid"})
    gained = sums.withColumn("_s", F.lit(rate) * F.col(time).cast("long") - F.col("_before") - F.col("_paid")).withColumn("_room", F.lit(capacity) - F.col("_paid") - F.col("_s"))
    level = scanned(gained, keys, [time, *order], mins={"_least": "_room"}).withColumn("level", F.col("_s") + F.col("_least"))
    return level.select(*names, "level", F.greatest(F.ceil(-F.col("level") / F.lit(rate)), F.lit(0)).cast("long").alias("wait"))
