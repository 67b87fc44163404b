"""Scans in two levels: places, sums, previous values and restarting sums along an order, with no key in one task.

Rows are cut into ranges of (keys, order) and written once, so that every later step sees the same ranges. A scan runs
inside each range, then over one row for each key and range, and the second result is carried into the first. Rows of
equal order keep one order among themselves, that of the written table. Null keys are a key, null orders come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.sources.scratch import written


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows with their range ``_part`` and their place in it ``_at``; a value of any number of rows may span ranges."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_mono", F.monotonically_increasing_id())
    return written(cut.withColumn("_part", F.shiftright("_mono", 33)).withColumn("_at", F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_mono", "_tie"), "ranges")


def dense_index(df: DataFrame, order: str | Column | list, out: str) -> DataFrame:
    """0, 1, ... by ``order``, each once."""
    rows = ranged(df, order if isinstance(order, list) else [order])
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part", "left").select(*[c for c in df.columns if c != out], (F.col("_at") + F.col("_before")).alias(out))


def scanned(df: DataFrame, keys: list[str], order: list[str], at: str | None = None, size: str | None = None, sums: dict[str, str] | None = None, previous: dict[str, str] | None = None, mins: dict[str, str] | None = None) -> DataFrame:
    """Adds what asks for a key's rows in order: ``at`` (place from 0), ``size`` (rows of the key), ``sums`` (name:
    column; the sum over the earlier rows), ``mins`` (name: column; the least value so far, the row's own included) and
    ``previous`` (name: column; the value of the row before, null at the first)."""
    sums, previous, mins = sums or {}, previous or {}, mins or {}
    names = df.columns
    rows = ranged(df, [*keys, *order]).withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))
    w = W.partitionBy("_part", "_key").orderBy("_at")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_row", F.row_number().over(w).cast("long") - 1)
    for o, c in sums.items():
        inside = inside.withColumn(o, F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")))
    for o, c in previous.items():
        inside = inside.withColumn(o, F.lag(c).over(w))
    for o, c in mins.items():
        inside = inside.withColumn(o, F.min(c).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = [F.max_by(c, "_at").alias(f"_last_{o}") for o, c in previous.items()] + [F.min(c).alias(f"_min_{o}") for o, c in mins.items()]
    blocks = rows.groupBy("_part", "_key").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()], *last)
    over = W.partitionBy("_key").orderBy("_part")  # a row for each range that holds the key
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        F.col("_part").alias("_p"), F.col("_key").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.sum("_n").over(W.partitionBy("_key")).alias("_size"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums], *[F.lag(f"_last_{o}").over(over).alias(f"_carry_{o}") for o in previous],
        *[F.min(f"_min_{o}").over(before).alias(f"_least_{o}") for o in mins],
    )
    # the rows are already dealt by (_part, _key), so that only the blocks move
    met = inside.join(carried.hint("shuffle_hash"), (F.col("_part") == F.col("_p")) & (F.col("_key") == F.col("_k")))
    out = [*names]
    values = []
    if at:
        values.append((F.col("_rows") + F.col("_row")).alias(at))
    if size:
        values.append(F.col("_size").alias(size))
    values += [(F.col(o) + F.col(f"_before_{o}")).alias(o) for o in sums]
    values += [F.least(o, f"_least_{o}").alias(o) for o in mins]
    values += [F.when(F.col("_row") == 0, F.col(f"_carry_{o}")).otherwise(F.col(o)).alias(o) for o in previous]
    return met.select(*out, *values)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _segments(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, tokens, sums of the earlier tokens of the range) of a range's keys, by rows in order."""
    key, tokens = table["_kh"].to_numpy(), table["_tokens"].to_numpy()
    begins = _starts(key)
    return begins, np.r_[begins[1:], len(key)].astype(np.int64), tokens, np.cumsum(tokens) - tokens


def _next_cut(begins: np.ndarray, ends: np.ndarray, sums: np.ndarray, budget: int) -> np.ndarray:
    """For a batch that starts at a row: the first row that it leaves out, or the end of the row's segment."""
    end = np.repeat(ends, ends - begins)
    return np.minimum(np.searchsorted(sums, sums + budget, side="left"), end)


def restarting(df: DataFrame, budget: int, keys: list[str], order: list[str], tokens: str, batch: str = "batch_id", before: str | None = None) -> DataFrame:
    """Shortest runs of a key's rows with ``budget`` tokens or more, each starting afresh: ``batch`` numbers them from 0,
    ``before`` is what the run holds before the row. Rows of the last, incomplete run are left out.

    A range's rows give, for each row where a run may enter it, the tokens that the last run inside still lacks at its
    end and the number of runs; those are the rows before the sum passes the budget. The second level walks these
    summaries, a row for each key and range, and hands each range its true entry. Null tokens count as none; negative
    ones are refused."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    names = df.columns
    rows = ranged(df.withColumn("_tokens", F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long"))), [*keys, *order])
    key = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    narrow = rows.select("_part", "_at", "_tokens", F.xxhash64(F.struct(*keys)).alias("_kh") if keys else F.lit(0).cast("long").alias("_kh"), *key)
    key_fields = [f for f in narrow.schema.fields if f.name.startswith("_key")]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    summary = T.StructType([T.StructField("_part", long), T.StructField("_first", long), T.StructField("_kh", long), *key_fields, T.StructField("total", long), T.StructField("sums", longs), T.StructField("lacks", longs), T.StructField("runs", longs)])

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        begins, ends, held, sums = _segments(table)
        if len(held) and held.min() < 0:
            raise ValueError("negative tokens")
        after, runs = _next_cut(begins, ends, sums, budget), np.ones(len(held), np.int64)
        end = np.repeat(ends, ends - begins)
        at = np.arange(len(held))
        # the last run's start, by doubling: every row jumps to the start that its start jumps to
        jump, steps = np.where(after < end, after, at), np.where(after < end, 1, 0)
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            steps, jump = steps + steps[jump], further
        runs += steps
        out_sums, out_lacks, out_runs, totals = [], [], [], []
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            total = int(sums[e - 1] + held[e - 1] - sums[b])
            # rows where a run can enter: all up to the first that lies a budget behind the begin
            most = min(int(np.searchsorted(sums[b:e], sums[b] + budget, side="left")) + 1, e - b)
            inside = sums[b : b + most] - sums[b]
            out_sums.append(inside.tolist())
            out_lacks.append((sums[jump[b : b + most]] - sums[b] + budget - total).tolist())
            out_runs.append(runs[b : b + most].tolist())
            totals.append(total)
        firsts = table.take(pa.array(begins))
        columns = [firsts["_part"], firsts["_at"], firsts["_kh"], *[firsts[f.name] for f in key_fields], pa.array(totals, pa.int64())]
        return pa.Table.from_arrays([*columns, *[pa.array(x, pa.list_(pa.int64())) for x in (out_sums, out_lacks, out_runs)]], names=[f.name for f in summary.fields])

    summaries = narrow.groupBy("_part").applyInArrow(summarise, summary)
    entries = T.StructType([T.StructField(n, long) for n in ("_part", "_first", "entry", "run", "lack")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lack, run = None, 0, 0
        for b in batches:
            out = []
            cols = [b.column(n).to_pylist() for n in ("_part", "_first", "_kh", "total", "sums", "lacks", "runs")]
            for part, first, kh, total, sums, lacks, runs in zip(*cols, strict=True):
                if kh != held:
                    held, lack, run = kh, 0, 0
                entry = int(np.searchsorted(sums, lack, side="left"))
                if entry < len(sums) and sums[entry] >= lack:
                    out.append((part, first, entry, run, lack))
                    lack, run = lacks[entry], run + runs[entry]
                else:
                    out.append((part, first, -1, run, lack))
                    lack -= total
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=[f.name for f in entries.fields])

    by = ["_kh", *[f.name for f in key_fields]]
    walked = summaries.repartition(*by).sortWithinPartitions(*by, "_part").mapInArrow(walk, entries)
    numbered = T.StructType([T.StructField(n, long) for n in ("_part", "_at", "_run", "_held")])

    def number(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, entry = table.sort_by("_at"), entry.sort_by("_first")
        begins, ends, held, sums = _segments(table)
        after = _next_cut(begins, ends, sums, budget)
        run, inside = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        lists = [entry[n].to_pylist() for n in ("entry", "run", "lack")]
        for b, e, at, no, lack in zip(begins.tolist(), ends.tolist(), *lists, strict=True):
            cut = e if at < 0 else b + at
            run[b:cut], inside[b:cut] = no - 1, budget - lack + sums[b:cut] - sums[b]
            while cut < e:
                stop = int(after[cut])
                run[cut:stop], inside[cut:stop] = no, sums[cut:stop] - sums[cut]
                cut, no = stop, no + 1
        return pa.Table.from_arrays([table["_part"], table["_at"], pa.array(run), pa.array(inside)], names=[f.name for f in numbered.fields])

    places = narrow.groupBy("_part").cogroup(walked.groupBy("_part")).applyInArrow(number, numbered)
    met = rows.join(places.hint("shuffle_hash"), ["_part", "_at"])
    whole = F.sum("_tokens").over(W.partitionBy(*keys, "_run"))  # a run's rows: a budget's worth
    kept = met.withColumn("_whole", whole).where(F.col("_whole") >= budget)
    return kept.select(*names, F.col("_run").alias(batch), *([F.col("_held").alias(before)] if before else []))
