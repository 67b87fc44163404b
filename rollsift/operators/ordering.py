"""Deterministic orders, cuts and picks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.operators.scans import restarting, scanned
from rollsift.sources.scratch import written


def by_run_and_length(df: DataFrame, run: str = "run_idx", length: str = "length", arrival: str = "arrival") -> DataFrame:
    """Runs in order, longest first, ties by arrival."""
    return df.orderBy(run, F.desc(length), arrival)


def least_loaded(df: DataFrame, keys: list[str], client: str = "client", load: str = "in_flight") -> DataFrame:
    """The client with the least load; ties go to the first name."""
    return df.groupBy(*keys).agg(F.min_by(client, F.struct(load, client)).alias(client))


def oldest_step(df: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """Rows of each run's oldest pending step."""
    oldest = df.groupBy(run).agg(F.min(step).alias(step))
    return df.join(oldest, [run, step], "left_semi")


#: Bits of the table of marks that every task gets: 16 a prefix, and 32 MB at most.
MARK_BITS, MOST_BITS = 16, 1 << 28
#: Queries whose marks a worker scans at once.
SCANNED_ROWS = 500


def _beginnings(shared, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, _key, _n, _digest) of the beginnings whose mark is in the table. A beginning's mark is the running exclusive
    or of its tokens' marks; its digest is that of its words one after the other."""
    table = np.frombuffer(shared.value, np.uint8)
    for b in (b.slice(i, SCANNED_ROWS) for b in batches for i in range(0, b.num_rows, SCANNED_ROWS)):
        marks, words = b.column("_marks"), b.column("_words")
        at, word_at = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (marks, words))
        running = np.bitwise_xor.accumulate(marks.flatten().to_numpy())
        earlier = np.where(at[:-1] > 0, running[at[:-1] - 1], 0) if len(running) else running
        place = (running ^ np.repeat(earlier, np.diff(at))) & (bits - 1)
        hits = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        row = np.searchsorted(at, hits, side="right") - 1
        n = hits - at[row]
        texts = words.flatten().cast(pa.large_binary())
        data = memoryview(texts.buffers()[2] or b"")
        byte_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        digests, current = [], -1
        for r, begin, end in zip(row.tolist(), byte_at[word_at[row]].tolist(), byte_at[word_at[row] + n].tolist(), strict=True):
            if r != current:
                current, done, digest = r, begin, hashlib.sha256()
            digest.update(data[done:end])
            done = end
            digests.append(digest.copy().digest())
        taken = b.select(["_row", "_key"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(n, pa.int32()), pa.array(digests, pa.binary())], names=["_row", "_key", "_n", "_digest"])


def longest_prefix(queries: DataFrame, prefixes: DataFrame, key: str, query: str = "ids", prefix: str = "prefix", order: str = "prefix_id") -> DataFrame:
    """For each query of a key the longest of the key's prefixes that it starts with; ties go to the first.

    Equal prefixes are one. A token's mark is a hash of its place and value, and a prefix's mark the exclusive or of its
    tokens' and its key's marks, so that one running scan over a query has the marks of all its beginnings: a query of n
    tokens costs n, whatever lengths there are, and no key's queries meet in a task. A table of bits, of bounded size,
    says which marks prefixes have; only beginnings that it lets through are moved, as their length and SHA-256, by which
    they are compared with the prefixes. Texts aren't moved."""
    spark = queries.sparkSession
    mark = lambda tokens: F.transform(tokens, lambda x, i: F.xxhash64(i, x))
    seed = F.xxhash64(F.lit(-1), F.col(key))
    # a word says its own length, so that no two sequences read the same
    spelt = lambda tokens: F.transform(tokens, lambda x: F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")))
    whole = prefixes.where(F.col(key).isNotNull() & F.col(prefix).isNotNull()).select(
        F.col(key).alias("_key"), F.size(prefix).alias("_n"), F.unhex(F.sha2(F.array_join(spelt(prefix), "").cast("binary"), 256)).alias("_digest"),
        F.aggregate(mark(prefix), seed, lambda s, h: s.bitwiseXOR(h)).alias("_mark"), order,
    )
    unique = written(whole.groupBy("_key", "_n", "_digest").agg(F.min(order).alias(order), F.first("_mark").alias("_mark")), "prefixes")
    bits = min(max(1 << (unique.count() * MARK_BITS).bit_length(), 1 << 15), MOST_BITS)
    place = F.col("_mark").bitwiseAND(bits - 1)
    table = np.zeros(bits // 8, np.uint8)
    for block, found in unique.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1))).toLocalIterator():
        table[block << 12 : (block + 1) << 12] = np.frombuffer(found, np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())
    rows = written(queries.withColumn("_row", F.monotonically_increasing_id()), "prefix-queries")
    told = rows.where(F.col(key).isNotNull() & F.col(query).isNotNull()).select("_row", F.col(key).alias("_key"), F.concat(F.array(seed), mark(query)).alias("_marks"), spelt(query).alias("_words"))
    schema = T.StructType([told.schema["_row"], told.schema["_key"], T.StructField("_n", T.IntegerType()), T.StructField("_digest", T.BinaryType())])
    asked = told.mapInArrow(partial(_beginnings, shared, bits), schema)
    met = asked.join(unique.drop("_mark"), ["_key", "_n", "_digest"]).groupBy("_row").agg(F.max_by(order, "_n").alias("_best"))
    return rows.join(met, "_row").select(*queries.columns, F.col("_best").alias(order))


def batches_of(df: DataFrame, size: int, order: str, keys: list[str], out: str = "batch_id") -> DataFrame:
    """Numbers of full batches in arrival order within each key; rows of the incomplete last one are left out."""
    numbered = scanned(df, keys, [order], at="_place", size="_rows").withColumn(out, F.floor(F.col("_place") / size).cast("long"))
    return numbered.where(F.col(out) < F.floor(F.col("_rows") / size)).drop("_place", "_rows")


def token_batches(df: DataFrame, budget: int, order: str, keys: list[str], tokens: str = "tokens", out: str = "batch_id") -> DataFrame:
    """Shortest runs of rows with ``budget`` tokens or more, each starting afresh; the incomplete last one is left out."""
    return restarting(df, budget, keys, [order], tokens, out)


def report_order(df: DataFrame) -> DataFrame:
    """Benchmark report: model, type, sequence length, best throughput first, then hardware, recomputation, attention."""
    return df.orderBy("model_name", "type", "seq_len", F.desc("throughput"), "device_name", "ac", "attention")


def top_experts(scores, k: int, bias=None):
    """Column: indexes of the k best experts; the bias counts for the choice only, equal scores go to the lower index."""
    s = F.col(scores) if isinstance(scores, str) else scores
    chosen = F.zip_with(s, bias, lambda a, b: a + b) if bias is not None else s
    ranked = F.array_sort(F.transform(chosen, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def normalised_weights(scores, chosen, scale: float = 1.0):
    """Column: unbiased scores of the chosen experts over their sum, times the scale."""
    s = F.col(scores) if isinstance(scores, str) else scores
    picked = F.transform(chosen, lambda i: F.get(s, i))
    total = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.transform(picked, lambda x: x / total * scale)
