"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size; a block's vectors are broadcast and
every row is scored against them, in slices, each time the rows are read.
Passes count scores into global histograms, one for each query, and narrow the
range that holds the query's k-th score until it is one value. Of its rows'
counts a task sends only the bins from its own k-th score up. A last pass keeps
the scores above the k-th value and, of those equal to it, each task's k
smallest ids; ties then go to the smaller id.

Components become floor(256 * x). Scores are exact: where the lengths of a
block's and a slice's vectors say that products stay under 2**53 they are summed
in doubles, under 2**62 in 64-bit integers, else in integers of any size; vectors
are grouped by length, so that one large one doesn't slow the others. A score
that 64 bits can't hold counts as the nearest number that they can, in rank and
result; ties then go to the smaller id.

Edge cases: vectors that are null, empty, or hold null or non-finite components,
or ones whose 256-fold is none, take no part, nor do rows without id; vectors of different lengths have no
score; a query's own row is the one with its id, so repeated ids don't find
each other, and a repeated query id asks once, with the smallest of its vectors; a query with fewer
than k candidates returns all; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollsift.llm.common import give_back, scratch_path

SCALE = 256
QUERY_BLOCK = 8192
#: Scores of a slice: queries of the block times rows.
SLICE_SCORES = 1 << 21
BINS = 512


def quantised(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: ids and integer components of the valid rows."""
    ids, vectors = batch.column(0), batch.column(1)
    keep = np.asarray(pa.compute.and_(ids.is_valid(), vectors.is_valid()))
    rows = np.flatnonzero(keep)
    if not len(rows):
        return {}
    ids, vectors = ids.take(pa.array(rows)), vectors.take(pa.array(rows))
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    first = np.cumsum(sizes) - sizes
    out, ids = {}, ids.to_numpy()
    for d in np.unique(sizes[sizes > 0]):
        which = np.flatnonzero(sizes == d)
        x = values[first[which][:, None] + np.arange(d)]
        fine = np.isfinite(SCALE * x).all(1)
        out[int(d)] = ids[which][fine], np.floor(SCALE * x[fine])
    return out


LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
NEVER = -(1 << 63)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers, those out of range at its end."""
    out = np.zeros((len(queries), len(rows)), np.int64)
    with np.errstate(over="ignore"):
        q_length, r_length = lengths(queries), lengths(rows)
    for q in _groups(q_length):
        for r in _groups(r_length):
            most = q_length[q].max() * r_length[r].max()
            a, b = queries[q], rows[r]
            if most < 1 << 52:
                part = (a @ b.T).astype(np.int64)
            elif most < 1 << 61 and max(q_length[q].max(), r_length[r].max()) < 1 << 61:
                part = a.astype(np.int64) @ b.astype(np.int64).T
            else:
                whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
                part = np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)
            out[np.ix_(q, r)] = part
    return out


def _groups(length: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors whose products with their like fit doubles, of those that fit 64 bits, and of the rest."""
    kind = (length >= 1 << 26).astype(int) + (length >= 1 << 30)
    return [g for g in (np.flatnonzero(kind == k) for k in range(3)) if len(g)]


def _score_slices(batches: Iterator[pa.RecordBatch], block: dict):
    """(positions of the queries, ids of the rows, score matrix) of slice after slice; own rows score NEVER."""
    for batch in batches:
        for d, (ids, x) in quantised(batch).items():
            if d not in block:
                continue
            at, query_ids, q = block[d]
            step = max(SLICE_SCORES // len(q), 1)
            for i in range(0, len(ids), step):
                part = ids[i : i + step]
                s = scores(q, x[i : i + step])
                # ids of the queries are sorted and unique
                own = np.searchsorted(query_ids, part)
                hit = np.flatnonzero(query_ids[np.minimum(own, len(query_ids) - 1)] == part)
                s[own[hit], hit] = NEVER
                yield at, part, s
    give_back()


def _histograms(candidates: DataFrame, shared, k: int) -> DataFrame:
    """(query, bin, n): counts from each task's own k-th score up; the last bin is all above the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, low, width = shared.value
        counts = np.zeros((n, BINS + 1), np.int32)
        for at, _, s in _score_slices(batches, block):
            some, places = np.nonzero(s >= low[at][:, None])  # no low is NEVER
            # distances fit unsigned 64 bits whatever the two ends
            above = s[some, places].astype(np.uint64) - low[at[some]].astype(np.uint64)
            bins = np.minimum(above // width[at[some]], np.uint64(BINS)).astype(np.int64)
            counts += np.bincount(at[some] * (BINS + 1) + bins, minlength=counts.size).reshape(counts.shape).astype(np.int32)
        above = np.cumsum(counts[:, ::-1], 1, dtype=np.int64)[:, ::-1] - counts
        query, bin_ = np.nonzero((counts > 0) & (above < k))
        for i in range(0, len(query), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(query[j]), pa.array(bin_[j]), pa.array(counts[query[j], bin_[j]].astype(np.int64))], ["query", "bin", "n"])

    return candidates.mapInArrow(run, "query long, bin long, n long")


def _longest(candidates: DataFrame) -> float:
    """Length of the longest valid vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for batch in batches:
            for _, x in quantised(batch).values():
                if len(x):
                    with np.errstate(over="ignore"):
                        top = max(top, float(lengths(x).max()))
        yield pa.RecordBatch.from_pydict({"top": [top]})

    return candidates.mapInArrow(run, "top double").agg(F.max("top")).first()[0] or 0.0


def _select(candidates: DataFrame, block: dict, n: int, k: int, longest: float) -> DataFrame:
    """The k best rows of each query of one block: (query, vec_id, score). A query's range follows from its length."""
    sc = candidates.sparkSession.sparkContext
    most = np.zeros(n)
    with np.errstate(over="ignore"):
        for at, _, x in block.values():
            most[at] = lengths(x) * longest * (1 + 1e-9) + 2
    ends = [HIGHEST if not m < HIGHEST else int(m) for m in most]
    low = np.array([-e for e in ends], np.int64)
    width = np.array([-(-(2 * e + 1) // BINS) for e in ends], np.uint64)
    start = low.copy()
    best_first = W.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    while True:
        shared = sc.broadcast((block, n, low, width))
        counted = _histograms(candidates, shared, k).groupBy("query", "bin").agg(F.sum("n").alias("n"))
        kth = counted.withColumn("reached", F.sum("n").over(best_first)).where(F.col("reached") >= k).groupBy("query").agg(F.max("bin").alias("bin")).collect()
        found = np.full(n, -1, np.int64)
        for r in kth:
            found[r["query"]] = r["bin"]
        shared.unpersist()
        if (found >= BINS).any():
            raise AssertionError("a k-th score lies above its range")
        few = found < 0  # fewer than k candidates: everything is kept
        low = np.where(few, start, (low.astype(np.uint64) + np.maximum(found, 0).astype(np.uint64) * width).astype(np.int64))
        if (width[~few] <= 1).all():
            break
        width = np.where(few, width, (width + np.uint64(BINS - 1)) // np.uint64(BINS))
    shared = sc.broadcast((block, n, low, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, low, _ = shared.value
        over: list[tuple] = []
        ties: dict[int, np.ndarray] = {}
        for at, ids, s in _score_slices(batches, block):
            some, places = np.nonzero((s > low[at][:, None]) & (s != NEVER))
            over.append((at[some], ids[places], s[some, places]))
            some, places = np.nonzero(s == low[at][:, None])
            if len(some):
                order = np.argsort(some, kind="stable")
                some, places = some[order], places[order]
                cut = np.flatnonzero(np.diff(some)) + 1
                for q, group in zip(some[np.append(0, cut)], np.split(ids[places], cut), strict=True):
                    q = int(at[q])
                    ties[q] = np.sort(np.concatenate([ties[q], group]) if q in ties else group)[:k]
        for q, group in ties.items():
            over.append((np.full(len(group), q), group, np.full(len(group), low[q])))
        for q, ids, s in over:
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(s)], ["query", "vec_id", "score"])

    ranked = candidates.mapInArrow(run, "query long, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the valid rows whose id ``every`` divides; candidates all other valid rows."""
    spark = df.sparkSession
    candidates = df.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).alias("_vector"))
    schema = "query_id long, rank int, vec_id long, score long"
    sound = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    asked = candidates.where((F.pmod("_id", F.lit(every)) == 0) & (F.size("_vector") > 0) & sound)
    asked = asked.groupBy("_id").agg(F.min("_vector").alias("_vector"))
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    longest = _longest(candidates)
    blocks = -(-n_queries // (QUERY_BLOCK // 2))  # by hash: half full on average, so that none is far over
    folder = scratch_path(spark, "top-k")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).toArrow()
        block, at = {}, 0
        names: list[np.ndarray] = []
        parts: dict[int, list] = {}
        for batch in rows.to_batches():
            for d, (ids, x) in quantised(batch).items():
                parts.setdefault(d, []).append((ids, x))
        for d, found in parts.items():
            ids, where = np.unique(np.concatenate([i for i, _ in found]), return_index=True)
            x = np.concatenate([x for _, x in found])[where]
            block[d] = np.arange(at, at + len(ids)), ids, x
            names.append(ids)
            at += len(ids)
        if not at:
            continue
        ids = spark.sparkContext.broadcast(np.concatenate(names))
        best = _select(candidates, block, at, k, longest)
        named = _named(best, ids)
        named.write.parquet(f"{folder}/block={b}")
    if not any_written(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/*")


def _named(best: DataFrame, ids) -> DataFrame:
    """Positions in the block become query ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query = pa.array(ids.value[b.column("query").to_numpy()].astype(np.int64))
            yield pa.RecordBatch.from_arrays([query, b.column("rank"), b.column("vec_id"), b.column("score")], ["query_id", "rank", "vec_id", "score"])

    return best.select("query", "rank", "vec_id", "score").mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def any_written(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
