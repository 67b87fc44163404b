"""Importance resampling towards a target: hashed n-gram weights, and a draw by perturbed scores.

1. Each task of Spark runs DuckDB over its partition: SQL lower-cases and unnests the words, a window makes the runs of
   1 to 3 words, and a registered CRC function (zlib) puts each in a bucket. A document's buckets and the partition's
   bucket counts are spilled to Parquet in the shared folder. Texts come in pieces of at most ``PIECE`` characters (or one
   word) that begin with the last two words before them, so that a long text costs no more memory than a short one, but
   for its list of buckets.
2. Spark adds up the counts of both tables; a bucket's gain is a logarithm of the ratio of its shares. The gains, a
   number a bucket, are the only thing that the driver sees.
3. Weights are sums of gains over the spilled buckets; the score adds noise from a hash of the id (a Gumbel draw), so that
   the highest scores are a sample without replacement. Ranks come from ranges of the scores, written once.

Edge cases: null, empty or wordless texts have no features and weight 0; an empty target or source counts nothing; rows
without id have a weight but no score, aren't counted and aren't drawn; rows that repeat an id have the same noise and
are ranked next to each other if their scores are equal, by features and weight; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollsift.llm.common import chunks, materialise, whole_text
from rollsift.operators.scans import dense_index

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Characters of a piece of text, and of the pieces that DuckDB takes at once.
PIECE, BATCH = 1 << 17, 1 << 20

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Buckets of the runs that end at a piece's own words; the words before them only lend their text.
GRAMS = """
    WITH words AS (
        SELECT piece, lent, unnest(ws) AS w, generate_subscripts(ws, 1) AS place
        FROM (SELECT piece, lent, [w FOR w IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> ''] AS ws FROM pieces)),
    runs AS (
        SELECT piece, place > lent AS own, w, lag(w, 1) OVER x AS w1, lag(w, 2) OVER x AS w2 FROM words WINDOW x AS (PARTITION BY piece ORDER BY place))
    SELECT piece, list((crc(gram) % {buckets})::INTEGER) AS buckets
    FROM (SELECT piece, unnest([w, w1 || ' ' || w, w2 || ' ' || w1 || ' ' || w]) AS gram FROM runs WHERE own) WHERE gram IS NOT NULL GROUP BY piece
"""


def _crc(texts: pa.Array) -> pa.Array:
    """Unsigned CRC of each text's bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data, crc = bytes(texts.buffers()[2] or b""), zlib.crc32
    return pa.array([crc(data[i:j]) for i, j in zip(ends, ends[1:])], pa.int64())  # noqa: B905


def pieces_of(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(lent words, piece): a text cut between words, each later piece with the two words before it."""
    start, lent = 0, []
    while start < len(text):
        cut = re.compile(BETWEEN).search(text, start + most)
        end = cut.start() if cut else len(text)
        piece = text[start:end]
        yield len(lent), " ".join([*lent, piece])
        if end < len(text):
            lent = [*lent, *re.findall(WORD, piece)][-2:]
        start = end


def _spill(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int, most: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with the buckets of each text, and at the end one row with the partition's counts."""
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    sql, totals = GRAMS.format(buckets=buckets), np.zeros(buckets, np.int64)

    def run(pieces: list[tuple[int, int, str]], found: list[list[np.ndarray]]) -> None:
        """Adds the buckets of pieces (row, lent words, text) to their rows."""
        con.register("pieces", pa.table({"piece": pa.array(range(len(pieces)), pa.int64()), "lent": pa.array([p[1] for p in pieces], pa.int64()), "text": pa.array([p[2] for p in pieces], pa.large_string())}))
        for batch in con.sql(sql).to_arrow_table().to_batches():
            lists = batch.column("buckets")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            totals[:] += np.bincount(flat[ends[0] : ends[-1]], minlength=buckets)
            for piece, i, j in zip(batch.column("piece").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found[pieces[piece][0]].append(flat[i:j])
        con.unregister("pieces")

    for part in chunks(batches, "_text", size):
        found: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
        held, n = [], 0
        for i, text in enumerate(part.column("_text").to_pylist()):
            for lent, piece in pieces_of(text, most):
                held.append((i, lent, piece))
                n += len(piece)
                if n >= size:
                    run(held, found)
                    held, n = [], 0
        if held:
            run(held, found)
        ends = np.r_[0, np.cumsum([sum(map(len, x)) for x in found])].astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *[y for x in found for y in x]])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.nulls(part.num_rows, pa.list_(pa.int64()))], schema=schema)
    con.close()
    if totals.any():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field("doc_id").type), pa.nulls(1, pa.list_(pa.int32())), pa.array([totals.tolist()], pa.list_(pa.int64()))], schema=schema)


def bucketed(df: DataFrame, label: str, buckets: int = BUCKETS, piece: int = PIECE, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """((doc_id, buckets) a row, (bucket, n) counts of all rows), from one written table. df: doc_id and text."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("totals", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    spilled, _ = materialise(df.select("doc_id", whole_text("text").alias("_text")).mapInArrow(lambda it: _spill(it, arrow, buckets, piece, batch), schema), label)
    counts = spilled.where("totals is not null").select(F.posexplode("totals").alias("bucket", "_n")).groupBy("bucket").agg(F.sum("_n").alias("n"))
    return spilled.where("totals is null").select("doc_id", "buckets"), counts


def gains_of(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A whole number a bucket: 1000 times the logarithm of its smoothed share of the target over that of the source."""
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    whole = [F.lit(float(x + buckets)) for x in sums]
    ratio = (F.col("t") + F.lit(1.0)) * whole[0] / ((F.col("s") + F.lit(1.0)) * whole[1])
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()  # ``buckets`` rows
    return [r["gain"] for r in sorted(rows, key=lambda r: r["bucket"])]


def noise(key: str, seed: int = SEED) -> Column:
    """A whole number from a hash of the key: 1000 times a Gumbel draw."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have ranks from 1.

    Drawn are ``percent`` of 100 of the documents with ``least`` words or more. target: rows with text."""
    rows, source = bucketed(documents, "buckets", buckets)
    _, wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-buckets", buckets)
    gains = gains_of(source, wanted, buckets)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for b in batches:
            lists = b.column("buckets")
            ends = lists.offsets.to_numpy().astype(np.int64)
            so_far = np.r_[0, np.cumsum(gain[lists.values.to_numpy()[ends[0] : ends[-1]]])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends)), pa.array(np.diff(so_far[ends - ends[0]]))], schema=arrow)

    # n words make one run of each length that they reach: 1, 3, 6, 9, ...
    words = F.when(F.col("n_features") < 3, F.col("n_features")).otherwise(F.floor(F.col("n_features") / 3) + 1)
    scored = rows.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored, _ = materialise(scored.withColumn("_counts", F.col("score").isNotNull() & (words >= least)), "scores")
    counted = scored.where("_counts").drop("_counts")
    n = counted.count() * percent // 100
    placed = dense_index(counted, [F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight")], "_at")
    rank = F.when(F.col("_at") < n, F.col("_at") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank).unionByName(scored.where("not _counts").select(*columns, F.lit(None).cast("long").alias("rank")))
