"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batches, ids."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker end at this many bytes of text.
CHUNK_BYTES = 1 << 18


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every machine sees.

    On a cluster a session without that setting is refused, as its executors would write where nobody else reads.
    A local master is one machine (tests, a laptop): it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = f"file://{spark._jvm.System.getProperty('java.io.tmpdir')}/rollsift-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/rollsift/{label}-{uuid.uuid4().hex}"


#: While a table is written: a query's shuffle files go when it ends, and Python workers get batches of a few megabytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


_LOCK, _ACTIVE = threading.Lock(), {"writes": 0, "before": {}}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The session's settings while any thread writes: the first write sets them, the last one to end restores them.

    Queries that other threads start then lose their shuffle files as they end, never sooner."""
    with _LOCK:
        if not _ACTIVE["writes"]:
            _ACTIVE["before"] = {k: spark.conf.get(k, None) for k in _WRITING}
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
        _ACTIVE["writes"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _ACTIVE["writes"] -= 1
            if not _ACTIVE["writes"]:
                for k, v in _ACTIVE["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there,
    and a lost executor costs a re-read. The second value is the path, for ``discard``.

    The write's shuffle files go when it ends; nothing else reads them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _writing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name = "_" + name
    return name


#: A key with more than one of this many parts of a table's rows (and over HOT_ROWS) is hot; fewer keys than this are.
HOT_PARTS, HOT_ROWS = 10_000, 100


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner", sizes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by ``key``, which is unique in ``right``; no key's rows go to one task.

    Rows of a hot key of ``left`` are dealt by the hash of ``spread_by`` over parts of about a ``HOT_PARTS``-th of
    the table; the one row of ``right`` is repeated for each part. The list of hot keys is broadcast: it has fewer
    than ``HOT_PARTS`` rows whatever the table. ``sizes`` (key, n) and ``rows``: counts of ``left`` that are known."""
    part = max((left.count() if rows is None else rows) / HOT_PARTS, HOT_ROWS)
    counted = left.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = counted.select(F.col(key).alias("_hot"), F.col("n").alias("_n")).where(F.col("_n") > part)
    hot = F.broadcast(hot.select("_hot", F.ceil(F.col("_n") / part).cast("int").alias("_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts").cast("long")), F.lit(0)).cast("int")
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copies = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", every).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def whole_text(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_texts(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The frame and its column that workers read texts from, by way of ``filled``: the text itself where it is a
    string, so that nothing is sent twice, and else a column of strings beside the others."""
    if dict(df.dtypes).get(text) == "string":
        return df, text
    name = beside(df, "_text")
    return df.withColumn(name, whole_text(text)), name


def filled(texts: pa.Array) -> pa.Array:
    """A null text counts as empty."""
    return pa.compute.fill_null(texts, "") if texts.null_count else texts


def id_bucket(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(parts)


def held_out(column: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id is never held out, and has no label either."""
    return F.coalesce(id_bucket(column) == 0, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i in range(n):
            size = sizes[i]
            held += 0 if size != size else int(size)
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)
    give_back()


def give_back() -> None:
    """Returns what a task has freed to the system: Spark keeps several idle workers an executor, each with its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
