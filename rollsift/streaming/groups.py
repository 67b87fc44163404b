"""Count-triggered groups on streams, and the same on tables.

Groups close on their size, not on time: there are no watermarks. Failed and
cancelled members arrive as rows, so that counts always complete; a group is
given exactly once: state and output commit together, or are files of their
micro-batch's number, which one that is done again replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from rollsift.operators.batches import Ladder
from rollsift.operators.scans import scanned
from rollsift.sources.scratch import scratch_path


def finished_groups(df: DataFrame, size: int | str, group: str = "group_id", order: str = "arrival") -> DataFrame:
    """Batch: the first ``size`` rows of each group that has as many. size: a number or a column's name."""
    w = W.partitionBy(group)
    limit = F.col(size) if isinstance(size, str) else F.lit(size)
    rows = df.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where((F.col("_n") >= limit) & (F.col("_rn") <= limit)).drop("_rn", "_n")


@dataclass
class Batched:
    """A stream whose micro-batches are taken as tables, with the rows that the earlier ones left; ``started`` runs it.

    ``step`` gets the held rows, those that came and the batch's number, and gives rows marked ``_out`` (given, with the
    columns of ``schema``) and ``_keep`` (held for later batches, with the columns of ``held``)."""

    stream: DataFrame
    schema: T.StructType
    held: T.StructType
    step: Callable[[DataFrame, DataFrame, int], DataFrame]

    @property
    def sparkSession(self) -> SparkSession:
        return self.stream.sparkSession


def _files(spark: SparkSession, path: str):
    """(Hadoop's Path, the file system of a path)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _published(df: DataFrame, path: str, n: int) -> None:
    """Files of a micro-batch under its number: what an earlier attempt left of it goes first."""
    hadoop, fs = _files(df.sparkSession, path)
    attempt, prefix = scratch_path(df.sparkSession, "micro-batch-out"), f"batch-{n:010d}-"
    df.write.parquet(attempt)
    for old in fs.globStatus(hadoop(f"{path}/{prefix}*")) or []:
        fs.delete(old.getPath(), False)
    for file in fs.globStatus(hadoop(f"{attempt}/part-*")) or []:
        target = hadoop(path, prefix + file.getPath().getName())
        if not fs.rename(file.getPath(), target):
            raise OSError(f"{target} can't be published")
    fs.delete(hadoop(attempt), True)


def _handled(batched: Batched, checkpoint: str, give: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A micro-batch's work, from what the batch before it held; one that is done again replaces what it held itself."""

    def handle(came: DataFrame, n: int) -> None:
        spark = came.sparkSession
        hadoop, fs = _files(spark, checkpoint)
        before, marks = f"{checkpoint}/held/{n - 1}", scratch_path(spark, "micro-batch")
        fs.mkdirs(hadoop(before))  # the first batch finds nothing
        batched.step(spark.read.schema(batched.held).parquet(before), came, n).write.parquet(marks)
        marked = spark.read.parquet(marks)
        marked.where("_keep").select(*batched.held.names).write.mode("overwrite").parquet(f"{checkpoint}/held/{n}")
        give(marked.where("_out").select(*batched.schema.names), n)
        for gone in (marks, f"{checkpoint}/held/{n - 2}"):
            fs.delete(hadoop(gone), True)

    return handle


class _Stacked(StatefulProcessor):
    """Holds a key's ladder of buckets."""

    def __init__(self, keys: list[str], area: int, timeout: int, order: str, sample: str, length: str):
        self.keys, self.area, self.timeout, self.order, self.sample, self.length = keys, area, timeout, order, sample, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("ladder", Ladder.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ladder = Ladder(self.area, self.timeout)
        if self.kept.exists():
            ladder.resume(self.kept.get())
        for r in sorted(rows, key=lambda r: (r[self.order] is not None, r[self.order])):
            for batch, bucket, place, item, n in ladder.put(r[self.sample], r[self.length]):
                yield Row(**dict(zip(self.keys, key, strict=True)), batch=batch, bucket=bucket, position=place, sample_id=item, taken=n)
        self.kept.update(ladder.state())

    def close(self) -> None:
        pass


class _Packed(StatefulProcessor):
    """Holds a key's open pack."""

    STATE = "pack long, used int, held array<struct<sample_id:long,start:int,taken:int>>"

    def __init__(self, keys: list[str], seq_len: int, order: str, sample: str, length: str):
        self.keys, self.seq_len, self.order, self.sample, self.length = keys, seq_len, order, sample, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("pack", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pack, used, held = self.kept.get() if self.kept.exists() else (0, 0, [])
        held = [tuple(x) for x in held]
        for r in sorted(rows, key=lambda r: (r[self.order] is not None, r[self.order])):
            n = r[self.length] or 0
            held.append((r[self.sample], used, min(n, self.seq_len - used)))
            used += n
            if used >= self.seq_len:
                for item, start, taken in held:
                    yield Row(**dict(zip(self.keys, key, strict=True)), pack=pack, sample_id=item, start=start, taken=taken)
                pack, used, held = pack + 1, 0, []
        self.kept.update((pack, used, held))

    def close(self) -> None:
        pass


def _of_keys(stream: DataFrame, keys: list[str], columns: str) -> T.StructType:
    return T.StructType([*[stream.schema[k] for k in keys], *T._parse_datatype_string(columns).fields])


def stream_stacked(stream: DataFrame, area: int, keys: list[str], order: str, timeout: int = 10, sample: str = "sample_id", length: str = "length") -> DataFrame:
    """Stream: the batches of ``batches.stacked``. Buckets, their timers and what waits in them are state: a query that
    goes on from its checkpoint gives the batches of one that never stopped. Rows of a micro-batch come by ``order``."""
    out = _of_keys(stream, keys, "batch long, bucket int, position int, sample_id long, taken int")
    return stream.groupBy(*keys).transformWithState(_Stacked(keys, area, timeout, order, sample, length), out, "append", "none")


def stream_cat_packs(stream: DataFrame, seq_len: int, keys: list[str], order: str, sample: str = "sample_id", length: str = "length") -> DataFrame:
    """Stream: the packs of ``batches.cat_packs``, the open one being state."""
    out = _of_keys(stream, keys, "pack long, sample_id long, start int, taken int")
    return stream.groupBy(*keys).transformWithState(_Packed(keys, seq_len, order, sample, length), out, "append", "none")


def stream_groups(stream: DataFrame, size: int, group: str | tuple[str, ...] = "group_id", order: str | None = None) -> Batched:
    """Stream: a group's rows, when its ``size``-th has come. Later rows of a finished group begin a new one.

    Rows of one micro-batch are taken by ``order``, nulls first, after those that are held. They are held with their own
    types, so that they come out as they went in. Places come from ``scans``, so that no group is in one task. Start the
    query with ``started``."""
    keys = [group] if isinstance(group, str) else [*group]
    by = ["_batch", *([order] if order is not None else [])]

    def step(held: DataFrame, came: DataFrame, n: int) -> DataFrame:
        rows = scanned(held.unionByName(came.withColumn("_batch", F.lit(n).cast("long"))), keys, by, at="_place", size="_rows")
        whole = F.col("_place") < F.col("_rows") - F.col("_rows") % size
        return rows.withColumn("_out", whole).withColumn("_keep", ~whole)

    return Batched(stream, stream.schema, T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())]), step)


def stream_evaluations(stream: DataFrame, examples: int, group_size: int, keys: tuple[str, ...] = ("env_name", "eval_step"), order: str | None = None) -> Batched:
    """Stream: an evaluation's rows, when all ``examples * group_size`` have come."""
    return stream_groups(stream, examples * group_size, keys, order)


def stream_previous(stream: DataFrame, keys: list[str], order: str, columns: list[str]) -> Batched:
    """Stream: each row with the same key's previous values, across micro-batches. Rows that come late follow those given.

    A key's last row is held, without the columns that nothing asks for."""
    schema = T.StructType([*stream.schema.fields, *[T.StructField(f"previous_{c}", stream.schema[c].dataType) for c in columns]])
    kept = [f for f in stream.schema.fields if f.name in {*keys, *columns}]

    def step(held: DataFrame, came: DataFrame, n: int) -> DataFrame:
        rows = held.withColumn("_came", F.lit(False)).unionByName(came.withColumn("_came", F.lit(True)), allowMissingColumns=True)
        seen = scanned(rows.withColumn("_order", F.col(order)), keys, ["_came", "_order"], at="_place", size="_rows", previous={f"previous_{c}": c for c in columns})
        return seen.withColumn("_out", F.col("_came")).withColumn("_keep", F.col("_place") == F.col("_rows") - 1)

    return Batched(stream, schema, T.StructType(kept), step)


#: The state store that keeps lists and values of their own types.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def started(stream: DataFrame | Batched, path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Starts a query that takes what is there and appends to a Parquet table; one with the same checkpoint goes on from it."""
    if isinstance(stream, Batched):
        hadoop, fs = _files(stream.sparkSession, path)
        fs.mkdirs(hadoop(path))
        handle = _handled(stream, checkpoint, lambda df, n: _published(df, path, n))
        writer = stream.stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()
    with _store(stream.sparkSession):  # a query keeps the settings that it starts with
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


def drained(stream: DataFrame | Batched, label: str) -> DataFrame:
    """What the stream gives for all that is there now, as a table in the shared folder."""
    root = scratch_path(stream.sparkSession, label)
    started(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


class Gauges(StreamingQueryListener):
    """Appends a row (query, batch, input_rows, rows_a_second) of each micro-batch to a table."""

    SCHEMA = "query string, batch long, input_rows long, rows_a_second double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name or str(p.id), p.batchId, p.numInputRows, float(p.inputRowsPerSecond or 0.0))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def finished_evaluations(df: DataFrame, examples: int, group_size: int, keys: tuple[str, ...] = ("env_name", "eval_step"), order: str = "arrival") -> DataFrame:
    """Rows of the evaluations that have all ``examples * group_size`` arrivals."""
    key = F.struct(*keys)
    return finished_groups(df.withColumn("_key", F.to_json(key)), examples * group_size, "_key", order).drop("_key")


def write_batches(stream: DataFrame | Batched, handle: Callable[[DataFrame, int], None], checkpoint: str, **options: str):
    """Starts the stream; ``handle`` gets every micro-batch, with filters, cuts and metrics as on tables."""
    if isinstance(stream, Batched):
        stream, handle = stream.stream, _handled(stream, checkpoint, handle)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k, v)
    with _store(stream.sparkSession):
        return writer.trigger(availableNow=True).start()


def lead_gate(step, version, lead: int = 1):
    """Column: dispatch pauses while the step is more than ``lead`` ahead of the policy."""
    return F.col(step) + 1 - F.col(version) > lead


def gauges(progress: list[dict]) -> list[tuple[str, int, float]]:
    """(query, batch, input rows a second) of progress records, for periodic logs."""
    return [(p["name"] or p["id"], p["batchId"], float(p.get("inputRowsPerSecond") or 0.0)) for p in progress]


def sink(df: DataFrame, group_size: int, batch_size: int, before, after, group: str = "group_id", order: str = "arrival", env: tuple[str, ...] = ()) -> DataFrame:
    """Rollouts to groups to batches: whole groups, filters that drop, full batches of what is left, filters that mark.

    before, after: functions of a frame that add ``is_filtered``. The result has batch_id and the marks of the second
    one; ``shipped`` are the rows that it doesn't mark."""
    from rollsift.operators.ordering import batches_of

    whole = before(finished_groups(df, group_size, group, order))
    left = whole.where(~F.coalesce("is_filtered", F.lit(False))).drop("is_filtered")
    return after(batches_of(left, batch_size, order, list(env))).withColumn("shipped", ~F.coalesce("is_filtered", F.lit(False)))
