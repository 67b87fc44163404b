"""Token ids as Arrow files of fixed-size lists.

A file holds record batches of ``BATCH_ROWS`` rows; a row is one sequence of
``length`` ids and a mask of as many booleans (false: padding after the last
document of the file). Documents follow each other without gaps. All rows have
one width and all batches but the last one row count, so sequence ``i`` lies in
batch ``i // BATCH_ROWS`` at a computed offset: a memory-mapped file gives a
view on it without copying or scanning. A second Arrow file lists the
documents: id, first id's position in the file, number of ids.

Edge cases: a null text counts as empty and has the end id alone; null document
ids come first; equal document ids are ordered by the first 64 characters of the text,
and inside a file by the whole text; a very long text is one
document like any other; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks, scratch_path, whole_text
from rollsift.llm.tokens import encoder

END_ID = 1
SEQUENCE_LENGTH = 2048
BATCH_ROWS = 256
#: Characters of a text that part the rows of one id.
TIE_CHARACTERS = 64
#: Stored input for a file. A plan without figures claims more than any input has: MOST_BYTES.
FILE_BYTES, MOST_BYTES = 64 << 20, 1 << 50


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a shared path, as executors open it."""
    scheme = urllib.parse.urlsplit(uri).scheme
    if scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urllib.parse.urlsplit(uri).path
    return pa.fs.FileSystem.from_uri(uri)


def publish(uri: str, attempt: str, write) -> None:
    """Runs ``write(stream)`` on a name of this attempt, then moves it into place: a retried or
    doubled task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        write(out)
    fs.move(f"{path}.{attempt}", path)


class SequenceWriter:
    """Appends ids and writes full batches as they fill; memory is one batch."""

    def __init__(self, out, dtype, length: int = SEQUENCE_LENGTH, batch_rows: int = BATCH_ROWS):
        if length % 8:
            raise ValueError("a sequence's mask must fill whole bytes")
        self.length, self.room = length, length * batch_rows
        self.value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.held = np.zeros(self.room, dtype)
        self.n = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            k = min(self.room - self.n, len(ids) - at)
            self.held[self.n : self.n + k] = ids[at : at + k]
            self.n, at = self.n + k, at + k
            if self.n == self.room:
                self._flush()
        self.total += len(ids)

    def _flush(self) -> None:
        rows = -(-self.n // self.length)
        if rows:
            self.held[self.n : rows * self.length] = 0
            mask = np.arange(rows * self.length) < self.n
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.held[: rows * self.length], mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n = 0

    def close(self) -> None:
        self._flush()
        self.writer.close()


class SequenceFile:
    """Random access to a written file: views on the mapped memory."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def batch_ids(self, i: int) -> np.ndarray:
        return self.reader.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views: the mask has eight places a byte, lowest bit first; see ``unpacked``."""
        batch = self.reader.get_batch(i // self.rows)
        at = i % self.rows
        ids = batch.column("ids").slice(at, 1).flatten().to_numpy(zero_copy_only=True)
        bits = batch.column("mask").values.buffers()[1]  # a batch of a file begins at bit 0
        return ids, np.frombuffer(bits, np.uint8, self.length // 8, at * self.length // 8)

    @staticmethod
    def unpacked(mask: np.ndarray) -> np.ndarray:
        return np.unpackbits(mask, bitorder="little").astype(bool)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; a view unless they cross batches."""
        size, parts, end = self.rows * self.length, [], start + n
        while start < end:
            i = start // size
            ids = self.batch_ids(i)
            parts.append(ids[start - i * size : min(end - i * size, size)])
            start = (i + 1) * size
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(df: DataFrame, vocabulary: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Encodes and writes the documents in ascending id order, a file for each range of ids: as many as the session's
    shuffle partitions, or more, so that a file comes from about ``FILE_BYTES`` of stored input.

    Returns (partition, path without suffix, documents, ids) for each file: a few numbers a file."""
    spark = df.sparkSession
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's figure, without a scan
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // FILE_BYTES) if stored < MOST_BYTES else 1)
    ordered = df.select(F.col(doc_id).alias("_id"), whole_text(text).alias("_text"))
    # rows of one id, however many, are ranges too; only the beginning of a text is sampled for their ends
    ends = ["_id", F.substring("_text", 1, TIE_CHARACTERS), "_row"]
    ordered = ordered.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *ends).sortWithinPartitions("_id", "_text").select("_id", "_text")
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(vocabulary)
        base = f"{folder}/part-{task.partitionId():06d}"
        ids_of, counts = [], []
        writers: list[SequenceWriter] = []

        def body(out) -> None:
            w = SequenceWriter(out, enc.dtype)
            writers.append(w)
            for b in chunks(batches, "_text"):
                ids, ends = enc.encode(b.column("_text"), END_ID)
                w.append(ids)
                counts.append(np.diff(ends))
                ids_of.append(b.column("_id").cast(id_type))
            w.close()

        attempt = str(task.taskAttemptId())
        publish(f"{base}.ids.arrow", attempt, body)
        sizes = np.concatenate([np.zeros(0, np.int64), *counts])
        docs = pa.table([pa.chunked_array(ids_of, id_type), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)], names=["doc_id", "start", "n_ids"])

        def listing(out) -> None:
            with pa.ipc.new_file(out, docs.schema) as w:
                w.write_table(docs)

        publish(f"{base}.docs.arrow", attempt, listing)
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [base], "docs": [len(sizes)], "ids": [writers[0].total]})

    rows = ordered.mapInArrow(run, "part long, path string, docs long, ids long").collect()
    return sorted(tuple(r) for r in rows)


def read_token_files(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """A row for each document from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    listed, before = [], 0
    for _, path, docs, ids in files:
        if docs:
            listed.append((path, before))
        before += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                file = SequenceFile(f"{path}.ids.arrow")
                fs, local = filesystem(f"{path}.docs.arrow")
                with fs.open_input_file(local) as f:
                    docs = pa.ipc.open_file(f).read_all()
                starts, sizes = docs.column("start").to_numpy(), docs.column("n_ids").to_numpy()
                crc = [zlib.crc32(file.span(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                whole = pa.table([docs.column("doc_id"), pa.array(starts + base), docs.column("n_ids"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

    return spark.createDataFrame(listed, "path string, base long").repartition(len(listed)).mapInArrow(run, schema)


def encode_to_files(df: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the files in the shared folder and reads every document back from them."""
    folder = scratch_path(df.sparkSession, "token-files")
    return read_token_files(df.sparkSession, write_token_files(df, vocabulary, folder))
