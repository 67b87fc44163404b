"""Sequence packing over the length histogram, shortest pack first.

Documents are encoded once; a document of more than ``capacity`` ids is cut
into full pieces and a remainder. Only the histogram of piece lengths (at most
``capacity`` rows) reaches the driver, which packs it longest length first:
each length goes into the packs that are shortest so far and have room, as many
at a time as there are packs of one pattern. Pieces sorted by length then meet
the patterns' slots by rank: the k-th piece of a length takes that length's
k-th slot. Ids are never shuffled.

Edge cases: a null text counts as empty; an empty text is the end id alone;
equal rows are told apart by nothing and take neighbouring slots; a null id
stays null; a very long text is cut into as many full pieces as it has; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks, discard, materialise, whole_text
from rollsift.llm.tokens import encoder

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in placing order) and how many packs have each.

    The heap holds patterns by the room that is left, most first; ties by age."""
    patterns: list[tuple[int, int]] = []  # (parent, length placed last); a chain gives the pattern
    heap: list[tuple[int, int, int]] = []  # (-room, pattern, packs)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids doesn't fit {capacity}")
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, parent, packs = heapq.heappop(heap)
                used = min(packs, left)
                if used < packs:
                    heapq.heappush(heap, (room, parent, packs - used))
                room = -room
            else:
                room, parent, used = capacity, -1, left
            patterns.append((parent, length))
            heapq.heappush(heap, (length - room, len(patterns) - 1, used))
            left -= used
    out = []
    for _, at, packs in sorted(heap, key=lambda x: x[1]):
        lengths = []
        while at >= 0:
            at, length = patterns[at]
            lengths.append(length)
        out.append((tuple(reversed(lengths)), packs))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces go, in order of length: (first rank, first sequence, offset) of each run of slots."""
    runs, first = [], 0
    for lengths, packs in patterns:
        offset = 0
        for n in lengths:
            runs.append((n, first, offset, packs))
            offset += n
        first += packs
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 4)
    return np.cumsum(a[:, 3]) - a[:, 3], a[:, 1], a[:, 2]


def encode_pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: its document, its place there, and the crc of its ids."""
    picked = df.select(F.col(doc_id).cast("long").alias("_id"), whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in chunks(batches, "_text"):
            rows = []
            ids, ends = enc.encode(b.column("_text"), END_ID)
            raw = memoryview(ids.astype("<u4").tobytes())
            for doc, at, end in zip(b.column("_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for s in range(at, end, capacity):
                    e = min(s + capacity, end)
                    rows.append((doc, s - at, e - s, zlib.crc32(raw[4 * s : 4 * e]), end - at))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return picked.mapInArrow(run, PIECES)


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, cuts and packs: piece columns with sequence_id and offset."""
    spark = df.sparkSession
    pieces, path = materialise(encode_pieces(df, vocabulary, capacity, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first_rank, first_sequence, offset = slots(shortest_pack_first(histogram, capacity))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "doc_id", "start", "ids_crc32"]
    ranked, _ = materialise(pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "pieces-by-length")
    discard(spark, path)
    # one number a partition: rows in the partitions before it
    counts = dict(ranked.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    table = spark.sparkContext.broadcast((before, first_rank, first_sequence, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first_rank, first_sequence, offset = table.value
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("_at").to_numpy()
            parts, which = np.unique(at >> 33, return_inverse=True)
            rank = np.array([before[int(p)] for p in parts], np.int64)[which] + (at & ((1 << 33) - 1))
            run_of = np.searchsorted(first_rank, rank, side="right") - 1
            sequence = first_sequence[run_of] + rank - first_rank[run_of]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset[run_of])], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")
