"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

The model file is read with a small reader of its wire format: pieces, scores
(taken as log scores) and kinds. A text gets the whitespace marker for spaces
and in front; it is cut before markers (no piece holds one after another
character) and around line breaks (no piece holds one), and only segments that
the cache lacks are searched. The Viterbi of short ones runs over many segments
at once, one array step for each position and piece length; a long segment's
pieces are found at all its positions at once, block by block, and its positions
are then gone through with back-pointers no longer than a piece. Characters that
no piece covers cost the lowest score less ten and become byte pieces.

A model whose normaliser maps characters or takes off spaces, or that doesn't
put a space in front, is refused: this reader would give other ids.

Of equally good segmentations the one found first stays: earlier starts, then
shorter pieces. Edge cases: a null text counts as empty; an empty text has no
ids; a text that holds the marker itself decodes to spaces there; very long
texts and very long runs without a space are searched whole, in time in
proportion to their length; repeated rows are encoded each on its own; an empty
table gives no rows; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import chunks, whole_text
from rollsift.llm.tokens import PieceEncoder

MARKER = "▁"
_MARK = tuple(MARKER.encode())
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
#: Segments of more bytes are searched one at a time, their pieces in blocks of positions.
LONG, BLOCK = 512, 1 << 15
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, data[at : at + size]
        at += size


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; ValueError for a normaliser that this reader doesn't know."""
    out = []
    for field, value in _fields(data):
        if field == 3:
            _plain(dict(_fields(value)))
        if field == 1:
            parts = dict(_fields(value))
            out.append((parts[1].decode(), struct.unpack("<f", parts.get(2, b"\0\0\0\0"))[0], parts.get(3, NORMAL)))
    return out


def _plain(normaliser: dict[int, int | bytes]) -> None:
    """Refuses a normaliser with a character map (2), without a space in front (3), or that removes (4) or keeps
    spaces as they are (5); an absent field has its default, true."""
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("the model's normaliser changes texts in ways that aren't supported")


class DoubleArray:
    """Trie of byte strings in two arrays: the child of ``s`` by byte ``c`` is ``base[s] + c``, if ``check`` there is ``s``."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, value in words.items():
            at = tree
            for byte in word:
                at = at.setdefault(byte, {})
            at[-1] = value
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        free_from = 1
        queue = [(0, tree)]
        while queue:
            state, node = queue.pop()
            self.value[state] = node.get(-1, -1)
            bytes_ = sorted(k for k in node if k >= 0)
            if not bytes_:
                continue
            low, span = bytes_[0], np.array(bytes_) - bytes_[0]
            while free_from < len(self.check) and self.check[free_from] >= 0:
                free_from += 1
            at = free_from
            while True:
                if at + 256 >= len(self.check):
                    self._grow()
                stop = min(at + 4096, len(self.check) - 256)
                window = np.flatnonzero(self.check[at:stop] < 0) + at
                window = window[window >= low + 1]
                fits = window[(self.check[window[:, None] + span] < 0).all(1)] if len(window) else window
                if len(fits):
                    base = int(fits[0]) - low
                    break
                at = stop
            self.base[state] = base
            for byte in bytes_:
                self.check[base + byte] = state
                queue.append((base + byte, node[byte]))

    def _grow(self) -> None:
        n = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])


class UnigramEncoder(PieceEncoder):
    """Viterbi instead of a library behind the same cache."""

    def __init__(self, model: list[tuple[str, float, int]]):
        self.model = model
        usable = [i for i, (_, _, kind) in enumerate(model) if kind in (NORMAL, USER_DEFINED)]
        self.trie = DoubleArray({model[i][0].encode(): i for i in usable})
        self.longest = max(len(model[i][0].encode()) for i in usable)
        self.scores = np.array([s for _, s, _ in model])
        self.unknown_score = min(self.scores[i] for i in usable) - UNKNOWN_PENALTY
        self.unknown = next(i for i, (_, _, kind) in enumerate(model) if kind == UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model) if kind == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.dtype = np.uint16 if len(model) <= 1 << 16 else np.uint32
        texts = [model[i][0] for i in usable]
        self.can_cut = not any(a != MARKER and b == MARKER for t in texts for a, b in zip(t, t[1:], strict=False))
        self.can_cut_lines = not any("\n" in t for t in texts)
        self.folds = False
        self.added = np.zeros(0, self.dtype)
        self._spelled: list[bytes] | None = None
        self._forget()

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.zeros(len(data), bool)
        starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        if self.can_cut and len(data) > 5:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
            starts[3:] |= mark[3:] & ~mark[:-3]
            starts[:3] |= mark[:3]
        if self.can_cut_lines and len(data) > 1:
            line = data == 10
            starts |= line
            starts[1:] |= line[:-1]
        none = np.zeros(0, np.int64)  # no added tokens
        return np.flatnonzero(starts), none, none

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.zeros(len(start), np.int32)
        found: list = [None] * len(start)
        length = end - start
        edges = [0, 8, 12, 16, 24, 32, 64, 128, LONG]
        order = np.argsort(length, kind="stable")
        sorted_length = length[order]
        for low, high in zip(edges, [*edges[1:], None], strict=True):
            rows = order[np.searchsorted(sorted_length, low, "right") : None if high is None else np.searchsorted(sorted_length, high, "right")]
            if high is None:
                for r in rows.tolist():
                    found[r] = self._long(data[start[r] : end[r]])
                    size[r] = len(found[r])
                continue
            step = 20_000
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for r, ids in zip(part.tolist(), self._viterbi(data, start[part], length[part]), strict=True):
                    found[r] = ids
                    size[r] = len(ids)
        flat = [x for ids in found for x in ids]
        return np.array(flat, self.dtype), size

    def _pieces(self, text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of all pieces that start at the positions, by start, then length."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        at = np.arange(first, last)
        state, out = np.zeros(len(at), np.int64), []
        for d in range(self.longest):
            inside = at + d < len(text)
            at, state = at[inside], state[inside]
            after = base[state] + text[at + d]
            good = (after < len(check)) & (check[np.minimum(after, len(check) - 1)] == state)
            at, state = at[good], after[good]
            if not len(at):
                break
            hit = value[state] >= 0
            out.append((at[hit], np.full(int(hit.sum()), d + 1), value[state[hit]]))
        starts, lengths, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((lengths, starts))
        return starts[order], lengths[order], ids[order]

    def _long(self, text: np.ndarray) -> list[int]:
        """The best segmentation of one long segment: pieces by blocks of positions, then one step for each piece."""
        n = len(text)
        best, piece, length = array("d", [-np.inf]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        whole, scores, unknown, unknown_score = text.tolist(), self.scores.tolist(), self.unknown, float(self.unknown_score)
        for block in range(0, n, BLOCK):
            stop = min(block + BLOCK, n)
            starts, lengths, ids = self._pieces(text, block, stop)
            cuts = np.searchsorted(starts, np.arange(block, stop + 1)).tolist()
            lengths, ids = lengths.tolist(), ids.tolist()
            for i in range(block, stop):
                byte, score = whole[i], best[i]
                if score == -np.inf or byte & 0xC0 == 0x80:
                    continue
                char = min(1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4, n - i)
                single = False
                for k in range(cuts[i - block], cuts[i - block + 1]):
                    d, p = lengths[k], ids[k]
                    single = single or d == char
                    total = score + scores[p]
                    if total > best[i + d]:
                        best[i + d], piece[i + d], length[i + d] = total, p, d
                if not single and score + unknown_score > best[i + char]:
                    best[i + char], piece[i + char], length[i + char] = score + unknown_score, unknown, char
        out, j = [], n
        while j:
            i, p = j - length[j], piece[j]
            if p == unknown:
                out += [self.byte_ids.get(b, p) for b in reversed(whole[i:j])]
            else:
                out.append(p)
            j = i
        return out[::-1]

    def _viterbi(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[list[int]]:
        n, width = len(start), int(length.max())
        at = start[:, None] + np.arange(width)
        text = np.where(np.arange(width) < length[:, None], data[np.minimum(at, len(data) - 1)], 0)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            first = text[:, i]
            rows = np.flatnonzero((length > i) & (best[:, i] > -np.inf) & ((first & 0xC0) != 0x80))
            if not len(rows):
                continue
            char = np.where(first[rows] < 0x80, 1, np.where(first[rows] < 0xE0, 2, np.where(first[rows] < 0xF0, 3, 4)))
            char = np.minimum(char, length[rows] - i)
            single = np.zeros(len(rows), bool)
            state, live, score = np.zeros(len(rows), np.int64), np.arange(len(rows)), best[rows, i]
            for d in range(min(self.longest, width - i)):
                inside = length[rows[live]] > i + d
                live, state = live[inside], state[inside]
                after = base[state] + text[rows[live], i + d]
                good = (after < len(check)) & (check[np.minimum(after, len(check) - 1)] == state)
                live, state = live[good], after[good]
                if not len(live):
                    break
                ids = value[state]
                hit = ids >= 0
                which, ids = live[hit], ids[hit]
                single[which[char[which] == d + 1]] = True
                total = score[which] + self.scores[ids]
                r, j = rows[which], i + d + 1
                better = total > best[r, j]
                r, ids, total = r[better], ids[better], total[better]
                best[r, j], came[r, j], piece[r, j] = total, i, ids
            alone = np.flatnonzero(~single)
            r, j = rows[alone], i + char[alone]
            total = score[alone] + self.unknown_score
            better = total > best[r, j]
            r, j, total = r[better], j[better], total[better]
            best[r, j], came[r, j], piece[r, j] = total, i, self.unknown
        out = []
        for k in range(n):
            ids, j = [], int(length[k])
            while j:
                i, p = int(came[k, j]), int(piece[k, j])
                if p == self.unknown:
                    ids += [self.byte_ids.get(b, p) for b in reversed(text[k, i:j].tolist())]
                else:
                    ids.append(p)
                j = i
            out.append(ids[::-1])
        return out

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, which get their markers here, and each text's bounds."""
        marked = pc.replace_substring(column.cast(pa.string()), " ", MARKER)
        marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), "", pc.binary_join_element_wise(MARKER, marked, ""))
        return self.encode(marked)

    def decode(self, ids: list[int]) -> str:
        """The text: byte pieces are joined before they are read, markers become spaces, the first goes."""
        spelled = self._spelled
        if spelled is None:
            spelled = self._spelled = [bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(MARKER, " ").encode() for i, (p, _, _) in enumerate(self.model)]
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> UnigramEncoder:
    """One encoder for each model file and Python worker."""
    with open(path, "rb") as f:
        return UnigramEncoder(read_model(f.read()))


FIELDS = "n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean"


def encode_and_decode(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces), ids_crc32, round_trip (the decoded text is the text)."""
    picked = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_text"))
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        byte_piece = np.zeros(len(enc.model), bool)
        byte_piece[list(enc.bytes_of)] = True
        for b in chunks(batches, "_text"):
            ids, bounds = enc.encode_texts(b.column("_text"))
            flags = np.concatenate([[0], np.cumsum(byte_piece[ids])])
            crc, same = [], []
            for s, e, text in zip(bounds[:-1].tolist(), bounds[1:].tolist(), b.column("_text").to_pylist(), strict=True):
                part = ids[s:e]
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                same.append(enc.decode(part.tolist()) == text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(flags[bounds[1:]] - flags[bounds[:-1]]), pa.array(crc, pa.int64()), pa.array(same)],
                ["doc_id", *(x.split()[0] for x in FIELDS.split(", "))],
            )

    return picked.mapInArrow(run, f"doc_id {id_type}, {FIELDS}")
