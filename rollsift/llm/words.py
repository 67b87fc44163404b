"""Words of many texts as numpy arrays: no Python loop over words.

A word is a run of bytes outside space and \\x09-\\x0D. Its hash is a polynomial
over random byte values modulo 2**64, taken from prefix sums; equal words have
equal hashes in every process. Case is folded for A-Z only, on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, np.uint64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_cached_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ...: n of them, kept for the next call."""
    known = _cached_powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, np.uint64)
        known[0] = 1
        known = _cached_powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


@dataclass
class Words:
    """Arrays over the words of all texts, in order; ``doc`` is the text's row."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes."""
        return self._hash(np.minimum(self.start + n, self.end))

    def _hash(self, end: np.ndarray) -> np.ndarray:
        inverse = _powers(_INVERSE, len(self.data) + 1)[self.start]
        return mix((self.sums[end] - self.sums[self.start]) * inverse + (end - self.start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and each text's bounds in them. Nulls are not expected."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the bytes; equal spans have equal hashes in every process."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(MULTIPLIER, len(data)), out=sums[1:])
    inverse = _powers(_INVERSE, len(data) + 1)[start]
    return mix((sums[end] - sums[start]) * inverse + (end - start).astype(np.uint64))


def words_of(column: pa.Array, fold: bool = True, inside_bytes: np.ndarray | None = None) -> Words:
    """Words of a column of texts. inside_bytes: for each byte, whether words hold it."""
    data, bounds = text_bytes(column)
    n = len(bounds) - 1
    if fold:
        data = FOLD[data]
    inside = ~_IS_SPACE[data] if inside_bytes is None else inside_bytes[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = bounds[:-1][(bounds[:-1] < bounds[1:])]
    first[cut] = inside[cut]  # a word ends with its text
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = bounds[1:][(bounds[:-1] < bounds[1:])] - 1
    last[ends] = inside[ends]
    end = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(MULTIPLIER, len(data)), out=sums[1:])
    doc = np.searchsorted(bounds, start, side="right") - 1
    words = Words(data, bounds, start, end, doc, sums, np.bincount(doc, minlength=n), sums)
    words.hash = words._hash(end)
    return words
