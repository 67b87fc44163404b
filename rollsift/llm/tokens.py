"""Encoding with the tokenizers library, piece by piece through a bounded cache.

A text is cut only where the vocabulary's own splitting starts a new token
anyway: around added tokens such as <|endoftext|>, which are one id each, before
a space that a non-space follows, and between a letter and ASCII punctuation. The ids therefore equal those of encoding the whole text at once,
and most pieces cost an array look-up: pieces are found and hashed (64 bits) by
numpy, the cache is a pair of hash tables, and only pieces it lacks reach the
library, each once. The cache is bounded and lives in the Python worker, so
tasks that share a worker share it.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from rollsift.llm.words import FOLD, spans_hash, text_bytes

#: Slots of each of the cache's two tables, and ids it may hold in all.
SLOTS = 1 << 20
POOL_IDS = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
# Bytes that may begin white space: ASCII, and the first bytes of U+0085, U+00A0, U+1680, U+2000 and others, U+3000.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes of U+00C0 to U+00FF but the two signs among the letters.
_LATIN_LETTER = np.zeros(256, bool)
_LATIN_LETTER[0x80:0xC0] = True
_LATIN_LETTER[[0x97, 0xB7]] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start; every text that has bytes starts one."""
    starts = np.zeros(len(data), bool)
    if len(data) > 1:
        left, right = data[:-1], data[1:]
        starts[:-1] = _SPACE[left] & ~_MAY_BE_SPACE[right]
        letter = _ASCII_LETTER[left].copy()
        letter[1:] |= (left[:-1] == 0xC3) & _LATIN_LETTER[left[1:]]
        starts[1:] |= letter & _PUNCTUATION[right]
    starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    # a space at a text's end begins nothing: what follows it belongs to another text
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    alone = starts[last] & _SPACE[data[last]] & ~np.isin(last, bounds[:-1])
    starts[last[alone]] = False
    return np.flatnonzero(starts)


class PieceEncoder:
    """ids of whole texts. path: a tokenizers JSON file, which the workers must see too."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.can_cut = self._can_cut(spec)
        added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens") or [] if t["content"]}
        #: Ids of the added tokens, which begin the pool, and the place of each there.
        self.added = np.array([*added.values()], self.dtype)
        self.added_at = {content: i for i, content in enumerate(added)}
        # of those that match at one place the library takes the longest
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        #: Space is dropped and case folded: a piece of ASCII needs neither its space nor its capitals.
        self.folds = self.can_cut and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.ascii = self.tokenizer
        if self.folds:  # of the normalisers only lower case changes ASCII
            self.ascii = Tokenizer.from_file(path)
            self.ascii.encode_special_tokens = True  # added tokens have their ids already: what folds to one isn't one
            self.ascii.normalizer = normalizers.Lowercase()
        self._forget()

    @staticmethod
    def _can_cut(spec: dict) -> bool:
        """The vocabulary splits as the cuts assume: the byte-level pattern, or one that drops white space."""
        plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        if any(t[k] is not v for t in spec.get("added_tokens") or [] for k, v in plain.items()):
            return False
        pre = spec.get("pre_tokenizer") or {"type": None}
        if pre["type"] == "ByteLevel":
            return pre["use_regex"] and not pre["add_prefix_space"]
        first = pre.get("pretokenizers", [{}])[0]
        return first.get("behavior") == "Removed" and first.get("invert") is True and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")

    def _forget(self) -> None:
        self.keys = np.zeros((2, SLOTS), np.uint64)
        self.at = np.zeros((2, SLOTS), np.int32)
        self.size = np.zeros((2, SLOTS), np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), len(self.added)
        self.pool[: self.used] = self.added

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one piece's after the other's, and how many each has."""
        texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        got: list = [None] * len(texts)
        for tokenizer, plain in ((self.ascii, True), (self.tokenizer, False)):
            which = [i for i, t in enumerate(texts) if t.isascii() is plain]
            for i in range(0, len(which), 4096):
                part = which[i : i + 4096]
                for j, e in zip(part, tokenizer.encode_batch_fast([texts[j] for j in part], add_special_tokens=False), strict=True):
                    got[j] = e.ids
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(size.sum())), size

    def _ask(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces and adds their ids to the pool: places and sizes there."""
        ids, size = self._ids_of(data, start, end)
        total = len(ids)
        if self.used + total > len(self.pool):
            grown = np.zeros(2 * (self.used + total), self.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + total] = ids
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        self.used += total
        return at, size

    @staticmethod
    def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(SLOTS - 1)
        return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the column, one after the other, and where each text's begin and end.

        end_id: appended to each text."""
        data, bounds = text_bytes(column)
        n = len(bounds) - 1
        start, added, added_at = self._starts(data, bounds)
        end = np.append(start[1:], len(data))
        doc = np.searchsorted(bounds, start, side="right") - 1
        if self.folds and len(start):
            plain = np.maximum.reduceat(data, start) < 128
            data = np.where(np.repeat(plain, end - start), FOLD[data], data)
            start = start + (_SPACE[data[start]] & (end - start > 1))
        keys = spans_hash(data, start, end)
        keys[keys == 0] = 1
        if self.used > POOL_IDS:
            self._forget()
        first, second = self._slots(keys)
        hit = self.keys[0][first] == keys
        at, size = self.at[0][first], self.size[0][first]
        hit[added], at[added], size[added] = True, added_at, 1
        rest = np.flatnonzero(~hit)
        slot = second[rest]
        again = self.keys[1][slot] == keys[rest]
        at[rest[again]], size[rest[again]] = self.at[1][slot[again]], self.size[1][slot[again]]
        rest = rest[~again]
        if len(rest):
            new, where, which = np.unique(keys[rest], return_index=True, return_inverse=True)
            new_at, new_size = self._ask(data, start[rest[where]], end[rest[where]])
            at[rest], size[rest] = new_at[which], new_size[which]
            self._put(new, new_at, new_size)
        per_doc = np.bincount(doc, size, n).astype(np.int64)
        extra = int(end_id is not None)
        ends = np.cumsum(per_doc + extra)
        size = size.astype(np.int64)
        total = int(per_doc.sum())
        source = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)
        if not extra:
            return self.pool[source], np.append(0, ends)
        out = np.full(total + n, end_id, self.dtype)
        out[np.arange(total) + np.repeat(np.arange(n), per_doc)] = self.pool[source]
        return out, np.append(0, ends)

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start, which pieces are added tokens, and the places of their ids in the pool."""
        none = np.zeros(0, np.int64)
        if not self.can_cut:
            return bounds[:-1][bounds[:-1] < bounds[1:]], none, none
        found = self._added_in(data, bounds)
        if not found:
            return pieces(data, bounds), none, none
        left, right, place = np.array(found, np.int64).T
        # what lies between added tokens is split like a text of its own
        start = pieces(data, np.sort(np.concatenate([bounds, left, right])))
        token = np.searchsorted(left, start, side="right") - 1
        start = start[(token < 0) | (start == left[token]) | (start >= right[token])]
        return start, np.searchsorted(start, left), place

    def _added_in(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and place in the pool of each added token of the texts."""
        if self.added_pattern is None or not self.added_pattern.search(data):
            return []
        found, raw = [], data.tobytes()
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # no match spans two texts
            found += [(*m.span(), self.added_at[m.group()]) for m in self.added_pattern.finditer(raw, s, e)]
        return found

    def _put(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Takes free slots of the first table, then of the second; what finds none isn't kept."""
        for way in (0, 1):
            slot = self._slots(keys)[way]
            free = self.keys[way][slot] == 0
            self.keys[way][slot[free]] = keys[free]
            won = self.keys[way][slot] == keys
            self.at[way][slot[won]], self.size[way][slot[won]] = at[won], size[won]
            keys, at, size = keys[~won], at[~won], size[~won]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker."""
    return PieceEncoder(path)
