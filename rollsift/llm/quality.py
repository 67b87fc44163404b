"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. For each class the mean
and covariance come from sums over all labelled rows, computed on the executors
and added up by Spark; covariances shrink towards the pooled one and its
diagonal. A score is the logistic of the prior's log odds and the difference of
the two Gaussian log densities; Mahalanobis distances use Cholesky factors that
are computed once and cached with the model.

Edge cases: a null text counts as empty; an empty text has the statistics of no
words and is scored like any other; labels that repeat an id count as their
largest; with no labelled rows of a class, every score is the prior (0.5 with
no labels at all); a very long text is measured whole; repeated rows are scored
each on its own, and a labelled id counts as often as it has rows; rows without
id are scored but never learnt from; an empty table gives no rows; other columns
are ignored by ``classify`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollsift.llm.common import beside, chunks, discard, filled, held_out, materialise, whole_text, with_texts
from rollsift.llm.words import mix, words_of

FEATURES = [
    "log_bytes", "log_words", "mean_word", "spread_word", "upper", "digit", "mark", "symbol", "accent", "line",
    "distinct", "adjacent", "repeated_pairs", "repeated_lines", "short", "long", "capital", "ends_mark", "shout",
]
SHRINK_TO_POOLED = 0.05
SHRINK_TO_DIAGONAL = 0.02
RIDGE = 1e-3
ACCEPT = 0.3
PRIOR_WEIGHT = 20.0
#: Bytes that prose has few of; the other punctuation is in "mark".
_SYMBOLS = b"|$%#&*@^~<>{}[]\\=_+/"
_MARKS = b".,;:!?'\"()-"


def _table(which: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(which)] = True
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_MARK, _SYMBOL = _table(_MARKS), _table(_SYMBOLS)
_ACCENT = np.arange(256) >= 0xC0  # first bytes of characters outside ASCII
_LINE, _SHOUT = _table(b"\n"), _table(b"!")


def _share(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
    """Log odds of a share, after ``PRIOR_WEIGHT`` observations of the usual one: a short text says little."""
    return np.log((part + PRIOR_WEIGHT * usual) / (np.maximum(whole - part, 0) + PRIOR_WEIGHT * (1 - usual)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _repeats(doc: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """How many of each document's hashes had occurred before in it."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashed >> np.uint64(20)))
    again = key[1:][key[1:] == key[:-1]]
    return np.bincount((again >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """Matrix of the transformed statistics, a row for each text."""
    n = len(column)
    w = words_of(column, fold=False)
    d, b = w.data, w.bounds
    size, words = np.diff(b).astype(float), w.counts.astype(float)
    length = (w.end - w.start).astype(float)
    many = np.maximum(words, 1)
    total, squares = np.bincount(w.doc, length, n), np.bincount(w.doc, length * length, n)
    mean = total / many
    spread = np.sqrt(np.maximum(squares / many - mean * mean, 0))
    per_word = lambda flag: np.bincount(w.doc[flag], minlength=n).astype(float)
    same_doc = w.doc[1:] == w.doc[:-1]
    adjacent = per_word(np.concatenate([[False], same_doc & (w.hash[1:] == w.hash[:-1])]) if len(w.hash) else np.zeros(0, bool))
    pairs = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[same_doc]
    pair_doc = w.doc[1:][same_doc]
    # a line's hash: the sum of its words' hashes times their places
    breaks = np.flatnonzero(d == 10)
    line = np.searchsorted(breaks, w.start)
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | ~same_doc])) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(line)) - np.repeat(new, np.diff(np.concatenate([new, [len(line)]])))
    line_hash = mix(np.add.reduceat(w.hash * (2 * place + 1).astype(np.uint64), new)) if len(new) else np.zeros(0, np.uint64)
    line_doc = w.doc[new]
    lines = np.bincount(line_doc, minlength=n).astype(float)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log((total + 5 * PRIOR_WEIGHT) / (words + PRIOR_WEIGHT)), np.log1p(spread * words / (words + PRIOR_WEIGHT)),
        _share(_sums(_UPPER[d], b), total, 0.03), _share(_sums(_DIGIT[d], b), total, 0.01), _share(_sums(_MARK[d], b), total, 0.03),
        _share(_sums(_SYMBOL[d], b), total, 0.01), _share(_sums(_ACCENT[d], b), total, 0.03), _share(_sums(_LINE[d], b), words, 0.01),
        _share(_repeats(w.doc, w.hash, n), words, 0.3), _share(adjacent, words, 0.01),
        _share(_repeats(pair_doc, pairs, n), np.maximum(words - 1, 0), 0.05), _share(_repeats(line_doc, line_hash, n), lines, 0.05),
        _share(per_word(length <= 3), words, 0.35), _share(per_word(length > 12), words, 0.1),
        _share(per_word(_UPPER[d[w.start]]), words, 0.15), _share(per_word(_MARK[d[w.end - 1]] | _SYMBOL[d[w.end - 1]]), words, 0.15),
        _share(_sums(_SHOUT[d], b), words, 0.01),
    ])


def measured(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of the whole text."""
    picked = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            x = statistics(b.column("_text"))
            flat = pa.array(x.astype(np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "stats"])

    id_type = df.schema[doc_id].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {id_type}, stats array<double>")


@dataclass
class Discriminant:
    """Class means, Cholesky factors with their inverses (made once, when fitted), log determinants and prior log odds."""

    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    log_determinants: np.ndarray
    log_odds: float
    usable: bool

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From each class's row count, sum and sum of outer products."""
        d = sums.shape[1]
        if counts.sum() == 0 or counts.min() < 2:
            odds = float(np.log(counts[1] + 1) - np.log(counts[0] + 1))
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.stack([np.eye(d)] * 2), np.zeros(2), odds, False)
        means = sums / counts[:, None]
        scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / counts.sum()
        factors, logs = [], []
        for c in range(2):
            s = (1 - SHRINK_TO_POOLED) * scatter[c] / counts[c] + SHRINK_TO_POOLED * pooled
            s = (1 - SHRINK_TO_DIAGONAL) * s + SHRINK_TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
            factors.append(np.linalg.cholesky(s))
            logs.append(2 * np.log(np.diag(factors[-1])).sum())
        return cls(means, np.stack(factors), np.linalg.inv(np.stack(factors)), np.array(logs), float(np.log(counts[1] / counts[0])), True)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log_odds = np.full(len(x), self.log_odds)
        if self.usable:
            density = []
            for c in range(2):
                z = (x - self.means[c]) @ self.inverses[c].T
                density.append(-0.5 * ((z * z).sum(1) + self.log_determinants[c]))
            log_odds = log_odds + density[1] - density[0]
        return 1 / (1 + np.exp(-log_odds.clip(-500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Sums over every labelled row that isn't held out; 2 * (d*d + d + 1) numbers reach the driver."""
    d = len(FEATURES)
    known = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")).where("_y in (0, 1)")
    rows = stats.where(~held_out()).join(known, "doc_id").select("_y", "stats")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows:
                x, y = b.column("stats").flatten().to_numpy().reshape(-1, d), b.column("_y").to_numpy()
                for c in range(2):
                    part = x[y == c]
                    total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    summed = rows.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in summed:
        total[r["at"]] = r["value"]
    total = total.reshape(2, -1)
    return Discriminant.fit(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    picked = stats.select("doc_id", held_out().alias("held_out"), "stats")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(b.column("stats").flatten().to_numpy().reshape(-1, d))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    id_type = stats.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures every text once, learns from the labelled ones, scores all."""
    stats, _ = materialise(measured(df, doc_id, text), "quality-statistics")
    return score(stats, fit(stats, labels))


def accepted(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text is scored ``ACCEPT`` or more, with the same columns.

    Every text is measured once: rows and statistics are written side by side, the fit reads the statistics, the
    filter both. No join carries texts."""
    names, beside_stats = df.columns, beside(df, "_stats")
    sent, whole = with_texts(df, text)
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, whole):
            x = statistics(filled(b.column(whole)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], lists], [*names, beside_stats])

    schema = T.StructType([*df.schema.fields, T.StructField(beside_stats, T.ArrayType(T.DoubleType()))])
    rows, _ = materialise(sent.mapInArrow(measure, schema), "measured-rows")
    model = fit(rows.select(F.col(doc_id).alias("doc_id"), F.col(beside_stats).alias("stats")), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(b.column(beside_stats).flatten().to_numpy().reshape(-1, width))
                yield b.filter(pa.array(s >= ACCEPT)).select(names)

    return rows.mapInArrow(keep, df.schema)
