"""Toxicity by a small convolutional network over hashed words, trained in numpy.

A word's vector is the sum of two embeddings found by hash: the word's and its
first bytes'. Hashes that fewer than ``LEAST_TEXTS`` training texts hold (and
fewer than a ``LEAST_SHARE`` of them) have no row and count as zero, so that a
text can't be learnt by heart from its rare words. Filters of several widths
slide over the whole text, each keeps its largest response, and a linear layer
gives the log odds. Only the winning positions of a filter receive a gradient.
The first embedding column starts at the words' log odds in the labelled rows,
the rest at small random values.

Everything is learnt from all labelled rows, on the executors. Words are counted
by Spark. The rows are dealt to trainers of about ``ROWS_A_TRAINER``, anew in
each of ``EPOCHS`` rounds; every trainer starts from the same network, goes once
over its rows, and Spark averages what the trainers changed: an embedding over
those that met its word, the rest over all. A quarter of the rows, chosen by the
id's hash, is kept out of that and calibrates the scores (slope and intercept, at
the labels' class shares) and sets a threshold for each language; languages
without enough of them use the common threshold. Their log odds are counted in
steps of 1 / ``STEPS``, so that the driver gets a table of steps and not of rows.

Edge cases: a null text counts as empty; an empty text pools nothing and gets
the network's bias; very long texts are learnt from and scored whole; repeated
rows are scored each on its own, and a labelled id counts as often as it has
rows; labels that repeat an id count as their largest; rows without id are scored
but never learnt from; with no labelled rows of a class, every score is the prior
(0.5 with none at all); an empty table gives no rows; other columns are ignored
by ``classify`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import CHUNK_BYTES, beside, chunks, discard, filled, give_back, held_out, materialise, whole_text, with_texts
from rollsift.llm.words import words_of

#: Bounds of ``_sampled``, which no query uses.
SAMPLE_A_CLASS = 2000
SAMPLE_WORDS = 1_500_000
LEAST_TEXTS, LEAST_SHARE = 4, 2e-5
ROWS_A_TRAINER = 3000
DIMENSIONS = 16
#: Filters of each width.
FILTERS = {1: 16, 2: 8, 3: 8}
PREFIX_BYTES = 4
EPOCHS, BATCH, RATE, DECAY = 3, 64, 0.02, 1e-4
THRESHOLD = 0.5
#: Words whose filter responses are held at once; longer texts are pooled block by block.
WORDS_AT_ONCE = 1 << 15
#: Calibration rows of each class that a language needs for a threshold of its own.
LEAST_ROWS = 20
#: Steps of a unit of log odds in calibration, which ends at +-``FARTHEST``.
STEPS, FARTHEST = 128, 40
#: Pairs (text, hash) that a task counts before it sends what it has.
PAIRS_AT_ONCE = 1 << 18
#: Averages are of whole numbers of 1 / ``UNIT``.
UNIT = float(1 << 36)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its prefix, over all texts, and the number of words of each text."""
    w = words_of(column, inside_bytes=_LETTERS)
    return np.stack([w.hash, ~w.prefix_hash(PREFIX_BYTES)], 1), w.counts


def rows_of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash among the sorted keys; unknown ones get the row after the last."""
    at = np.searchsorted(keys, hashes)
    known = at < len(keys)
    if len(keys):
        known &= keys[np.minimum(at, len(keys) - 1)] == hashes
    return np.where(known, at, len(keys)).astype(np.int32)


@dataclass
class Network:
    """Parameters; ``tables`` are the filters' responses to each row, so that scoring is look-ups and sums."""

    keys: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: dict[int, np.ndarray]
    offset: float
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    tables: np.ndarray | None = None

    def freeze(self) -> Network:
        parts = [self.embedding @ self.filters[w][k] for w in FILTERS for k in range(w)]
        self.tables = np.concatenate(parts, 1).astype(np.float32)
        return self

    def log_odds(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Uncalibrated, for texts that follow each other in ``ids``."""
        return self._log_odds(ids, counts, lambda hashes: rows_of(self.keys, hashes))

    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same from the words' rows."""
        return self._log_odds(rows, counts, lambda x: x)

    def _log_odds(self, ids: np.ndarray, counts: np.ndarray, row: Callable) -> np.ndarray:
        out = np.full(len(counts), self.offset)
        some = counts > 0
        doc = np.repeat(np.arange(some.sum()), counts[some])
        best = {w: np.full((some.sum(), n), -np.inf, np.float32) for w, n in FILTERS.items()}
        for start in range(0, len(ids), WORDS_AT_ONCE):
            # the block's own words, and those after it that its last windows reach
            stop = start + WORDS_AT_ONCE + max(FILTERS) - 1
            part, of = ids[start:stop], doc[start:stop]
            own = min(WORDS_AT_ONCE, len(part))
            response = self.tables[row(part[:, 0])]
            response += self.tables[row(part[:, 1])]
            texts, first = np.unique(of[:own], return_index=True)
            at = 0
            for w, n in FILTERS.items():
                total = response[:own, at : at + n].copy()
                for k in range(1, w):
                    m = max(min(own, len(part) - k), 0)
                    total[:m] += response[k : k + m, at + k * n : at + (k + 1) * n] * (of[k : k + m] == of[:m])[:, None]
                at += w * n
                best[w][texts] = np.maximum(best[w][texts], np.maximum.reduceat(total, first, axis=0))
        for w in FILTERS:
            out[some] += np.maximum(best[w] + self.bias[w], 0) @ self.out[w]
        return out

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.log_odds(ids, counts) + self.intercept).clip(-500, 500)))


def _started(keys: np.ndarray, seen: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Network:
    """The network before training. seen: how many texts of each class hold a key, n: the classes' texts."""
    lift = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    e = rng.normal(0, 0.05, (len(keys) + 1, DIMENSIONS)).astype(np.float32)
    e[:-1, 0] = lift * 0.3 * np.minimum(seen.sum(0) / 20, 1)
    e[-1] = 0
    filters = {w: rng.normal(0, 0.2, (w, DIMENSIONS, k)).astype(np.float32) for w, k in FILTERS.items()}
    for w in FILTERS:
        filters[w][:, 0, 0] = 1.0
    zero = {w: np.zeros(k, np.float32) for w, k in FILTERS.items()}
    net = Network(keys, e, filters, zero, {w: rng.normal(0, 0.1, k).astype(np.float32) for w, k in FILTERS.items()}, -2.0)
    for w in FILTERS:
        net.out[w][0] = 1.0
    return net


class Learner:
    """A network in training: Adagrad for the embeddings, Adam for the rest. ``touched``: rows that got a gradient."""

    def __init__(self, net: Network, weight: np.ndarray):
        self.net, self.weight, self.steps = net, weight, 0
        self.squares = np.full(len(net.embedding), 1e-8)
        self.touched = np.zeros(len(net.embedding), bool)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self._dense().items()}

    def _dense(self) -> dict:
        net = self.net
        return {("f", w): net.filters[w] for w in FILTERS} | {("b", w): net.bias[w] for w in FILTERS} | {("o", w): net.out[w] for w in FILTERS} | {"offset": np.array(net.offset)}

    def dense(self) -> np.ndarray:
        """All but the embeddings, with their moments."""
        parts = [x for k, v in self._dense().items() for x in (v, *self.moments[k])]
        return np.concatenate([np.asarray(x, float).ravel() for x in parts])

    def set_dense(self, flat: np.ndarray) -> None:
        at = 0

        def taken(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return flat[at - like.size : at].reshape(like.shape)

        for k, v in self._dense().items():
            value, m, s = taken(v), taken(v), taken(v)
            self.moments[k] = m, s
            if k == "offset":
                self.net.offset = float(value)
            else:
                {"f": self.net.filters, "b": self.net.bias, "o": self.net.out}[k[0]][k[1]] = value.astype(np.float32)

    def _adam(self, key, value, gradient):
        m, v = self.moments[key]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        self.moments[key] = m, v
        return (value - RATE * 0.25 * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8) - RATE * DECAY * value).astype(np.float32)

    def step(self, ids: list[np.ndarray], t: np.ndarray) -> None:
        """One batch. ids: rows of the words' and prefixes' embeddings, for texts that aren't empty."""
        net = self.net
        self.steps += 1
        counts = np.array([len(x) for x in ids])
        x = np.concatenate(ids)
        first = np.cumsum(counts) - counts
        end = np.repeat(first + counts, counts)
        vectors = net.embedding[x[:, 0]] + net.embedding[x[:, 1]]
        pooled, places, logit = {}, {}, np.full(len(ids), net.offset)
        for w, k in FILTERS.items():
            total = vectors @ net.filters[w][0]
            for j in range(1, w):
                total[:-j] += (vectors[j:] @ net.filters[w][j]) * (np.arange(j, len(x)) < end[:-j])[:, None]
            places[w] = np.stack([first[d] + total[first[d] : first[d] + counts[d]].argmax(0) for d in range(len(ids))])
            pooled[w] = np.maximum(total[places[w], np.arange(k)] + net.bias[w], 0)
            logit += pooled[w] @ net.out[w]
        d_logit = (1 / (1 + np.exp(-logit.clip(-50, 50))) - t) * self.weight[t] / len(ids)
        touched, changes = [], []
        for w in FILTERS:
            d_pool = d_logit[:, None] * net.out[w] * (pooled[w] > 0)
            d_filter = np.zeros_like(net.filters[w])
            for j in range(w):
                at_word = places[w] + j
                valid = at_word < end[places[w]]
                at_word = np.where(valid, at_word, 0)
                g = d_pool * valid
                d_filter[j] = np.einsum("rkd,rk->dk", vectors[at_word], g)
                d_vector = np.einsum("dk,rk->rkd", net.filters[w][j], g).reshape(-1, DIMENSIONS)
                for column in (0, 1):
                    touched.append(x[at_word, column].ravel())
                    changes.append(d_vector)
            d_out = pooled[w].T @ d_logit
            net.filters[w] = self._adam(("f", w), net.filters[w], d_filter)
            net.bias[w] = self._adam(("b", w), net.bias[w], d_pool.sum(0))
            net.out[w] = self._adam(("o", w), net.out[w], d_out)
        net.offset = float(self._adam("offset", np.array(net.offset), np.array(d_logit.sum())))
        buckets, which = np.unique(np.concatenate(touched), return_inverse=True)
        gradient = np.zeros((len(buckets), DIMENSIONS))
        np.add.at(gradient, which, np.concatenate(changes))
        self.squares[buckets] += (gradient * gradient).mean(1)
        net.embedding[buckets] -= (RATE * gradient / np.sqrt(self.squares[buckets])[:, None]).astype(np.float32)
        net.embedding[-1] = 0
        self.touched[buckets] = True


def train(ids: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Network:
    """Fits a network to the texts' word hashes, all in one place; classes weigh the same."""
    rng = np.random.Generator(np.random.PCG64(seed))
    once = [np.unique(x) for x in ids]
    n = np.bincount(y, minlength=2)
    keys, texts = np.unique(np.concatenate(once), return_counts=True)
    keys = keys[texts >= LEAST_TEXTS]
    seen = np.stack([np.bincount(rows_of(keys, np.concatenate([x for x, t in zip(once, y, strict=True) if t == c])), minlength=len(keys) + 1)[:-1] for c in (0, 1)])
    ids = [np.stack([rows_of(keys, x[:, 0]), rows_of(keys, x[:, 1])], 1) for x in ids]
    learner = Learner(_started(keys, seen, n, rng), len(y) / (2 * np.maximum(n, 1)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = [r for r in order[at : at + BATCH] if len(ids[r])]
            if rows:
                learner.step([ids[r] for r in rows], y[rows])
    return learner.net.freeze()


def calibrate(net: Network, log_odds: np.ndarray, y: np.ndarray, languages: list, shares: np.ndarray, times: np.ndarray | None = None) -> None:
    """Slope and intercept by weighted logistic regression (Newton), then a threshold for each language.

    times: how many rows each entry stands for (one)."""
    times = np.ones(len(y)) if times is None else times
    n = np.bincount(y, times, 2)
    if n.min() < 2:
        return
    weight = (shares / n)[y] * times.sum() * times
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * log_odds + b).clip(-50, 50)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * log_odds).sum() + 0.01 * (a - 1), g.sum()])
        hessian = np.array([[(h * log_odds**2).sum() + 0.01, (h * log_odds).sum()], [(h * log_odds).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient).clip(-1, 1)
        a, b = a - step[0], b - step[1]
    net.slope, net.intercept = max(float(a), 1e-3), float(b)
    score = 1 / (1 + np.exp(-(net.slope * log_odds + net.intercept).clip(-500, 500)))
    names = np.array([x if x is not None else "" for x in languages])
    for name in sorted(set(names)):
        s, t, v = score[names == name], y[names == name], weight[names == name]
        if min(np.bincount(t, times[names == name], 2)) < LEAST_ROWS:
            continue
        cuts = np.concatenate([[THRESHOLD], (np.sort(s)[1:] + np.sort(s)[:-1]) / 2])
        cuts = cuts[(cuts >= 0.1) & (cuts <= 0.9)]
        errors = [(v * ((s >= c) != t)).sum() for c in cuts]
        best = min(range(len(cuts)), key=lambda i: (round(errors[i], 9), abs(cuts[i] - THRESHOLD)))
        net.thresholds[str(name)] = float(cuts[best])


def _untrained(n: np.ndarray) -> Network:
    """Gives every text the share of the class."""
    none = {w: np.zeros(k) for w, k in FILTERS.items()}
    return Network(np.zeros(0, np.uint64), np.zeros((1, DIMENSIONS)), {w: np.zeros((w, DIMENSIONS, k)) for w, k in FILTERS.items()}, none, none, 0.0, constant=float((n[1] + 1) / (n.sum() + 2))).freeze()


def _sampled(df: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, lang: str | None) -> tuple[pa.Table, np.ndarray]:
    """For trials on one machine with ``train``: (id, y, lang, ids) of some labelled rows, in a fixed order, and the classes' sizes; the sample's ids are broadcast,
    at most ``2 * SAMPLE_A_CLASS``, and at most ``2 * SAMPLE_WORDS`` words reach the driver."""
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_y")).where("_y in (0, 1)").where(~held_out("_id"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = np.array([totals.get(0, 0), totals.get(1, 0)], float)
    by_hash = [known.where(f"_y = {c}").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_A_CLASS) for c in (0, 1)]
    sample = by_hash[0].unionByName(by_hash[1]).collect()
    place = {r["_id"]: i for i, r in enumerate(sample)}
    picked = df.sparkSession.createDataFrame([tuple(r) for r in sample], "_id long, _y int")
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), whole_text(text).alias("_text"), language.alias("_lang")).join(F.broadcast(picked), "_id")
    # repeated rows of an id fall together before anything is sent
    one = F.min_by(F.struct("_y", "_text", "_lang"), F.struct(F.xxhash64("_text"), F.xxhash64("_lang"))).alias("_one")
    rows = rows.groupBy("_id").agg(one).select("_id", "_one.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            ids, counts = word_ids(b.column("_text"))
            flat = np.ascontiguousarray(ids.astype("<u8"))
            last = np.cumsum(counts)
            packed = [flat[e - k : e].tobytes() if k <= SAMPLE_WORDS else None for e, k in zip(last.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), b.column("_lang"), pa.array(packed, pa.binary()), pa.array(counts, pa.int64())], ["id", "y", "lang", "ids", "words"])

    rows, path = materialise(rows.mapInArrow(run, "id long, y int, lang string, ids binary, words long"), "training-rows", "zstd")
    kept, used = [], [0, 0]
    for r in sorted(rows.select("id", "y", "words").collect(), key=lambda r: place[r["id"]]):
        if used[r["y"]] + r["words"] <= SAMPLE_WORDS:
            used[r["y"]] += r["words"]
            kept.append(r["id"])
    wanted = df.sparkSession.createDataFrame([(i,) for i in kept], "id long")
    got = rows.join(F.broadcast(wanted), "id").select("id", "y", "lang", "ids").toArrow()
    discard(df.sparkSession, path)
    return got.take(pa.compute.sort_indices(got, [("id", "ascending")])), n


def _labelled(df: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, lang: str | None) -> tuple[DataFrame, str]:
    """(id, y, lang, kept, ids) of every labelled row that isn't held out, as a table, and its path."""
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_y")).where("_y in (0, 1)").where(~held_out("_id"))
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    texts = df.select(F.col(doc_id).cast("long").alias("_id"), whole_text(text).alias("_text"), language.alias("_lang")).where(F.col("_id").isNotNull() & ~held_out("_id"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in chunks(batches, "_text"):
            raw = [x.as_buffer() for x in b.column("_text")]
            packed = pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_lang"), packed, pa.array([x.size for x in raw], pa.int64())], ["_id", "_lang", "_packed", "_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in chunks(batches, "_packed", CHUNK_BYTES // 4):
            raw = [codec.decompress(x.as_buffer(), n, asbytes=True) for x, n in zip(b.column("_packed"), b.column("_bytes").to_pylist(), strict=True)]
            ids, counts = word_ids(pa.array(raw, pa.large_binary()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), b.column("_lang"), b.column("_kept"), _packed(ids.astype("<u8"), counts)], ["id", "y", "lang", "kept", "ids"])

    # texts that move are compressed
    rows = texts.mapInArrow(small, "_id long, _lang string, _packed binary, _bytes long").join(known.hint("shuffle_hash"), "_id")
    sent = rows.withColumn("_kept", F.pmod(F.xxhash64("_id", F.lit("kept")), F.lit(4)) == 0)
    return materialise(sent.mapInArrow(run, "id long, y int, lang string, kept boolean, ids binary"), "labelled-words", "zstd")


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Pairs of all texts as one binary value a text."""
    flat, last = np.ascontiguousarray(ids), np.cumsum(counts)
    return pa.array([flat[e - k : e].tobytes() for e, k in zip(last.tolist(), counts.tolist(), strict=True)], pa.binary())


def _vocabulary(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that ``least`` texts or more hold, and how many texts of each class hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = ([], []), 0

        def counted() -> pa.RecordBatch:
            found = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for p in pieces]
            key = np.concatenate([k for k, _ in found]).view(np.int64)
            n = [np.concatenate([m if c == of else np.zeros_like(m) for of, (_, m) in enumerate(found)]) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[0]), pa.array(n[1])], ["key", "n0", "n1"])

        for b in batches:
            for ids, y in zip(b.column("ids"), b.column("y").to_pylist(), strict=True):
                once = np.unique(np.frombuffer(ids.as_buffer(), "<u8"))
                pieces[y].append(once)
                held += len(once)
                if held >= PAIRS_AT_ONCE:
                    yield counted()
                    pieces, held = ([], []), 0
        if held:
            yield counted()

    sums = rows.mapInArrow(run, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = sums.where(F.col("n0") + F.col("n1") >= least).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([got.column(c).to_numpy()[order] for c in ("n0", "n1")])


def _round(rows: DataFrame, learner: Learner, trainers: int, turn: int) -> None:
    """Every trainer goes once over its rows, from the learner's state; the learner takes the averages."""
    spark, width = rows.sparkSession, DIMENSIONS + 1
    shared = spark.sparkContext.broadcast(learner)
    names = ["at", *[f"v{k}" for k in range(width)]]

    def changes(own: Learner, before: Learner) -> pa.RecordBatch:
        at = np.flatnonzero(own.touched)
        embedded = np.column_stack([(own.net.embedding[at] - before.net.embedding[at]).astype(float), own.squares[at] - before.squares[at]])
        flat = own.dense()
        flat = np.concatenate([flat, np.zeros(-len(flat) % width)]).reshape(-1, width)
        both = np.concatenate([embedded, flat])
        where = np.concatenate([at, -1 - np.arange(len(flat))])
        return pa.RecordBatch.from_arrays([pa.array(where), *[pa.array(np.ascontiguousarray(both[:, k])) for k in range(width)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trainer, ids, y, words = None, None, [], [], 0
        for b in batches:
            for no, t, x in zip(b.column("trainer").to_pylist(), b.column("y").to_pylist(), b.column("ids"), strict=True):
                pairs = np.frombuffer(x.as_buffer(), "<i4").reshape(-1, 2)
                # a batch ends with its trainer, with its texts or with its words
                if ids and (no != trainer or len(ids) == BATCH or words + len(pairs) > WORDS_AT_ONCE):
                    own.step(ids, np.array(y))
                    ids, y, words = [], [], 0
                if no != trainer:
                    if own is not None:
                        yield changes(own, shared.value)
                    own, trainer = copy.deepcopy(shared.value), no
                if len(pairs):
                    ids.append(pairs.copy())
                    y.append(t)
                    words += len(pairs)
        if ids:
            own.step(ids, np.array(y))
        if own is not None:
            yield changes(own, shared.value)
        give_back()

    dealt = rows.withColumn("trainer", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(trainers)).cast("int")).withColumn("_order", F.xxhash64("id", F.lit(-1 - turn)))
    dealt = dealt.repartitionById(trainers, "trainer").sortWithinPartitions("trainer", "_order", "id", F.xxhash64("ids")).select("trainer", "y", "ids")
    made, path = materialise(dealt.mapInArrow(run, "at long, " + ", ".join(f"{n} double" for n in names[1:])), "trained")
    # sums of whole numbers don't hang on the order that trainers end in
    mean = lambda n: (F.sum(F.rint(F.col(n) * F.lit(UNIT)).cast("long")) / F.count(n) / F.lit(UNIT)).alias(n)
    got = made.groupBy("at").agg(*[mean(n) for n in names[1:]]).toArrow()
    discard(spark, path)
    shared.destroy()
    at = got.column("at").to_numpy()
    values = np.column_stack([got.column(n).to_numpy() for n in names[1:]])
    learner.net.embedding[at[at >= 0]] += values[at >= 0, :-1].astype(np.float32)
    learner.squares[at[at >= 0]] += values[at >= 0, -1]
    flat = values[at < 0][np.argsort(-at[at < 0])].ravel()
    learner.set_dense(flat[: len(learner.dense())])


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> Network:
    """Learns from every labelled row that isn't held out. The driver gets the vocabulary, the trainers' averages and a
    table of steps of log odds."""
    spark = df.sparkSession
    words, path = _labelled(df, labels, label, doc_id, text, lang)
    sizes = np.zeros((2, 2))  # by class, and whether kept
    for r in words.groupBy("y", "kept").count().collect():
        sizes[r["y"], int(r["kept"])] = r["count"]
    n = sizes.sum(1)
    if n.min() < 2:
        discard(spark, path)
        return _untrained(n)
    apart = sizes.min() >= 2  # else the same rows teach and calibrate
    learnt = words.where("not kept") if apart else words
    m = sizes[:, 0] if apart else n
    keys, seen = _vocabulary(learnt, max(LEAST_TEXTS, int(np.ceil(m.sum() * LEAST_SHARE))))
    shared = spark.sparkContext.broadcast(keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ids"):
            ids = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("ids")]
            places = rows_of(shared.value, np.concatenate(ids)).astype("<i4").reshape(-1, 2)
            counts = np.array([len(x) // 2 for x in ids])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "y", "lang", "kept")], _packed(places, counts)], ["id", "y", "lang", "kept", "ids"])

    rows, numbered = materialise(words.mapInArrow(number, words.schema), "labelled-rows", "zstd")
    discard(spark, path)
    learner = Learner(_started(keys, seen, m, np.random.Generator(np.random.PCG64(7))), m.sum() / (2 * np.maximum(m, 1)))
    trainers = max(1, int(m.sum()) // ROWS_A_TRAINER)
    for turn in range(EPOCHS):
        _round(rows.where("not kept") if apart else rows, learner, trainers, turn)
        learner.steps += max(1, int(m.sum()) // trainers // BATCH)
    net = learner.net.freeze()
    _calibrated(net, rows.where("kept") if apart else rows, n / n.sum())
    discard(spark, numbered)
    give_back()
    return net


def _calibrated(net: Network, rows: DataFrame, shares: np.ndarray) -> None:
    """``calibrate`` by all rows: how many of a class and a language lie on each step of log odds."""
    shared = rows.sparkSession.sparkContext.broadcast(_light(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ids"):
            ids = [np.frombuffer(x.as_buffer(), "<i4").reshape(-1, 2) for x in b.column("ids")]
            odds = shared.value.pooled(np.concatenate(ids), np.array([len(x) for x in ids]))
            step = np.rint(odds.clip(-FARTHEST, FARTHEST) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("lang"), pa.array(step)], ["y", "lang", "step"])

    got = rows.mapInArrow(run, "y int, lang string, step long").groupBy("y", "lang", "step").count().orderBy("lang", "step", "y").collect()
    calibrate(net, np.array([r["step"] / STEPS for r in got]), np.array([r["y"] for r in got]), [r["lang"] for r in got], shares, np.array([float(r["count"]) for r in got]))


def _scored(texts: pa.Array, languages: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and whether they reach the threshold of the row's language."""
    s = net.score(*word_ids(texts))
    limit = np.array([net.thresholds.get(x, THRESHOLD) for x in languages.to_pylist()])
    return s, s >= limit


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (0.5 or more) and flagged (the language's threshold or more)."""
    shared = df.sparkSession.sparkContext.broadcast(_light(fit(df, labels, doc_id=doc_id, text=text, lang=lang)))
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    picked = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), whole_text(text).alias("_text"), language.alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            s, flagged = _scored(b.column("_text"), b.column("_lang"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(flagged)],
                ["doc_id", "held_out", "score", "predicted", "flagged"],
            )

    id_type = df.schema[doc_id].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, flagged boolean")


def _light(net: Network) -> Network:
    """What scoring needs: a row for each hash that training kept, bounded by the sample."""
    return Network(net.keys, np.zeros((0, DIMENSIONS)), {}, net.bias, net.out, net.offset, net.slope, net.intercept, net.thresholds, net.constant, net.tables)


def accepted(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The rows that aren't flagged, with the same columns."""
    shared = df.sparkSession.sparkContext.broadcast(_light(fit(df, labels, doc_id=doc_id, text=text, lang=lang)))
    names, tongue = df.columns, beside(df, "_lang")
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    sent, whole = with_texts(df.withColumn(tongue, language), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, whole):
            yield b.filter(pa.array(~_scored(filled(b.column(whole)), b.column(tongue), shared.value)[1])).select(names)

    return sent.mapInArrow(run, df.schema)
