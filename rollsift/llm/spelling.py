"""Spelling variants: words one edit apart, by forward and reversed dictionaries.

One inserted, deleted or replaced code point leaves a half of the shorter word, rounded down, at the front of both words
or at the back of both. So words of lengths n and n + 1 that share their first n // 2 code points are a block of the
forward dictionary, and those that share their last n // 2 one of the reversed dictionary; every near pair is in a block.
A block of more than ``BLOCK`` words is cut anew by the same rule on what lies between the shared parts: by the next
half of the rest or by its last half. Rests of one code point aren't cut: such words are near each other, and are as many
as the alphabet has letters. Blocks are then compared inside, and pairs verified.

Words are counted before anything moves, near pairs are kept once each, and a word's pairs are folded into a count and a
best one before they meet. Roots come from pointer doubling over the words that have a form.

Edge cases: null and wordless texts give no words; rows without id give words with nothing deleted; rows that repeat an
id count each; an empty table gives no rows; other columns are ignored. ``n_near`` and forms are over whole dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import discard, materialise, spread_join

LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO = 5, 3, 2, 97
#: Words of a block that are compared with each other; larger blocks are cut.
BLOCK = 512

#: Code points that are compared at once, so that a task's arrays stay small whatever the words.
COMPARED = 4_000_000

#: What tells blocks apart.
AT = ["short", "path", "front", "back", "key"]

#: What stands between runs of letters.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dictionary(documents: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): lower-cased runs of letters, some with a code point deleted, of ``letters`` or more and seen ``least`` times."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = documents.select("doc_id", F.explode_outer(F.split(lowered, BETWEEN)).alias("run")).where("run <> ''")
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % typo == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _key(front: Column, back: Column) -> Column:
    """What a word shares with its block: its first ``front`` and last ``back`` code points."""
    return F.concat(F.substring("word", F.lit(1), front), F.lit(" "), F.substring("word", F.length("word") - back + 1, back))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(short, path, front, back, key, word, n): each word in its blocks; ``short`` is the length of a block's shorter words.

    ``path`` tells the cuts that led to a block, a bit each after a leading 1: 0 for the front, 1 for the back."""
    length = F.length("word")
    each = words.withColumn("short", F.explode(F.array(length, length - 1))).withColumn("_half", F.floor(F.col("short") / 2).cast("int"))
    halves = F.array(F.struct(F.lit(2).alias("path"), F.col("_half").alias("front"), F.lit(0).alias("back")), F.struct(F.lit(3).alias("path"), F.lit(0).alias("front"), F.col("_half").alias("back")))
    uncut, kept = each.withColumn("_h", F.explode(halves)).select("word", "n", "short", "_h.*"), None
    while True:
        keyed, _ = materialise(uncut.withColumn("key", _key(F.col("front"), F.col("back"))).withColumn("_block", F.struct(*AT)), "blocks")
        sizes, _ = materialise(keyed.groupBy("_block").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
        final = (F.col("_size") <= most) | (F.col("_block.short") - F.col("_block.front") - F.col("_block.back") <= 1)
        met = spread_join(keyed, sizes.withColumnRenamed("n", "_size"), "_block", "word", sizes=sizes)
        done = met.where(final).select(*AT, "word", "n")
        kept = done if kept is None else kept.unionByName(done)
        if not sizes.withColumnRenamed("n", "_size").where(~final).head(1):
            return kept
        half = F.floor((F.col("short") - F.col("front") - F.col("back")) / 2).cast("int")
        further = F.array(
            F.struct((F.col("path") * 2).alias("path"), (F.col("front") + half).alias("front"), F.col("back")), F.struct((F.col("path") * 2 + 1).alias("path"), F.col("front"), (F.col("back") + half).alias("back"))
        )
        uncut = met.where(~final).select("word", "n", "short", F.explode(further).alias("_h")).select("word", "n", "short", "_h.*")


def _groups(table: pa.Table) -> np.ndarray:
    """Places where the next block begins, the end included."""
    new = np.ones(table.num_rows + 1, bool)
    if table.num_rows > 1:
        same = np.ones(table.num_rows - 1, bool)
        for name in AT:
            c = table[name].combine_chunks()
            same &= pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        new[1:-1] = ~same
    return np.flatnonzero(new)


def _near(codes: np.ndarray, short: int, i: np.ndarray, j: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether i and j are one edit apart, code points that they begin with alike); i is the shorter one, if one is."""
    a, b = codes[i, :short], codes[j]
    front = a == b[:, :short]
    lead = np.where(front.all(1), short, front.argmin(1))
    back = (a == b[:, 1:])[:, ::-1]
    trail = np.where(back.all(1), short, back.argmin(1))
    return np.where(longer[j], lead + trail >= short, (~front).sum(1) == 1), lead


def _own(short: int, path: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether a pair is its block's own: it may share several blocks, and the way down by its ``lead`` meets one of them."""
    half = short // 2
    back = lead < half
    f, way = np.where(back, 0, half), 2 + back
    own = way == path
    rest = short - half
    while rest > 1:
        half = rest // 2
        back = lead < f + half
        f, way = f + np.where(back, 0, half), way * 2 + back
        own |= way == path
        rest -= half
    return own


def _compared(table: pa.Table) -> pa.Table | None:
    """Each word of whole blocks of one length with its near words there: how many, and the best one."""
    table = table.append_column("_len", pa.compute.utf8_length(table["word"]))
    begins = _groups(table)
    short = table["short"][0].as_py()
    text = table["word"].to_pylist()
    words = np.array(text, f"U{short + 1}")
    codes = words.view(np.uint32).reshape(len(words), short + 1)
    longer, n = table["_len"].to_numpy() > short, table["n"].to_numpy()
    path = table["path"].to_numpy()
    marks = np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0)), axis=1)
    # a shorter word meets those that follow it in its block; shorter ones come first
    last = np.repeat(begins[1:], np.diff(begins))
    place = np.arange(len(words))
    follow = np.where(longer, 0, last - place - 1)
    step = max(1, COMPARED // (short + 1))
    upto, found = np.cumsum(follow), []
    at = 0
    while at < len(words):
        held = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, held + step, side="right")))
        k = follow[at:end]
        i = np.repeat(place[at:end], k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        alike = np.bitwise_count(marks[i] ^ marks[j]) <= 2
        i, j = i[alike], j[alike]
        if len(i):
            near, lead = _near(codes, short, i, j, longer)
            near &= _own(short, path[i], lead)
            found.append((i[near], j[near]))
        at = end
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (place[:0], place[:0])
    if not len(i):
        return None
    one, other = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = place
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    best = other[first]
    return pa.table({"word": table["word"].take(pa.array(one[first])), "n_near": pa.array(np.diff(np.r_[first, len(one)])), "best_n": pa.array(n[best]), "best": table["word"].take(pa.array(best))})


def near_words(blocked: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): a row for each block and word that has near words there; each pair is in one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            # words of one length at a time, so that they are an even array
            lengths = table["short"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1], True]).tolist()
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                step = max(1, COMPARED // int(lengths[b] + 1))
                ends = b + _groups(table.slice(b, e - b))
                while b < e:
                    stop = int(max(ends[ends > b][0], ends[ends <= b + step][-1]))
                    out = _compared(table.slice(b, stop - b))
                    if out is not None:
                        yield from out.combine_chunks().to_batches()
                    b = stop

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            begins = _groups(table)
            cut = int(begins[-2]) if table.num_rows else 0  # the last block may go on
            if cut:
                yield from compare(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from compare(held)

    ordered = blocked.repartition(*AT).sortWithinPartitions(*AT, F.length("word"), "word")
    return ordered.select(*AT, "word", "n").mapInArrow(scan, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed to the last, twice as far in each round."""
    at, path = materialise(forms.where("form is not null").select("word", F.col("form").alias("at")), "roots")
    while True:
        further = at.select(F.col("word").alias("at"), F.col("at").alias("_next"))
        moved, new = materialise(spread_join(at, further, "at", "word", "left").select("word", F.coalesce("_next", "at").alias("at"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(at.sparkSession, path)
        if not moved.where("_moved").head(1):
            return moved.select("word", F.col("at").alias("root"))
        at, path = moved.select("word", "at"), new


def variants(documents: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, typo: int = TYPO, block: int = BLOCK) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word: its commonest near word, where that is ``ratio`` times as
    common, and where following the forms ends."""
    words, _ = materialise(dictionary(documents, letters, least, typo), "words")
    parts = near_words(blocks(words, block))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = rows.unionByName(parts.withColumn("n", F.lit(None).cast("long")), allowMissingColumns=True)
    best = F.min_by(F.struct("best", "best_n"), F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("x"), F.col("best").alias("y"))))
    near = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_b"))
    fits = F.col("_b.best_n") >= ratio * F.col("n")
    forms, _ = materialise(near.select("word", "n", F.when(fits, F.col("_b.best")).alias("form"), F.when(fits, F.col("_b.best_n")).alias("form_n"), "n_near"), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
