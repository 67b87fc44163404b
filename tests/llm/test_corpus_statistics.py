"""Importance, spelling and decontamination against plain versions, on whole small tables and awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rollsift.llm import decontaminate, importance, secrets, spelling, token_files, topk
from rollsift.llm.html_extract import parse
from rollsift.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_set string, _words string, word string, buckets string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows):
    """Rows with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "b") for i, t in rows], DOCS)


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*(["doc_id", "text"] if name == "documents" else ["item_id", "text"])).collect()]


SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
AWKWARD = [
    (1, None), (2, ""), (3, " .,;\n"), (4, SENTENCE), (4, SENTENCE), (4, "other words " + SENTENCE.upper() + " end"), (None, "no id " + SENTENCE), (None, None),
    (7, "É\x00été 日本 " * 3), (8, "word and more " * 3000 + SENTENCE), (9, "-".join(SENTENCE.split())), (10, "short item"),
]


# ---- importance


def plain_importance(docs, target, least=20, percent=5, buckets=10_000):
    def grams(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    counted, wanted = [(i, *grams(t)) for i, t in docs], [grams(t)[1] for _, t in target]
    s, t = collections.Counter(b for _, _, x in counted for b in x), collections.Counter(b for x in wanted for b in x)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, x in counted:
        weight = sum(gain[b] for b in x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(x), weight, score, None, n])
    eligible = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_importance_of_the_whole_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op11_importance"](spark, SF).collect()), key=str)
    assert got == plain_importance(table(spark, "documents"), table(spark, "benchmark"))
    assert sum(r[4] is not None for r in got) >= 5


def test_importance_of_awkward_rows(spark):
    target = [(1, SENTENCE), (2, None), (None, "more words"), (3, "")]
    got = importance.resampled(frame(spark, AWKWARD), frame(spark, target), percent=60, least=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_importance(AWKWARD, target, 5, 60)
    assert importance.resampled(frame(spark, AWKWARD).limit(0), frame(spark, target)).count() == 0
    none = importance.resampled(frame(spark, AWKWARD), frame(spark, target).limit(0), percent=60, least=5)
    assert sorted((tuple(r) for r in none.collect()), key=str) == plain_importance(AWKWARD, [], 5, 60)


@pytest.mark.parametrize("piece, batch", [(1, 1), (7, 20), (1 << 17, 1 << 20)])
def test_pieces_do_not_show(spark, piece, batch):
    rows, counts = importance.bucketed(frame(spark, AWKWARD).repartition(3), "test", piece=piece, batch=batch)
    assert {r["bucket"]: r["n"] for r in counts.where("n > 0").collect()} == collections.Counter(b for r in rows.collect() for b in r["buckets"])
    long = next(len(r["buckets"]) for r in rows.collect() if r["doc_id"] == 8)
    assert long == 3 * len(words(AWKWARD[9][1])) - 3


# ---- spelling


def plain_spelling(docs, letters=5, least=3):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= least}
    near = collections.defaultdict(set)
    wild = collections.defaultdict(set)
    for w in known:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
            if (d := w[:i] + w[i + 1 :]) in known:
                near[w].add(d)
                near[d].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in known:
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 2 * known[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, known[w], form.get(w), known.get(form.get(w)), root(w), len(near[w])) for w in known)


def test_spelling_of_the_whole_table(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_spelling"](spark, SF).select("word", "n", "form", "form_n", "root", "n_near").collect())
    assert got == plain_spelling(table(spark, "documents"))


@pytest.mark.parametrize("block", [3, 60])
def test_cut_blocks_give_the_same_pairs(spark, block):
    """A hot prefix and a hot suffix, words of one length and of two, in blocks that are cut many times."""
    heads, tails = ["anti", "un", "é", ""], ["abel", "abels", "abet", "bbel", "xyzt", "xyzzt"]
    many = [f"prefix{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"] + [f"{a}{b}suffix" for a in "abcdefgh" for b in "stuvwxyz"] + [h + t for h in heads for t in tails]
    text = " ".join(w for k, w in enumerate(many) for _ in range(3 + 2 ** (k % 5)))
    rows = [(1, text), (2, text.upper()), (None, text), (3, None), (4, ""), (5, "a" * 3000 + " " + "a" * 3001), (5, "a" * 3000 + " " + "a" * 3001)] * 2
    got = spelling.variants(frame(spark, rows), block=block).select("word", "n", "form", "form_n", "root", "n_near")
    assert sorted(tuple(r) for r in got.collect()) == plain_spelling(rows)


def test_spelling_of_nothing(spark):
    assert spelling.variants(frame(spark, AWKWARD).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "ab cd")])).count() == 0


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{i}", f"w{i + 1}" if i < 37 else None) for i in range(38)] + [("x", "w0"), ("y", "w0")]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string"))
    assert {r["word"]: r["root"] for r in got.collect()} == {w: "w37" for w, f in rows if f}


# ---- decontamination


def plain_contamination(docs, items, window=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        if item is not None and n:
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    rows = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= owners
        rows.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, tid int")


ITEMS = [(1, SENTENCE), (2, "short item"), (3, None), (4, " ;"), (5, "kappa"), (6, "eta theta iota kappa lambda"), (10, SENTENCE), (10, "été 日本 été"), (None, "word and more"), (7, "word and more word and more word and more word and more word and")]


def test_contamination_of_the_whole_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op13_decontamination"](spark, SF).collect()), key=str)
    assert got == plain_contamination(table(spark, "documents"), table(spark, "benchmark"))
    assert any(r[5] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(con.execute(SQL["op13_decontamination"]).fetchall(), key=str) == got


@pytest.mark.parametrize("block", [3, 1000])
def test_contamination_of_awkward_rows(spark, block):
    """Items of one, two, five and more words, in one block and in many; the first rows are equal."""
    got = decontaminate.report(frame(spark, AWKWARD), items_of(spark, ITEMS), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(AWKWARD, ITEMS)


def test_contamination_of_nothing(spark):
    assert decontaminate.report(frame(spark, AWKWARD).limit(0), items_of(spark, ITEMS)).count() == 0
    got = decontaminate.report(frame(spark, AWKWARD), items_of(spark, ITEMS).limit(0))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(AWKWARD, [])


def test_spans_are_the_hit_words(spark):
    rows, sets = decontaminate.contamination(frame(spark, AWKWARD), items_of(spark, ITEMS))
    by_id = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows.collect() if r["doc_id"] in (8, 9, 10)}
    n = len(words(AWKWARD[9][1]))
    assert by_id == {8: [(0, n)], 9: [(0, 15)], 10: [(0, 2)]}
    assert ["1", "10", "5", "6"] in [r["item_ids"] for r in sets.collect()]


def test_native_plans(spark):
    rows, sets = decontaminate.contamination(frame(spark, AWKWARD), items_of(spark, ITEMS))
    for df in (rows, sets):
        assert "Python" not in df._jdf.queryExecution().toString() and "InArrow" not in df._jdf.queryExecution().toString()


# ---- mends of earlier operators


def test_allowed_shapes_of_any_length(spark):
    """The same shape is allowed at any length, and takes time in proportion."""
    names = ["/".join(["Some", "path", "12"] * n) for n in (3, 30, 30_000)] + ["some/path/" * n + "name1234" for n in (3, 30, 30_000)]
    got = spark.createDataFrame([(n,) for n in names], "v string").select(secrets.allowed(F.col("v")).alias("a")).collect()
    assert [r["a"] for r in got] == [True] * 6
    free = ["Some/path/" * 3000 + "12aB", "a1" * 9000, "ABc/" * 9000]
    got = spark.createDataFrame([(n,) for n in free], "v string").select(secrets.allowed(F.col("v")).alias("a")).collect()
    assert [r["a"] for r in got] == [False] * 3


@pytest.mark.parametrize("value", ["12.5", "", "12px", "1", "x" * 5000])
def test_any_attribute_is_read(value):
    """Pages may use the name that labels training blocks; it says nothing there."""
    page = f'<html data-y="{value}"><body><svg data-y={value or "0"}></svg><div data-y><p data-y="{value}">One.</p></div></body></html>'
    assert all(n.label is None for n in parse(page)[0])


def test_repeated_query_ids_do_not_depend_on_partitions(spark):
    rows = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (0, None), (0, [0.1]), (0, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(sorted(tuple(r) for r in topk.top_k(df.repartition(n)).collect())) for n in (1, 2, 5)}
    # the smallest vector of id 0 that counts is [0.1], which has one candidate of its length
    assert got == {((0, 1, 3, 25 * 51),)}


def test_one_id_in_many_files(spark):
    """Half of the rows have no id, or the same one: their texts are dealt over files, and stay in order."""
    rows = [(None if i % 4 else 5, f"{i:04d} some text") for i in range(400)]
    folder = token_files.scratch_path(spark, "test")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = token_files.write_token_files(df, vocabulary("word_bpe_49k.json"), folder)
    assert len([f for f in files if f[2]]) == 4 and max(f[2] for f in files) < 200
    got = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 100
