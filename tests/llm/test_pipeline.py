"""The pipeline's stages on small tables, against each stage's own decisions."""

import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollsift.llm import quality, secrets, toxicity
from rollsift.llm.common import filled, with_texts

SF = "/root/testdata/sf0.001"
EXTRA = [(10_000_001, None, "en", "s", 0), (None, "text without id", None, None, None), (10_000_002, "", "de", "s", 0), (10_000_003, "short one", "en", "s", 9), (10_000_003, "short one", "en", "s", 9)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage, and what the last one gives."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.unionByName(spark.createDataFrame([(10_000_004, "the secret = abcdef123456 of this text " + "and more words " * 400, "en", "s", 40)], docs.schema))
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
    return seen


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])


@pytest.mark.parametrize("at, classify, keep", [(0, toxicity.classify, "not flagged"), (1, quality.classify, "predicted = 1")])
def test_classifiers_decide(spark, stages, at, classify, keep):
    before = stages[at]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {(r["doc_id"]) for r in classify(before, labels).where(keep).collect()}
    want = [r for r in rows(before) if r[0] in kept]
    assert rows(stages[at + 1]) == want and 0.6 * before.count() < len(want) <= before.count() - at


def test_one_of_each_component_stays(stages):
    before = [(r["doc_id"], r["text"] or "") for r in stages[2].collect() if r["doc_id"] is not None]
    sets, up = {}, {i: i for i, _ in before}
    for i, text in before:
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    stay = {i for i in ids if top(i) == i}
    assert rows(stages[3]) == [r for r in rows(stages[2]) if r[0] is None or r[0] in stay]
    assert len(stay) < len(ids)


def test_secrets_go_and_the_rest_stays(stages):
    spans = {}
    for r in secrets.scan(stages[3]).collect():
        text, out, at = r["text"], "", 0
        for s in r["secret_spans"]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[REDACTED]"
            at = max(at, s["end"])
        spans[r["doc_id"]] = None if text is None else out + text[at:]
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert {i: r["text"] for i, r in after.items()} == spans
    assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
    assert "abcdef123456" not in after.get(10_000_004, {"text": ""})["text"]


def test_packing_takes_every_text(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in stages[4].collect()), key=repr)
    pieces = stages[5].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert sorted(((r["doc_id"], r["doc_tokens"]) for r in pieces), key=repr) == sorted(set(want), key=repr)
    assert sum(r["n"] for r in pieces) == sum(n for _, n in want)
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_documents(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = stage(spark, docs, SF)
    assert out.count() == 0 and (stage is corpus_pipeline.packing or out.columns == docs.columns)


def test_clashing_columns_survive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    names = ("_text", "_lang", "_hex", "_spans", "_base", "_gone", "node", "n", "_row", "_stats", "_wide", "_reach", "id", "component_id", "_id", "length", "start")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r["_text"] == "_text" and r["_hex"] == "_hex" and r["id"] == "id" for r in out.collect())
    assert corpus_pipeline.packing(spark, docs, SF).select("doc_id").distinct().count() == 30


def test_texts_are_sent_once(spark):
    """A string column is its own text; others are read as strings; null is empty."""
    same = spark.createDataFrame([("a",), (None,)], "text string")
    assert with_texts(same, "text") == (same, "text")
    sent, name = with_texts(spark.createDataFrame([(1, "x"), (None, "y")], "text int, _text string"), "text")
    assert name == "__text" and sorted(r[name] for r in sent.collect()) == ["", "1"]
    assert filled(pa.array(["a", None, "ü"])).to_pylist() == ["a", "", "ü"]
