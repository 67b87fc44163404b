"""Whole queries over the small tables against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollsift.llm import html_extract, ogg, quality, queries, toxicity, unigram

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_by_definition(spark, texts, labels):
    """Means and covariances of the labelled rows by hand, densities from the covariances' inverses."""
    ids = sorted(texts)
    x = dict(zip(ids, quality.statistics(pa.array([texts[i] for i in ids])), strict=True))
    for i in ids[:40]:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        assert x[i][1] == pytest.approx(np.log1p(len(words)), abs=1e-6) and x[i][0] == pytest.approx(np.log1p(len(texts[i].encode())), abs=1e-6)
    learn = [i for i in ids if i in labels and zlib.crc32(str(i).encode()) % 5]
    parts = [np.stack([x[i] for i in learn if labels[i][0] == c]) for c in (0, 1)]
    covariances = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covariances, strict=True)) / len(learn)
    want = {}
    for i in ids:
        odds = np.log(len(parts[1]) / len(parts[0]))
        for sign, p, c in zip((-1, 1), parts, covariances, strict=True):
            s = (1 - quality.SHRINK_TO_POOLED) * c + quality.SHRINK_TO_POOLED * pooled
            s = (1 - quality.SHRINK_TO_DIAGONAL) * s + quality.SHRINK_TO_DIAGONAL * np.diag(np.diag(s)) + quality.RIDGE * np.eye(len(s))
            d = x[i] - p.mean(0)
            odds += sign * -0.5 * (d @ np.linalg.inv(s) @ d + np.linalg.slogdet(s)[1])
        want[i] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    got = queries.QUERIES["op1_quality"](spark, SF).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_by_definition(spark, texts):
    """Every score from the network's formula, position by position; the flag from the language's threshold."""
    d, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(d, known)
    languages = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    for r in queries.QUERIES["op3_toxicity"](spark, SF).collect():
        ids, _ = toxicity.word_ids(pa.array([texts[r["doc_id"]]]))
        v = net.embedding[toxicity.rows_of(net.keys, ids[:, 0])] + net.embedding[toxicity.rows_of(net.keys, ids[:, 1])]
        logit = net.offset
        for w in toxicity.FILTERS:
            if len(v):
                padded = np.concatenate([v, np.zeros((w, v.shape[1]), v.dtype)])
                response = sum(padded[k : k + len(v)] @ net.filters[w][k] for k in range(w))
                logit += np.maximum(response.max(0) + net.bias[w], 0) @ net.out[w]
        score = 1 / (1 + np.exp(-np.clip(net.slope * logit + net.intercept, -500, 500)))
        assert r["score"] == pytest.approx(score, abs=1e-3)
        if abs(r["score"] - 0.5) > 1e-3:
            assert r["predicted"] == int(score >= 0.5)
        limit = net.thresholds.get(languages[r["doc_id"]], toxicity.THRESHOLD)
        assert r["flagged"] == (r["score"] >= limit)


def test_training_learns_and_calibration_is_a_minimum():
    """Texts with one telling pair of words are told apart; no nearby slope or intercept fits the kept rows better."""
    rng = np.random.default_rng(5)
    ids, y = [], []
    for n in range(400):
        x = rng.integers(1, 300, (30, 1)).astype(np.uint64)
        if n % 2:
            x[7], x[8] = 1000, 1001
        ids.append(np.concatenate([x, x + np.uint64(5000)], 1))
        y.append(n % 2)
    net = toxicity.train(ids, np.array(y))
    odds = net.log_odds(np.concatenate(ids), np.array([len(x) for x in ids]))
    assert np.mean((odds > 0) == np.array(y)) > 0.97
    noisy, t = rng.normal(size=300), rng.integers(0, 2, 300)
    noisy += t
    shares = np.array([0.8, 0.2])
    toxicity.calibrate(net, noisy, t, ["en" if i % 2 else "de" for i in range(300)], shares)
    n = np.bincount(t)
    weight, target = (shares / n)[t] * 300, np.where(t == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * noisy + b)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() + 0.005 * (a - 1) ** 2

    best = loss(net.slope, net.intercept)
    assert all(best <= loss(net.slope + da, net.intercept + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    score = 1 / (1 + np.exp(-(net.slope * noisy + net.intercept)))
    for name, rows in (("en", np.arange(300) % 2 == 1), ("de", np.arange(300) % 2 == 0)):
        errors = lambda c: (weight[rows] * ((score[rows] >= c) != t[rows])).sum()  # noqa: B023, E731
        assert errors(net.thresholds[name]) <= min(errors(c) for c in np.linspace(0.1, 0.9, 400)) + 1e-6


def test_training_rows_are_bounded(spark, monkeypatch):
    """One row an id however often it comes, and no more words than the class's share."""
    docs = spark.createDataFrame([(1, "bad words here", "en")] * 500 + [(2, "fine text", "en"), (3, "long " * 5000, "en"), (4, "fine too", "en"), (6, "bad again", "de")], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (6, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 100)
    got, _ = toxicity._sampled(docs, known, "toxic", "doc_id", "text", "lang")
    held = [i for i in (1, 2, 4, 6) if zlib.crc32(str(i).encode()) % 5]
    assert got.column("id").to_pylist() == held


def test_main_texts_by_definition(spark):
    """All pages of the table: the text of their article element, in the order of the page."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op2_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]["html"] or ""
        inside = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", re.search(r"<article\b[^>]*>(.*?)(?:</article>|\Z)", page, re.S)[1], flags=re.S | re.I)
        inside = re.sub(r"</?(?:p|h\d|li|ul|ol|div|br|table|tr|td|blockquote|section|pre)\b[^>]*>", " ", inside, flags=re.I)
        import html

        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


BODY = "The article itself runs on for a good while, so that there is something to read here."
UNSEEN = [
    (f"<html><body><article><h1>T</h1><p>{BODY}</p></article><div>Advertisement: buy</div><div class=fuss>Impressum</div></body></html>", f"T {BODY}"),
    (f"<html><body><article><p>{BODY}</p><p hidden>secret</p><p style='display: none'>unseen</p></article></body></html>", BODY),
    (f"<title>t</title><meta charset=utf-8><p>{BODY}<p>{BODY}", f"{BODY} {BODY}"),
    (f"<article><p>{BODY} <svg/> after <math><mi>x</mi></math> end.</p></article>", f"{BODY} after x end."),
    (f"<div class=kopfzeile><a href=/>Start</a> <a href=/a>Über uns</a></div><main><p>{BODY}</p></main><div class=fussnavi><a href=/i>Impressum</a></div>", BODY),
    (f"<article><p>Share prices rose. {BODY}</p><p>Related work is discussed there, too.</p></article>", f"Share prices rose. {BODY} Related work is discussed there, too."),
]


@pytest.mark.parametrize("page, text", UNSEEN)
def test_shapes_that_training_lacks(page, text):
    assert html_extract.main_texts([page], html_extract.trained()) == [text]


def test_unmatched_tags_take_time_in_proportion():
    import time

    model, took = html_extract.trained(), []
    for n in (25_000, 50_000):
        began = time.time()
        html_extract.main_texts(["<div>" * n + "</p>" * n + "</b>" * n + "x"], model)
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_media_by_definition(spark, texts):
    """Payload, tail, stored form and signal features, from the stored bytes read by a plain page walk."""
    stored = {r["doc_id"]: bytes(r["media"]) for r in ogg.store_texts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in queries.QUERIES["op6_ogg"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = stored[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        at, bodies, serials = 0, {}, []
        while at < len(media):
            assert media[at : at + 4] == b"OggS"
            serial, lacing = media[at + 14 : at + 18], media[at + 27 : at + 27 + media[at + 26]]
            body = media[at + 27 + len(lacing) : at + 27 + len(lacing) + sum(lacing)]
            bodies[serial] = bodies.get(serial, b"") + body
            serials.append(serial)
            at += 27 + len(lacing) + sum(lacing)
        header = len(ogg.SAMPLE_MAGIC) + 12
        assert payload in {b[header:] for b in bodies.values()}
        x = [b - 128 for b in payload]
        feature = dict(p.split("=") for p in r["feature"].split(";"))
        assert int(feature["pages"]) == len(serials) and int(feature["streams"]) == 2 and int(feature["ms"]) == round(len(payload) / 8)
        assert feature["mean"] == f"{sum(x) / len(x):.4f}" and int(feature["peak"]) == max(map(abs, x))
        assert int(feature["crossings"]) == sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))


def best_pieces(enc: unigram.UnigramEncoder, text: str) -> list[int]:
    """The plain search: starts in order, shorter pieces first, a strictly better score replaces."""
    data = ("▁" + text.replace(" ", "▁")).encode() if text else b""
    ids = {p.encode(): i for i, (p, _, kind) in enumerate(enc.model) if kind in (unigram.NORMAL, unigram.USER_DEFINED)}
    best, back = [0.0] + [-np.inf] * len(data), [None] * (len(data) + 1)
    for i in range(len(data)):
        if best[i] == -np.inf or data[i] & 0xC0 == 0x80:
            continue
        char = len(data[i : i + 4].decode("utf-8", "ignore")[:1].encode())
        options = [(d, ids[data[i : i + d]]) for d in range(1, min(enc.longest, len(data) - i) + 1) if data[i : i + d] in ids]
        moves = [(d, p, enc.scores[p]) for d, p in options]
        if not any(d == char for d, _ in options):
            moves.append((char, enc.unknown, enc.unknown_score))
        for d, p, s in moves:
            if best[i] + s > best[i + d]:
                best[i + d], back[i + d] = best[i] + s, (i, p)
    out, j = [], len(data)
    while j:
        i, p = back[j]
        out += [enc.byte_ids[b] for b in reversed(data[i:j])] if p == enc.unknown else [p]
        j = i
    return out[::-1]


def test_unigram_by_definition(spark, texts):
    enc = unigram.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.QUERIES["op7_unigram"](spark, SF).collect():
        text = texts[r["doc_id"]]
        if len(text) > 6000:
            assert r["round_trip"]
            continue
        want = best_pieces(enc, text)
        assert (r["n_tokens"], r["n_bytes"]) == (len(want), sum(i in enc.bytes_of for i in want)) and r["round_trip"]
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())


def test_long_runs_take_time_in_proportion():
    import random
    import time

    enc, rng, took = unigram.encoder(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2), []
    short = "".join(rng.choice(["a", "th", "ing", "é", "日", "🎉", "q"]) for _ in range(1500))
    ids, _ = enc.encode_texts(pa.array([short]))
    assert ids.tolist() == best_pieces(enc, short)
    for n in (500_000, 1_000_000):
        text = "".join(rng.choice("etaoinshrdluzq") for _ in range(n))
        began = time.time()
        ids, _ = enc.encode_texts(pa.array([text]))
        took.append(time.time() - began)
        assert enc.decode(ids.tolist()) == text
    assert took[1] < 3 * took[0] + 0.5


def test_unknown_normalisers_are_refused():
    with pytest.raises(ValueError):
        unigram._plain({2: b"map", 4: 0})
    with pytest.raises(ValueError):
        unigram._plain({})


def test_packing_by_definition(spark, texts):
    """Every document's ids from the library alone; pieces, sequences and padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in queries.QUERIES["op10_packing"](spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            part = ids[i][r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["doc_tokens"] == len(ids[i])
            at += r["length"]
        assert at == len(ids[i])
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    assert len(sequences) * 2048 < 1.05 * used + 2048


@pytest.mark.parametrize("name", ["op1_quality", "op2_main_text", "op3_toxicity", "op4_token_files", "op5_secrets", "op6_ogg", "op7_unigram", "op8_jaccard", "op9_topk", "op10_packing"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    full = queries.QUERIES[name](spark, SF)
    empty = queries.QUERIES[name](spark, str(tmp_path))
    assert empty.count() == 0 and [f.name for f in empty.schema] == [f.name for f in full.schema]


def test_null_rows_of_pages(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, None, "<article><p>" + "Long text, indeed. " * 3 + "</p></article>", 2), (1, None, "<article><p>" + "Long text, indeed. " * 3 + "</p></article>", 3), (2, "u", "", 4)], "page_id long, url string, html string, text int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    long = " ".join(["Long text, indeed."] * 3)
    assert got == sorted([("None", "", 0), ("1", long, len(long)), ("1", long, len(long)), ("2", "", 0)])


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9 + 1)) for i in range(1, 40)], "doc_id long, text string")
    one = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(docs, x).collect()} for x in (one, one.unionByName(one)))
    assert a == pytest.approx(b) and docs.where(F.col("doc_id") > 0).count() == len(a)
