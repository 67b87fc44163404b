"""Ids against an untouched Tokenizer, on texts that hold added tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollsift.llm import packing, token_files, tokens

TEXTS = ["end <|endoftext|> x", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> ", "<|ENDOFTEXT|> Plain", "cut <|endof", "text|> apart", ""]


def library_ids(name, texts):
    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("can_cut", [True, False])
def test_added_tokens_are_one_id(name, can_cut):
    enc = tokens.PieceEncoder(public_tokenizers.path(name))
    assert enc.can_cut
    if not can_cut:
        enc.can_cut = enc.folds = False
        enc.ascii = enc.tokenizer
    rng = random.Random(7)
    alphabet = [*"ab C.,'\n\t  é×ñ!_12", " ", "　", "́", "'s", "\0", "日", "🎉", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "endoftext"]
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    for _ in range(2):  # the second time from the cache
        ids, bounds = enc.encode(pa.array(texts))
        assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:], strict=False)] == library_ids(name, texts)
    enc._forget()
    ids, bounds = enc.encode(pa.array(texts[::-1]).slice(5), 1)
    assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:], strict=False)] == [[*x, 1] for x in library_ids(name, texts[::-1][5:])]


def test_given_ids():
    word, byte = ([*tokens.PieceEncoder(public_tokenizers.path(n)).encode(pa.array(TEXTS[:1]))[0].tolist()] for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert word == [806, 49407, 343] and byte == [437, 220, 50256, 2124]


def test_token_files_and_packing_of_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got, at = token_files.encode_to_files(docs, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect(), 0
    for i, (ids, r) in enumerate(zip(library_ids("word_bpe_49k.json", TEXTS), got, strict=True)):
        assert tuple(r) == (i, at, len(ids) + 1, crc([*ids, 1]))
        at += len(ids) + 1
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [(r["length"], r["ids_crc32"]) for r in packed] == [(len(x) + 1, crc([*x, 1])) for x in library_ids("byte_bpe_50k.json", TEXTS)]
