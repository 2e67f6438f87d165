from __future__ import annotations

import base64
import random

import numpy as np
import pytest

from graphloom.llm import bpe

FOLDER = bpe.VOCABULARY_FOLDER


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    try:
        with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "\n\n \t x", "a" * 4000, "aaa aaaa aaaaa", "don't we'll", "naïve café ﬁ", "日本語のメモ", "🚧👩‍💻", "\x00\x1c\x85 ﻿", "<|endoftext|>", "١٢٣ x", "\r\n\r\n", "ab" * 3000]


def test_same_as_a_public_library(known):
    rng = random.Random(4)
    texts = HARD + ["".join(rng.choice("ab cde\n.-éж你") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids, ends = bpe.Encoder(bpe.load_vocabulary()).encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == known.encode_ordinary(t), repr(t[:40])


def test_round_trip(known):
    e = bpe.Encoder(bpe.load_vocabulary())
    tokens = {v: k for k, v in bpe.read_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken").items()}
    for t in HARD:
        assert b"".join(tokens[i] for i in e.encode([t])[0].tolist()).decode() == t


def test_counts_and_nulls(known):
    e = bpe.Encoder(bpe.load_vocabulary())
    texts = [None, *HARD, None]
    _, ends = e.encode(texts)
    assert e.count(texts).tolist() == np.diff(ends).tolist()
    assert e.encode([])[1].tolist() == [0] and e.count([None, ""]).tolist() == [0, 0]


def test_table(spark, known):
    rows = [(i, t, "clash", "clash") for i, t in enumerate([None, *HARD, "twice", "twice"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids string").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_table(df, "doc_id", "text").collect()}
    assert got == {i: known.encode_ordinary(t) if t else [] for i, t, _, _ in rows}
    assert bpe.encode_table(df.where("false"), "doc_id", "text").count() == 0


def test_bad_vocabulary(tmp_path):
    (tmp_path / "bad.tiktoken").write_text("!!! 3\n")
    with pytest.raises(ValueError, match="line 1"):
        bpe.read_ranks(str(tmp_path / "bad.tiktoken"))
    with pytest.raises(ValueError, match="bytes"):
        bpe.pair_table({b"a": 0})
