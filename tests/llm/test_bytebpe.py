"""Backtracking encoder against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow.dataset as ds
import pytest
import tiktoken

import __spark_entry__ as E
from tessera.llm import bytebpe

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def library(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path(name)), special_tokens={})


def strange_texts():
    rng = random.Random(11)
    letters = ["a", "e", "in", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "é", "ß", "日本", "мир", "한국", "🙂", "👩‍👩‍👧", " ", "　", "́", "1", "2024", "##", "--", "==", "<|endoftext|>", "\x00", "﻿"]
    yield from (None, "", " ", "\n\n \n x", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "-" * 2000, "é" * 999, "<|endoftext|> is text")
    for _ in range(400):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
    for _ in range(50):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0x10000, 0x10FFF)])) for _ in range(40))


@pytest.mark.parametrize("name", FILES)
def test_pieces_equal_the_merges(name):
    right, own = library(name), bytebpe.BacktrackingBpe(bytebpe.read_ranks(P.path(name)), P.PATTERN)
    for t in strange_texts():
        assert own.text(t or "") == right.encode_ordinary(t or "")
    rng = random.Random(5)
    tokens = [t for t in own.ranks if len(t) > 1]
    for _ in range(3000):  # bytes at which tokens overlap
        raw = b"".join(rng.choice(tokens)[rng.randrange(2) :] for _ in range(rng.randrange(1, 5)))
        assert own.piece(raw) == (right._core_bpe.encode_single_piece(raw))


def test_a_vocabulary_that_needs_steps_back():
    """Longest matches are wrong here: `ab` begins `abb`, which merges never make of `abbc`."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abb": 258, b"bbc": 259, b"abbcx": 999}
    own = bytebpe.BacktrackingBpe(ranks, P.PATTERN)
    for n in range(1, 8):
        for k in range(3**n):
            raw = bytes(b"abc"[k // 3**i % 3] for i in range(n))
            assert own.piece(raw) == own.merge(raw) or raw in ranks
    assert own.piece(b"abbcx") == [999] and own.merge(b"abbcx") != [999]


@pytest.mark.parametrize("name", FILES[:1])
def test_operator(spark, name):
    texts = list(strange_texts()) + ["long words and words " * 60_000]
    rows = [(i % 50 if i % 7 else None, t, "s", i) for i, t in enumerate(texts)] + [(1, "twice", "s", 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int").repartition(3)
    right = library(name)
    want = []
    for d, t, *_ in rows:
        ids = right.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True, ids))
    out = bytebpe.encode(df, P.path(name), P.PATTERN)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    empty = bytebpe.encode(df.limit(0), P.path(name), P.PATTERN)
    assert empty.count() == 0 and empty.columns == out.columns


def test_query(spark, small):
    local = ds.dataset(f"{small}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    right = library(FILES[0])
    want = set()
    for d, t in zip(local["doc_id"], local["text"]):
        ids = right.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(right.decode_bytes(ids)).hexdigest()))
    got = E.queries()["op11_backtracking_bpe"](spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
