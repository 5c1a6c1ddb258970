import hashlib

import numpy as np
import pytest
import tiktoken

from sawmill.llm import bpe

from .conftest import NASTY


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.default_vocabulary()


def brute(text, vocabulary):
    ranks, pattern = vocabulary
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary(text or "")


def test_like_the_library(spark, nasty, vocabulary):
    got = sorted(((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark, nasty).collect()))
    want = []
    for i, t, *_ in NASTY:
        ids = brute(t, vocabulary)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_white_space_and_apostrophes(spark, vocabulary):
    texts = ["a  b", "a \n\n b ", "it's we'll ''s 'S", "  ", "\t\tx", "1a2b  3", "'", "a　b", "\x1c\x1d x\x85y", "é ​!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, *vocabulary).collect()}
    assert got == {i: brute(t, vocabulary) for i, t in enumerate(texts)}


def test_decode_alone(spark, nasty, vocabulary):
    ranks, pattern = vocabulary
    got = sorted((r.doc_id or -1, bytes(r.decoded)) for r in bpe.decode(bpe.encode(nasty, ranks, pattern), ranks).collect())
    assert got == sorted((i or -1, (t or "").encode()) for i, t, *_ in NASTY)


def test_small_blocks_and_repeated_blocks(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    docs = spark.createDataFrame([(i % 3, f"same text here {i % 3}") for i in range(60)], "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in bpe.encode(docs, *vocabulary).collect())
    assert got == sorted((i % 3, brute(f"same text here {i % 3}", vocabulary)) for i in range(60))


def test_empty(spark, empty):
    assert bpe.round_trip(spark, empty).collect() == []


def test_large_ids_and_clashing_names(spark, clashing):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(big, "x"), (None, "y")], "doc_id long, text string")
    assert {r.doc_id for r in bpe.round_trip(spark, docs).collect()} == {big, None}
    assert bpe.round_trip(spark, clashing).count() == len(NASTY)


def test_numbers_round_trip():
    for x in ([], [0], [1, 127, 128, 1 << 20, (1 << 23) - 1], [1 << 40, 3]):
        x = np.array(x, np.int64)
        assert bpe._unpack_numbers(bpe._pack_numbers(x)).tolist() == x.tolist()
