import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from sawmill.llm import common, substring

from .conftest import NASTY


def brute(docs):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(docs):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(docs).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    prose = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passages = [prose(k) for k in (49, 50, 51, 80, 200)]
    docs = []
    for i in range(n):
        parts = prose(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 10)
            parts += p[cut:] + prose(rng.randrange(0, 30))
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(n + i, docs[i * 3][1]) for i in range(20)]  # copies
    docs += [(n + 50, ("again " * 300).strip()), (n + 51, ("again " * 120).strip())]
    rng.shuffle(docs)
    return docs


def test_like_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_small_sketch_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WORDS", 300)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(df, cells=1 << 6).collect())
    assert got == brute(docs)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_shuffled_ways_back(spark, monkeypatch, rows):
    monkeypatch.setattr(substring, "PLACES_BYTES", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    docs = corpus(4)
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)


def test_few_texts_move(spark, capsys):
    """Documents without a repeated window are read twice and never shuffled."""
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    substring.remove_repeats(df).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_window_that_a_document_holds_often_is_one_line(spark):
    docs = [(1, "again " * 5000), (2, "again " * 900 + "end"), (3, " ".join(f"x{i % 60}" for i in range(3000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert run(df) == brute(docs)
    rows = df.selectExpr("doc_id", "text", "xxhash64(text, doc_id) as row").toPandas()
    cells = [np.unique(substring._cells(substring.window_parts(substring.hashed(substring.words_of(t)), substring.Roller()), 1 << 44)) for t in rows["text"]]
    out = pd.concat(substring._candidates(1 << 44)([rows.assign(cells=cells, known=[[]] * 3)]))
    assert len(out) < 100 and (out["runs"].notna() != out["at"].notna()).all()


def test_nasty_rows(spark, nasty, clashing, empty):
    want = brute([(i, t) for i, t, *_ in NASTY])
    assert run(nasty) == want and run(clashing) == want
    assert substring.remove_repeats(empty).collect() == []


def test_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(1, a), (2, a), (2, b), (3, b + " " + a), (2, a)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
