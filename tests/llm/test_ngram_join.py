import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from sawmill.llm import ngram_join

from .conftest import NASTY


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if docs[i][0] is not None and docs[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[root(i)]) for i, (d, _) in enumerate(docs))


def run(docs):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_join.similar(docs).collect())


def corpus(seed, n=90):
    rng = random.Random(seed)
    prose = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    passage = prose(60)
    docs = []
    for _ in range(n):
        docs.append(prose(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 14, 30, 80, 200])) + (passage if rng.random() < 0.4 else []))
    for _ in range(2 * n):  # chains of edits, so that links don't close
        w = list(rng.choice(docs))
        for _ in range(max(1, int(len(w) * rng.choice([0.005, 0.02, 0.04])))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        docs.append(w)
    out = [(i, " ".join(w) if rng.random() < 0.8 else "\n".join(w).upper()) for i, w in enumerate(docs)]
    rng.shuffle(out)
    return out


def test_like_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        want = brute(docs)
        assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == want
        assert len({c for _, _, c in want}) < len(docs) - 30


@pytest.mark.parametrize("short, task_bytes", [(16, 32_000_000), (2, 32_000_000), (2, 12_000), (1, 4_000)])
def test_short_and_long_lists(spark, monkeypatch, short, task_bytes):
    docs = corpus(5)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(ngram_join, "CHUNK_CHARS", 3_000)
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_small_sketch(spark, monkeypatch):
    docs = corpus(6)
    monkeypatch.setattr(ngram_join, "MIN_CELLS", 1 << 6)
    monkeypatch.setattr(ngram_join, "MAX_CELLS", 1 << 6)
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_a_passage_in_every_document_joins_nothing(spark, monkeypatch):
    """With a sketch that tells nothing apart the passage is in many prefixes; still only links unite."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for i in range(150)]
    docs += [(500 + i, docs[i][1] + " more") for i in range(10)]
    monkeypatch.setattr(ngram_join, "MIN_CELLS", 1 << 6)
    monkeypatch.setattr(ngram_join, "MAX_CELLS", 1 << 6)
    seen = []
    plain = ngram_join.common.components
    monkeypatch.setattr(ngram_join.common, "components", lambda e: seen.append(e.count()) or plain(e))
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)
    assert seen[0] <= 40  # the links that unite


def test_lists_stream_through_a_task():
    """However rows are cut into batches, pairs and long lists are the same, and a long list is not held."""
    rng = np.random.default_rng(2)
    sig = np.sort(np.concatenate([np.repeat(np.arange(40), rng.integers(1, 7, 40)), np.repeat(50, 3000), np.repeat(51, 4)]))
    rows = pd.DataFrame({"kind": np.int8(0), "sig": sig, "class": np.int32(0), "node": rng.permutation(len(sig)) + 10, "group": 0})
    other = pd.DataFrame({"kind": np.int8([1, 2, 2]), "sig": [0, 1, 2], "class": np.int32(0), "node": [1, 2, 3], "group": [4, 5, 6]})
    rows = pd.concat([rows, other], ignore_index=True)

    def made(step):
        out = list(ngram_join._pairs(4)(rows[i : i + step] for i in range(0, len(rows), step)))
        return max(map(len, out)), sorted(pd.concat(out)[["kind", "a", "b", "ga", "gb"]].itertuples(index=False, name=None))

    want = made(len(rows))[1]
    length = np.bincount(sig)
    assert sum(r[0] == 1 for r in want) == length[length > 4].sum()
    assert sum(r[0] == 0 for r in want) == sum(math.comb(n, 2) if n <= 4 else n - 1 for n in length.tolist())
    assert [r for r in want if r[0] > 1] == [(2, 1, 4, 0, 0), (3, 2, 5, 0, 0), (3, 3, 6, 0, 0)]
    for step in (1, 2, 3, 7, 100):
        most, got = made(step)
        assert got == want and most <= 3 * step + 12


def test_local_links_are_exact():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(60):
        s = base[rng.integers(6)]
        sets.append(np.unique(np.concatenate([s[rng.random(len(s)) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)])))
    order = ngram_join.Order(np.zeros((2, 1 << 8), np.uint8))
    up = ngram_join._local(sets, [ngram_join.signatures(s, order, 30) for s in sets])
    i, j = ngram_join.compare(sets, sets)
    nodes, root = ngram_join.common.roots(i, j)
    assert (up == root).all() and len(set(up)) > 6


def test_prefixes_hold_what_links_share():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 40, (2, 1 << 12)).astype(np.uint8)
    order = ngram_join.Order(sketch)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)]))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if len(a) > 1 and ngram_join.links(np.array([shared]), len(a), np.array([len(b)]))[0] and not np.array_equal(a, b):
            for boundary in (1, 10, 30, 100):
                x, y = ngram_join.signatures(a, order, boundary), ngram_join.signatures(b, order, boundary)
                assert len(np.intersect1d(x, y)), (len(a), len(b), shared, boundary)


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary([(20, 1000), (400, 10)], scan_cost=0.1) < 20
    assert ngram_join.choose_boundary([(20, 1000), (400, 10)], scan_cost=50) >= 20


def test_nasty_rows(spark, nasty, clashing, empty):
    want = brute([(i, t) for i, t, *_ in NASTY])
    assert run(nasty) == want and run(clashing) == want
    assert ngram_join.similar(empty).collect() == []


def test_keep_one_goes_by_text(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (2, text), (2, "a text of its own that no other row has")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.keep_one(docs).collect())) == [(1, text), (2, "a text of its own that no other row has")]


def test_keep_one(spark):
    docs = [(i, t, 0) for i, t in corpus(7, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, node int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute([d[:2] for d in docs])})
