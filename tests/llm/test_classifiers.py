import random
import zlib

import numpy as np
import pytest

from sawmill.llm import common, quality, toxicity

from .conftest import NASTY

BAD = ["idiotic", "scummy", "trashy", "moronic"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "no", "el", "um", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, q, t = prose(rng, rng.randint(10, 200)), 1, 0
        if i % 5 == 0:
            w = text.split()
            text, q = rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * len(w)), " | ".join(w), " ".join(x + "%%%" for x in w)]), 0
        elif i % 4 == 0:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "ly", "er"]))
            text, t = " ".join(w), 1
        docs.append((i, text))
        labels.append((i, q, t))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels)


def accuracy(rows, truth, k):
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == truth[r.doc_id][k] for r in held])


def test_quality_held_out(data):
    docs, labels, truth = data
    rows = quality.scores(docs, labels).collect()
    assert accuracy(rows, truth, 0) >= 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_every_toxic_window_is_in_the_fit(monkeypatch):
    rng, seen, train = random.Random(7), [], toxicity.train_chain
    texts = [" ".join(f"{rng.getrandbits(40):010x}" if k % 40 or i % 2 else "idiotic" for k in range(1200)) for i in range(40)]
    monkeypatch.setattr(toxicity, "train_chain", lambda seqs, labels, *a: seen.extend(labels) or train(seqs, labels, *a, rounds=2))
    toxicity.fit_texts(texts, np.array([1, 0] * 20))
    assert sum(int(x.sum()) for x in seen) == 20 * 30
    assert sum(not x.any() for x in seen) == 20 * toxicity.CLEAN_WINDOWS


def test_toxicity_held_out_and_spans(data, spark):
    docs, labels, truth = data
    rows = toxicity.scores(docs, labels).collect()
    assert accuracy(rows, truth, 1) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    model = toxicity.fit(docs, labels)
    text = "ta rino \U0001f600 idioticly, so el. scummy um"
    got = toxicity.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert sorted(text[s.start : s.end] for s in got.spans) == ["idioticly,", "scummy"]


def test_held_out_labels_are_never_read(data, spark):
    docs, labels, _ = data
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(common.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_compiled_rules_are_the_model(data, spark):
    docs, labels, _ = data
    model = quality.fit(docs, labels)
    assert 3 <= len(model.rules) <= 200
    names = {n for r in model.rules for n, _, _ in r.conditions}
    rows = docs.select("doc_id", *[c.alias(k) for k, c in quality.statistics(docs["text"]).items()]).collect()
    got = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    assert names <= set(quality.NAMES)
    for r in rows[:100]:
        z = model.intercept + sum(w for conds, w in model.rules if all(r[n] <= v if op == "<=" else r[n] > v for n, op, v in conds))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


@pytest.mark.parametrize("few", [0, 1, 2, 24])
def test_marginals_by_enumeration(few, monkeypatch):
    monkeypatch.setattr(toxicity, "FEW", few)
    rng = np.random.default_rng(0)
    t = rng.normal(size=(2, 2))
    seqs = [rng.normal(size=n) for n in (1, 3, 0, 7, 5)]
    got = toxicity.marginals(seqs, t, 0.4)
    for e, p in zip(seqs, got):
        n = len(e)
        want, total = np.zeros(n), 0.0
        for bits in range(1 << n if n else 0):
            y = [(bits >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[k] * y[k] for k in range(n)) + 0.4 * y[0] + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            want += w * np.array(y)
        assert np.allclose(p, want / total if n else [])


def test_training_by_finite_differences():
    rng = np.random.default_rng(1)
    words = [f"w{c}" for c in "abcdefgh"] + ["abcdef", "abcdxy"]
    seqs = [rng.integers(0, len(words), n) for n in (1, 4, 6, 6, 2)]
    w = toxicity.Windows(seqs, [rng.integers(0, 2, len(s)) for s in seqs], words)
    theta = rng.normal(size=len(w.names) + 6) * 0.5
    _, grad = w.objective(theta)
    for j in [*range(0, len(theta), 3), *range(len(theta) - 6, len(theta))]:
        step = np.zeros_like(theta)
        step[j] = 1e-5
        assert abs((w.objective(theta + step)[0] - w.objective(theta - step)[0]) / 2e-5 - grad[j]) < 1e-5
    # The likelihood by enumeration.
    k, ridge = len(w.names), np.concatenate([np.full(len(w.names), 0.05), [0.0], np.full(5, 0.1)])
    want = 0.5 * (ridge * theta**2).sum()
    for s, row, n in zip(seqs, w.y, map(len, seqs)):
        e = [theta[k] + sum(theta[w.names[f]] for f in toxicity.forms(words[x]) if f in w.names) for x in s.tolist()]
        score = lambda y: sum(a * b for a, b in zip(e, y)) + theta[k + 5] * y[0] + sum(theta[k + 1 + 2 * a + b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        want += np.log(sum(np.exp(score([(bits >> i) & 1 for i in range(n)])) for bits in range(1 << n))) - score(row[:n].tolist())
    assert abs(w.objective(theta)[0] - want) < 1e-8


def test_rules_fit_is_the_lasso_optimum():
    """No weight can move without raising the penalised loss: signs and sizes of the gradient."""
    rng = np.random.default_rng(2)
    r = (rng.random((400, 12)) < 0.4).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 3])))).astype(np.float32)
    r = (r - r.mean(0)) / r.std(0)
    w, b = quality.lasso_logistic(r, y, 0.02)
    p = 1 / (1 + np.exp(-(r @ w + b)))
    grad = r.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 2e-3 and (w != 0).any() and (w == 0).any()
    assert np.allclose(grad[w != 0], -0.02 * np.sign(w[w != 0]), atol=2e-3) and (np.abs(grad[w == 0]) <= 0.02 + 2e-3).all()


def test_fit_is_bounded(data, spark):
    docs, labels, _ = data
    many = docs.union(spark.range(3000).selectExpr("3 as doc_id", "'same id ' || id as text"))
    got = []
    plain = toxicity.fit_texts
    try:
        toxicity.fit_texts = lambda texts, y: got.extend(texts) or plain(texts, y)
        toxicity.fit(many, labels, chars=20_000)
    finally:
        toxicity.fit_texts = plain
    assert 0 < sum(map(len, got)) <= 20_000 and len(got) > 5


def test_nasty_rows(data, spark, nasty, clashing, empty):
    _, labels, _ = data
    bad_labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 0), (1, 0, 1), (3, 0, 0), (7, 1, 1)], labels.schema)
    for df in (nasty, clashing):
        for some in (labels, bad_labels, labels.limit(0)):
            for f in (quality.scores, toxicity.scores):
                rows = f(df, some).collect()
                assert len(rows) == len(NASTY) and all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert quality.scores(empty, labels).collect() == [] and toxicity.scores(empty, labels).collect() == []
    kept = quality.with_scores(clashing, quality.fit(nasty, labels))
    assert set(kept.columns) == set(clashing.columns)
