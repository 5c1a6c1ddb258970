"""Toxicity: a linear-chain conditional random field over tokens.

Only documents are labelled, so tokens are labelled from them first: a token of a toxic document
is toxic if its form (word or word beginning) occurs almost only in toxic documents of the
sample. A two-state chain is trained on those tokens, forward-backward gives each token's
marginal, and the marginals aggregate to the document's score and its offending offsets.

The chain is trained on all windows of a toxic document that hold a toxic token and on one other,
and on ``CLEAN_WINDOWS`` windows, drawn at random, of any other document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents used for the fit (least hash of the id first), and characters of all of them: what goes beyond is left out whole.
SAMPLE, SAMPLE_CHARS = 4_000, 24_000_000
#: Windows of a clean document in the fit of the chain, drawn at random over all of it. With the sample the only sampling here.
CLEAN_WINDOWS = 3
THRESHOLD = 0.3
#: Tokens of a text in the fit come in windows of this length.
WINDOW = 40
#: Chains that are followed one by one once no more are as long.
FEW = 24
#: Words whose emission a worker remembers.
CACHE = 400_000
_TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
OUT = "doc_id string, score double, n_toxic long, spans array<struct<start:int,end:int,p:double>>"


def forms(word: str) -> list[str]:
    """Features of a token: the word, and its beginnings and endings, lower case without outer punctuation."""
    w = _EDGE.sub("", word.lower())
    n = len(w)
    out = ["w:" + w]
    out += [f"p{k}:{w[:k]}" for k in (3, 4, 5, 6) if n >= k]
    out += [f"s{k}:{w[-k:]}" for k in (3, 4) if n >= k]
    return out


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    transition: np.ndarray  # log potentials [from, to]
    start: float
    doc: tuple[float, ...]  # intercept and weights of the document's score


# ------------------------------------------------------------------------ forward-backward


def marginals(seqs: list[np.ndarray], transition: np.ndarray, start: float) -> list[np.ndarray]:
    """P(state 1) of every token; seqs hold emission log-odds. Chains of any length run side by side."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    sizes = np.array([len(seqs[i]) for i in order], np.int64)
    out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
    if not len(sizes) or not sizes[0]:
        return out
    # Time-major layout: at step t the chains longer than t are the first active[t].
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    e = np.empty(offset[-1])
    for rank, i in enumerate(order):
        if sizes[rank]:
            e[offset[: sizes[rank]] + rank] = seqs[i]
    e = np.exp(np.clip(e, -25, 25))
    t00, t01, t10, t11 = np.exp(transition).ravel().tolist()
    f, b = np.empty_like(e), np.ones_like(e)
    # While many chains run, a step is one vector operation; the last FEW are followed one by one.
    shared = int(sizes[FEW]) if len(sizes) > FEW else 0
    steps = max(1, shared)
    n = active[0]
    f[:n] = e[:n] * np.exp(start)
    for t in range(1, steps):
        n, lo, prev = active[t], offset[t], f[offset[t - 1] : offset[t - 1] + active[t]]
        f[lo : lo + n] = e[lo : lo + n] * (t01 + t11 * prev) / (t00 + t10 * prev)
    for rank in range(min(FEW, len(sizes))):
        if sizes[rank] > steps:
            at = offset[steps : sizes[rank]] + rank
            chain = e[at].tolist()
            x, ahead = float(f[offset[steps - 1] + rank]), []
            for v in chain:
                x = v * (t01 + t11 * x) / (t00 + t10 * x)
                ahead.append(x)
            f[at] = ahead
            x, back = 1.0, [1.0]
            for v in reversed(chain):
                x *= v
                x = (t10 + t11 * x) / (t00 + t01 * x)
                back.append(x)
            b[offset[steps - 1 : sizes[rank]] + rank] = back[::-1]
    for t in range(steps - 2, -1, -1):
        n, lo, nxt = active[t + 1], offset[t], offset[t + 1]
        x = e[nxt : nxt + n] * b[nxt : nxt + n]
        b[lo : lo + n] = (t10 + t11 * x) / (t00 + t01 * x)
    odds = f * b
    p = odds / (1 + odds)
    for rank, i in enumerate(order):
        out[i] = p[offset[: sizes[rank]] + rank]
    return out


# ------------------------------------------------------------------------------- the fit


def _look(words: np.ndarray, hashes: np.ndarray) -> tuple:
    """Equal for copies and mostly for near copies: the least two hashes of the words (all words of short texts)."""
    if len(words) < 20:
        return tuple(words.tolist())
    h = hashes[words]
    return int(h.min()), int((h * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).min())


def toxic_words(docs: list[np.ndarray], vocabulary: list[str], y: np.ndarray, least: int = 4, least_share: float = 0.012, share: float = 0.97) -> np.ndarray:
    """Which words have a form that occurs in enough toxic documents and almost nowhere else; near copies count once.

    Documents are arrays of places in the vocabulary.
    """
    known: set[tuple] = set()
    least = max(least, int(least_share * y.sum()))
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], np.uint64)

    def fresh(label: int):
        for words, x in zip(docs, y):
            if x == label and (look := (label, *_look(words, hashes))) not in known:
                known.add(look)
                yield np.unique(words)

    def of(word: str) -> list[str]:
        return [f for f in forms(word) if f[0] in "wp" and len(f) >= 5]

    tox: Counter = Counter()
    for words in fresh(1):
        tox.update({f for w in words.tolist() for f in of(vocabulary[w])})
    often = {f for f, n in tox.items() if n >= least}
    held = {i: own for i, w in enumerate(vocabulary) if (own := often.intersection(of(w)))}
    some = np.zeros(len(vocabulary), bool)
    some[list(held)] = True
    non: Counter = Counter()
    for words in fresh(0):
        non.update(set().union(*(held[w] for w in words[some[words]].tolist())))
    a, b = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    bad = {f for f in often if (tox[f] / a) / (tox[f] / a + (non[f] + 0.5) / b) >= share}
    out = np.zeros(len(vocabulary), bool)
    out[[i for i, own in held.items() if own & bad]] = True
    return out


class Windows:
    """Labelled windows of words as arrays, and the chain's penalised likelihood over them."""

    def __init__(self, seqs: list[np.ndarray], labels: list[np.ndarray], vocabulary: list[str]):
        used = np.unique(np.concatenate(seqs)).tolist()
        counts: Counter = Counter()
        windows = np.bincount(np.concatenate([np.unique(s) for s in seqs]), minlength=used[-1] + 1)
        for w in used:
            n = int(windows[w])
            for f in forms(vocabulary[w]):
                counts[f] += n
        self.names: dict[str, int] = {}
        of_word = {w: np.array([self.names.setdefault(f, len(self.names)) for f in forms(vocabulary[w]) if counts[f] >= 2], np.int32) for w in used}
        del counts
        self.n, self.length = len(seqs), max(map(len, seqs))
        self.mask, self.y = np.zeros((self.n, self.length), bool), np.zeros((self.n, self.length), np.int8)
        for i, lab in enumerate(labels):
            self.mask[i, : len(lab)] = True
            self.y[i, : len(lab)] = lab
        per = [of_word[w] for s in seqs for w in s.tolist()]
        self.feat = np.concatenate(per)
        self.flat = np.repeat(np.flatnonzero(self.mask.ravel()).astype(np.int32), [len(x) for x in per])
        both = self.mask[:, 1:]
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (self.y[:, :-1][both], self.y[:, 1:][both]), 1)

    def objective(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(negative log-likelihood with its ridge, gradient) of weights, bias, transition (4) and start."""
        k, n, length, mask, y = len(self.names), self.n, self.length, self.mask, self.y
        e = np.bincount(self.flat, theta[self.feat], n * length).reshape(n, length) + theta[k]
        T = np.exp(theta[k + 1 : k + 5].reshape(2, 2))
        pot = np.stack([np.ones_like(e), np.exp(np.clip(e, -25, 25))], -1)
        alpha, beta, scale = np.zeros((n, length, 2)), np.ones((n, length, 2)), np.ones((n, length))
        alpha[:, 0] = pot[:, 0] * np.array([1.0, np.exp(theta[k + 5])])
        for t in range(length):
            if t:
                alpha[:, t] = (alpha[:, t - 1] @ T) * pot[:, t]
            scale[:, t] = alpha[:, t, 0] + alpha[:, t, 1]
            alpha[:, t] /= scale[:, t, None]
        for t in range(length - 2, -1, -1):
            nxt = (pot[:, t + 1] * beta[:, t + 1]) @ T.T
            nxt /= (nxt[:, 0] + nxt[:, 1])[:, None]
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, 1.0)
        gamma = alpha * beta
        p = gamma[..., 1] / (gamma[..., 0] + gamma[..., 1])
        ahead = pot[:, 1:] * beta[:, 1:]
        pairs = [[alpha[:, :-1, i] * T[i, j] * ahead[..., j] for j in (0, 1)] for i in (0, 1)]
        total = pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1]
        both = mask[:, 1:]
        xi = np.array([[(x / total)[both].sum() for x in row] for row in pairs])
        diff = np.where(mask, p - y, 0.0)
        ridge = np.concatenate([np.full(k, 0.05), [0.0], np.full(5, 0.1)])
        grad = np.empty_like(theta)
        grad[:k] = np.bincount(self.feat, diff.ravel()[self.flat], k)
        grad[k] = diff.sum()
        grad[k + 1 : k + 5] = (xi - self.seen).ravel()
        grad[k + 5] = diff[:, 0].sum()
        gold = (e * y)[mask].sum() + (self.seen.ravel() * theta[k + 1 : k + 5]).sum() + theta[k + 5] * y[:, 0].sum()
        loss = np.log(scale)[mask].sum() - gold + 0.5 * (ridge * theta**2).sum()
        return float(loss), grad + ridge * theta


def train_chain(seqs: list[np.ndarray], labels: list[np.ndarray], vocabulary: list[str], rounds: int = 80, rate: float = 0.3) -> tuple[dict[str, float], float, np.ndarray, float]:
    """Maximum likelihood by Adam over fixed-length windows; weights belong to state 1 against state 0."""
    windows = Windows(seqs, labels, vocabulary)
    k = len(windows.names)
    theta = np.zeros(k + 6)  # weights, bias, transition (4), start
    theta[k] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1):
        _, grad = windows.objective(theta)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    weights = {f: float(theta[j]) for f, j in windows.names.items() if abs(theta[j]) > 0.02}
    return weights, float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), float(theta[k + 5])


def emission(model_weights: dict[str, float], bias: float, word: str) -> float:
    get = model_weights.get
    return bias + sum(get(f, 0.0) for f in forms(word))


def doc_features(p: np.ndarray) -> tuple[float, ...]:
    """What a document's score is made from: expected toxic tokens, and the two surest tokens."""
    if not len(p):
        return (0.0, 0.0, 0.0, 0.0)
    top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
    s = float(p.sum())
    return (float(np.log1p(s)), float(top[1]), float(top[0]), s / (len(p) + 20.0) * 20.0)


def fit_texts(texts: list[str], y: np.ndarray, seed: int = 5, clean_windows: int = CLEAN_WINDOWS) -> Model:
    """Fit from texts and labels 0/1. One class alone gives a constant score.

    The chain sees every window with toxic tokens, and ``clean_windows`` random windows of a clean text.
    """
    y = np.asarray(y, int)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model({}, -10.0, np.zeros((2, 2)), 0.0, (float(np.log(p / (1 - p))), 0.0, 0.0, 0.0, 0.0))
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in _TOKEN.findall(t or "")], np.int32) for t in texts]
    vocabulary = list(place)
    del place
    rng = np.random.default_rng(seed)
    is_bad = toxic_words(docs, vocabulary, y)
    seqs, labels = [], []
    for ws, label in zip(docs, y):
        if not len(ws):
            continue
        marks = (is_bad[ws] & bool(label)).astype(np.int8)
        n = -(-len(ws) // WINDOW)
        cut = range(n)
        if label:  # windows with toxic tokens and one other
            cut = sorted({int(t) // WINDOW for t in np.flatnonzero(marks)} | {int(rng.integers(n))})
        elif n > clean_windows:
            cut = sorted(rng.choice(n, clean_windows, replace=False).tolist())
        for c in cut:
            seqs.append(ws[c * WINDOW : (c + 1) * WINDOW])
            labels.append(marks[c * WINDOW : (c + 1) * WINDOW])
    weights, bias, transition, start = train_chain(seqs, labels, vocabulary)
    odds = np.array([emission(weights, bias, w) for w in vocabulary])
    x = np.array([doc_features(p) for i in range(0, len(docs), 500) for p in marginals([odds[d] for d in docs[i : i + 500]], transition, start)])
    a = np.c_[np.ones(len(x)), x]
    theta = np.zeros(a.shape[1])
    for _ in range(50):  # ridge logistic regression by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        ridge = np.diag([1e-6] + [0.05] * x.shape[1])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ theta)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights, bias, transition, start, tuple(map(float, theta)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``bound`` labelled documents outside the held-out fold; their texts come to the driver.

    An id counts once, with the text of least hash. Documents beyond ``chars`` characters of all of
    them together (least hash of the id first) are left out whole.
    """
    ids = common.labelled_sample(labels, "toxic", bound).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    one = texts.groupBy("_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    sample = common.written(one, "toxic-sample")
    held = sample.select("_id", F.length("text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    total = np.cumsum([r.n for r in held])
    if len(held) and total[-1] > chars:
        sample = sample.where(F.col("_id").isin([r["_id"] for r, t in zip(held, total) if t <= chars]))
    rows = sample.toPandas().sort_values("_id")
    return fit_texts(rows["text"].tolist(), rows["label"].to_numpy())


# ------------------------------------------------------------------------------- scoring


def tag(docs: DataFrame, model: Model, span_at: float = 0.5) -> DataFrame:
    """Tag every whole text: doc_id, score, n_toxic, spans (start, end, p) of tokens whose marginal reaches ``span_at``.

    Places are code points. Empty and null texts have no spans and the score of a text without
    toxic tokens. Null ids stay null, repeated rows stay repeated, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias, transition, start, doc = shared.value
        head, tail = doc[0], np.array(doc[1:])
        cache: dict[str, float] = {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            seqs = []
            for text in texts:
                ws = _TOKEN.findall(text)
                try:
                    seqs.append(np.array([cache[w] for w in ws], float))
                except KeyError:
                    if len(cache) > CACHE:
                        cache.clear()
                    for w in ws:
                        if w not in cache:
                            cache[w] = emission(weights, bias, w)
                    seqs.append(np.array([cache[w] for w in ws], float))
            scores, counts, spans = [], [], []
            for text, p in zip(texts, marginals(seqs, transition, start)):
                scores.append(float(1 / (1 + np.exp(-np.clip(head + tail @ np.array(doc_features(p)), -30, 30)))))
                hit = set(np.flatnonzero(p >= span_at).tolist())
                counts.append(len(hit))
                spans.append([{"start": m.start(), "end": m.end(), "p": float(p[t])} for t, m in enumerate(_TOKEN.finditer(text)) if t in hit] if hit else [])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "n_toxic": counts, "spans": spans})

    slim = common.in_small_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInPandas(common.releasing(run), OUT).withColumn("doc_id", F.col("doc_id").cast("long"))


def scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Digest: doc_id, held_out, score, predicted, n_toxic."""
    slim = docs.select("doc_id", "text")
    out = tag(slim, fit(slim, labels, bound))
    return out.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic")
