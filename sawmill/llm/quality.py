"""Quality classifier: a sparse ensemble of rules over document statistics.

Boosted shallow trees over statistics of a bounded labelled sample propose rules (every path from
a root is one conjunction), a lasso logistic regression gives most of them weight zero, and the
rest is compiled into one Spark column expression. Scoring is a narrow map without Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents used for the fit (least hash of the id first). The only sampling here.
SAMPLE = 6_000
THRESHOLD = 0.7
#: Rules of a model: the penalty rises until so many have weight.
MAX_RULES = 60


class Rule(NamedTuple):
    conditions: tuple[tuple[str, str, float], ...]  # statistic, "<=" or ">", value
    weight: float


class Model(NamedTuple):
    rules: list[Rule]
    intercept: float


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; those of an empty or null text are all defined (0, or 1 for ratios of nothing)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.split(F.trim(t), r"\s+")
    lines = F.split(t, "\n")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    distinct = F.size(F.array_distinct(words)).cast("double")
    n_lines = F.size(lines).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    def char(c: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")

    return {
        "log_words": F.log1p(n_words),
        "word_length": chars / n_words,
        "distinct": distinct / n_words,
        "richness": distinct / F.sqrt(n_words),
        "capitals": count(r"\p{Lu}{2}") / n_words,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / chars,
        "digits": count(r"[0-9]") / chars,
        "bars": char("|") / n_words,
        "bangs": char("!") / n_words,
        "stops": char(".") / n_words,
        "commas": char(",") / n_words,
        "line_words": n_words / n_lines,
        "line_repeats": 1 - F.size(F.array_distinct(lines)) / n_lines,
        "repeats": count(r"(?<!\S)(\S{1,40})\s+\1(?!\S)") / n_words,
    }


#: The statistics' names, in the order of a model's columns.
NAMES = [
    "log_words", "word_length", "distinct", "richness", "capitals", "symbols", "digits", "bars", "bangs", "stops", "commas", "line_words", "line_repeats", "repeats",
]


# ------------------------------------------------------------------------------ the fit


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """One tree by second-order gain: paths of all its nodes, and each row's value."""
    paths, value = [], np.zeros(len(x))

    def node(at: np.ndarray, path: tuple, left: int) -> None:
        if path:
            paths.append(path)
        best = (1e-6, None)
        if left and len(at) >= 2 * least:
            g, h = grad[at].sum(), hess[at].sum()
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                b = binned[at, f]
                cg, ch = np.bincount(b, grad[at], k).cumsum()[:-1], np.bincount(b, hess[at], k).cumsum()[:-1]
                cn = np.bincount(b, minlength=k).cumsum()[:-1]
                ok = (cn >= least) & (len(at) - cn >= least)
                gain = np.where(ok, cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1), -1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (f, j))
        if best[1] is None:
            value[at] = -grad[at].sum() / (hess[at].sum() + 1)
            return
        f, j = best[1]
        low = binned[at, f] <= j
        node(at[low], (*path, (f, "<=", float(cuts[f][j]))), left - 1)
        node(at[~low], (*path, (f, ">", float(cuts[f][j]))), left - 1)

    node(rows, (), depth)
    return paths, value


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, v in path:
        out &= (x[:, f] <= v) if op == "<=" else (x[:, f] > v)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is free."""
    n, k = r.shape
    v, norm = np.ones(k, r.dtype), 1.0
    for _ in range(30):  # largest singular value by power iteration
        v = r.T @ (r @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 4.0 / (1.05 * norm / n + 1)
    w, b = np.zeros(k), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(r @ zw.astype(r.dtype) + zb, -30, 30)))
        gw, gb = ((p - y).astype(r.dtype) @ r) / n, float((p - y).mean())
        nw = zw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_arrays(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> Model:
    """Rules and weights from statistics ``x`` (columns as NAMES) and labels 0/1. One class alone gives a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model([], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least = max(5, len(y) // 400)
    paths: dict[frozenset, tuple] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        got, _ = grow(x, cuts, binned, p - y, p * (1 - p), rows, depth, least)
        paths |= {frozenset(path): path for path in got}
        # Values of leaves reach all rows, drawn or not.
        leaves = [q for q in got if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in got)]
        for q in leaves:
            at = holds(x, q)
            mine = at & np.isin(np.arange(len(y)), rows)
            raw[at] += 0.3 * -(p - y)[mine].sum() / ((p * (1 - p))[mine].sum() + 1)
    kept, cols, seen = [], [], set()
    for path in paths.values():
        c = holds(x, path)
        key = c.tobytes()
        if 0.003 < c.mean() < 0.997 and key not in seen and (~c).tobytes() not in seen:
            seen.add(key)
            kept.append(path)
            cols.append(c)
    if not kept:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    r = np.empty((len(y), len(cols)), np.float32)
    for j, c in enumerate(cols):
        r[:, j] = c
    mean, scale = r.mean(0, dtype=float), r.std(0, dtype=float)
    r -= mean.astype(np.float32)
    r /= scale.astype(np.float32)
    while True:  # few rules compile into one small expression
        w, b = lasso_logistic(r, y.astype(np.float32), penalty)
        if (w != 0).sum() <= MAX_RULES:
            break
        penalty *= 1.6
    w = w / scale
    b -= float((w * mean).sum())
    return Model([Rule(tuple((NAMES[f], op, v) for f, op, v in path), float(v)) for path, v in zip(kept, w) if v], b)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Fit on at most ``bound`` labelled documents outside the held-out fold.

    Only the text is an input. The sample's ids are at most ``bound`` rows, so they are broadcast;
    its statistics (a few numbers for each, one row for an id: the least ones) come to the driver.
    Null texts count as empty.
    """
    ids = common.labelled_sample(labels, "quality", bound).select(F.col("doc_id").alias("_id"), "label")
    stats = statistics(F.col("text"))
    rows = (
        docs.select(F.col("doc_id").alias("_doc"), "text")
        .join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
        .select("_id", "label", F.struct(*[c.cast("double").alias(k) for k, c in stats.items()]).alias("of"))
        .groupBy("_id", "label")
        .agg(F.min("of").alias("of"))
        .select("_id", "label", "of.*")
        .toPandas()
        .sort_values("_id")
    )
    return fit_arrays(rows[NAMES].to_numpy(float), rows["label"].to_numpy(int))


def compiled(model: Model) -> Column:
    """The model as a column expression over columns named as the statistics."""
    total = F.lit(model.intercept)
    for rule in model.rules:
        cond = None
        for name, op, value in rule.conditions:
            c = F.col(name) <= value if op == "<=" else F.col(name) > value
            cond = c if cond is None else cond & c
        total = total + F.when(cond, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns plus ``score`` (0 to 1). Empty and null texts get a score like any other.

    Columns of the input may have any names: the statistics live in a struct meanwhile.
    """
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "score"]).alias("_row"), *[c.alias(k) for k, c in statistics(docs["text"]).items()])
    return inner.select("_row.*", compiled(model).alias("score"))


def scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Digest: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    out = with_scores(slim, fit(slim, labels, bound))
    return out.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
