"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece of it then stands in the text unchanged, so an automaton over all pieces finds
every place worth a look; Myers' bit-parallel algorithm verifies the edit distance there.
Items and texts stand between spaces, so an item matches whole words ("the" not within "other")
unless it pays an edit for each end. Items of fewer than ``LEAST`` characters are words of the
language rather than passages; they are not searched, since they would stand in every document.
Items go to the executors in blocks of bounded size, one scan of the documents for each block.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits allowed, as a share of an item's normalised characters.
ERROR_RATE = 0.05
#: Normalised characters of an item at least.
LEAST = 8
#: Normalised characters of items in one scan (the automaton takes some 100 bytes for each).
BLOCK_CHARS = 1_000_000
HITS = "doc_id long, text_hash long, item_id long, distance int, start long, end long"
_GAP = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Lower case; runs of anything but letters and digits become one space."""
    return _GAP.sub(" ", text.lower()).strip()


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """(k, k + 1 pieces with their offsets) of a normalised item."""
    k = int(len(item) * rate)
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` if at most k, with the end of the first such place."""
    m = len(pattern)
    if not m:
        return None
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def automaton(items: list[tuple[int, str]], rate: float):
    import ahocorasick

    where = defaultdict(list)
    prepared = []
    for item_id, text in items:
        norm = normalise(text or "")
        if len(norm) < LEAST:
            continue
        norm = f" {norm} "
        k, parts = pieces(norm, rate)
        prepared.append((item_id, norm, k))
        for at, piece in parts:
            where[piece].append((len(prepared) - 1, at))
    auto = ahocorasick.Automaton()
    for piece, places in where.items():
        auto.add_word(piece, (len(piece), places))
    if where:
        auto.make_automaton()
    return auto if where else None, prepared


def match(text: str, auto, prepared) -> list[tuple[int, int, int, int]]:
    """(item_id, distance, start, end) of each item's best place; places are in the normalised text, start approximate by the edits."""
    norm = f" {normalise(text)} "
    spans = defaultdict(set)
    for end, (size, places) in auto.iter(norm):
        for item, at in places:
            spans[item].add(end + 1 - size - at)
    out = []
    for item, starts in spans.items():
        item_id, pattern, k = prepared[item]
        best, lo, hi = None, None, None
        for s in [*sorted(starts), None]:  # overlapping windows are verified as one
            if hi is not None and (s is None or s - k > hi):
                if (got := myers(pattern, norm[lo:hi], k)) and (best is None or got[0] < best[1]):
                    end = lo + got[1]
                    best = (item_id, got[0], max(0, end - len(pattern)), max(0, end - 2))  # without the spaces around
                lo = hi = None
            if s is not None:
                lo = max(0, s - k) if lo is None else lo
                hi = s + len(pattern) + k
        if best:
            out.append(best)
    return out


def _hits(docs: DataFrame, benchmark: DataFrame, rate: float, block_chars: int) -> DataFrame:
    docs = common.in_small_batches(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    text = text.withColumn("text_hash", common.text_hash())
    out = None
    for b in range(blocks):
        # A block is total / blocks characters, give or take the hash: at most about block_chars.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.distinct().collect()])

        def run(batches, shared=shared):
            auto, prepared = automaton(shared.value, rate)
            for pdf in batches:
                rows = [] if auto is None else [(d, h, *hit) for d, h, t in zip(pdf["doc_id"].tolist(), pdf["text_hash"].tolist(), pdf["text"].tolist()) for hit in match(t, auto, prepared)]
                yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "item_id", "distance", "start", "end"]).astype("int64")

        found = text.mapInPandas(common.releasing(run), HITS)
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that stands in it: doc_id, item_id, distance, start, end.

    Null or empty texts and items match nothing; items of fewer than LEAST letters, digits and
    spaces are not searched. Rows of documents without an id are skipped. Repeated rows give
    repeated hits. Clean documents give no row. Other columns of both tables are ignored.
    """
    return _hits(docs, benchmark, rate, block_chars).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows whose text holds no item, all columns kept; rows without an id stay, and so does a clean text that shares its id with another."""
    return common.without_rows(docs, _hits(docs, benchmark, rate, block_chars).select("doc_id", "text_hash"))
