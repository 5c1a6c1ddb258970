"""Substring dedup: remove words covered by windows that also start in an earlier document.

A window is ``SPAN`` consecutive words. Method: a count-min prefilter, then exact grouping.

1. Every task sketches its documents: a window counts in the cell of the least hash of its
   ``SUB``-word parts (equal windows have equal least parts), once for each document. Sketches are
   sparse, so a cell costs something only where a part fell, and there are enough cells for any
   corpus. They are merged by dealing cells to tasks, which add up the counts: estimates are never
   too low, so no repeated window is lost, and no task or driver holds a whole sketch. What several
   documents of a task share is known to repeat there at once and travels as one count.
2. Cells estimated over one go back to the documents that asked. A second pass takes the windows
   of those cells only and groups them exactly by 128 bits of the whole word sequence. Windows that
   repeat within a task are settled there: only the task's earliest document of each window goes
   through the shuffle, so a passage that a third of the corpus holds costs one row for each task.
3. Removed places meet their documents by id and text hash.

Both ways back send their rows to every task while they are few (their bytes are counted first);
beyond that only documents that have a place are shuffled, never all texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SPAN, SUB = 50, 25
#: Cells of the sketch. They exist only where a part falls; 10^12 parts (some 100 TB of text) load them to 6 %.
CELLS = 1 << 44
#: Bytes of answers or places that are sent to every task. Both grow with the input, so the bound is low and the plan mostly the same.
PLACES_BYTES = 250_000
#: Times that a document holds a window from which on its places travel together.
OFTEN = 8
#: Words that one task settles at once.
CHUNK_WORDS = 1_500_000

with np.errstate(over="ignore"):
    _B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; the base is odd."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Roller:
    """Hashes of all runs of a given length over a sequence of word hashes."""

    def __init__(self):
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.p = [_powers(b, self.n) for b in (_B1, _B2)]

    def runs(self, words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        self._grow(n)
        up, down = self.p[which]
        with np.errstate(over="ignore"):
            w = _mix(words) if which else words
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:n], dtype=np.uint64)])
            return _mix((total[size:] - total[:-size]) * down[: n - size + 1])


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    have, out = 1, x
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def window_parts(words: np.ndarray, roller: Roller) -> np.ndarray:
    """For each window the least hash of its SUB-word parts."""
    if len(words) < SPAN:
        return np.zeros(0, np.uint64)
    return _sliding_min(roller.runs(words, SUB), SPAN - SUB + 1)


def _cells(parts: np.ndarray, cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(parts + np.uint64(0x632BE59BD9B4E019)) % np.uint64(cells)).astype(np.int64)


def _sketch(cells: int):
    """documents -> sparse task sketches: (cell, n, row, known).

    A cell that one document of the chunk reached asks for an answer (n 1, its row); one that several
    reached counts 2 and asks for none: their flagged cells are ``known`` (packed, one line for a row,
    under a cell of its own below zero).
    """

    def run(batches):
        roller, per, rows, held = Roller(), [], [], 0

        def flush():
            doc = np.repeat(np.arange(len(per)), [len(x) for x in per])
            cell = np.concatenate(per)
            order = np.argsort(cell, kind="stable")
            cell, doc = cell[order], doc[order]
            new = np.flatnonzero(np.diff(cell, prepend=-1))
            n = np.diff(np.append(new, len(cell)))
            row = np.array(rows, np.int64)
            one = new[n == 1]
            yield pd.DataFrame({"cell": cell[one], "n": np.int32(1), "row": pd.array(row[doc[one]], dtype="Int64"), "known": None})
            more = new[n > 1]
            yield pd.DataFrame({"cell": cell[more], "n": np.int32(2), "row": pd.array([None] * len(more), dtype="Int64"), "known": None})
            hot = np.repeat(n > 1, n)
            cell, doc = cell[hot], doc[hot]
            by = np.argsort(doc, kind="stable")
            cell, doc = cell[by], doc[by]
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            packed = [x.tobytes() for x in np.split(cell, cut[1:])] if len(cut) else []
            mine = row[doc[cut]] if len(cut) else np.zeros(0, np.int64)
            yield pd.DataFrame({"cell": -1 - (mine & 0x7FFFFFFFFFFFFFF), "n": np.int32(2), "row": pd.array(mine, dtype="Int64"), "known": packed})

        for pdf in batches:
            for row, text in zip(pdf["row"].tolist(), pdf["text"].tolist()):
                c = np.unique(_cells(window_parts(hashed(words_of(text)), roller), cells))
                if len(c):
                    per.append(c)
                    rows.append(row)
                    held += len(c)
            if held >= CHUNK_WORDS:
                yield from flush()
                per, rows, held = [], [], 0
        if per:
            yield from flush()

    return run


def prefilter(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Merged sketches, answered: row, cells (of an estimate over one, distinct), known (packed ones). Rows without any are absent."""
    sketches = docs.select("row", "text").mapInPandas(common.releasing(_sketch(cells)), "cell long, n int, row long, known binary")
    # One line of a cell for each chunk at most.
    counted = sketches.withColumn("estimate", F.sum("n").over(Window.partitionBy("cell")))
    asked = counted.where("estimate > 1 and row is not null")
    return asked.groupBy("row").agg(F.collect_set(F.when(F.col("known").isNull(), F.col("cell"))).alias("cells"), F.collect_set("known").alias("known"))


def _runs(at: np.ndarray) -> bytes:
    """Rising places as (first, how many) runs."""
    cut = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return np.stack([at[cut], np.diff(np.append(cut, len(at)))], 1).astype(np.int32).tobytes()


def _candidates(cells: int):
    """documents with their cells -> windows estimated repeated: (h1, h2, doc_id, row, at, runs, settled).

    A window's place is in ``at``; one that its document holds OFTEN or more times has one line with
    runs of places. Windows with an earlier document in their chunk are settled: runs
    too, one line for a document.
    """

    def run(batches):
        roller = Roller()
        hold: list[tuple] = []
        held = 0

        def flush():
            h1, h2, at = (np.concatenate([x[k] for x in hold]) for k in range(3))
            n = [len(x[2]) for x in hold]
            line, doc = np.repeat(np.arange(len(hold)), n), np.repeat([x[3] for x in hold], n)
            ids, rows = np.array([x[3] for x in hold], np.int64), np.array([x[4] for x in hold], np.int64)

            def frame(h1, h2, mine, at, runs, settled):
                at = pd.array(at if at is not None else [None] * len(mine), dtype="Int32")
                return pd.DataFrame({"h1": h1, "h2": h2, "doc_id": ids[mine], "row": rows[mine], "at": at, "runs": runs, "settled": settled})

            order = np.lexsort((line, doc, h2, h1))  # stable: places keep rising
            h1, h2, at, doc, line = h1[order].view(np.int64), h2[order].view(np.int64), at[order], doc[order], line[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            late = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            open_ = np.flatnonzero(~late)
            cut = np.flatnonzero(new[open_] | (np.diff(line[open_], prepend=-1) != 0))
            n = np.diff(np.append(cut, len(open_)))
            one = open_[np.repeat(n < OFTEN, n)]
            one = one[np.lexsort((at[one], line[one]))]  # neighbours compress well
            yield frame(h1[one], h2[one], line[one], at[one], None, False)
            if (n >= OFTEN).any():
                first = open_[cut[n >= OFTEN]]
                yield frame(h1[first], h2[first], line[first], None, [_runs(at[open_[a : a + k]]) for a, k in zip(cut[n >= OFTEN], n[n >= OFTEN])], False)
            by = np.flatnonzero(late)
            by = by[np.lexsort((at[by], line[by]))]
            cut = np.flatnonzero(np.diff(line[by], prepend=-1))
            if len(cut):
                mine = line[by][cut]
                yield frame(rows[mine], ids[mine], mine, None, [_runs(x) for x in np.split(at[by], cut[1:])], True)

        for pdf in batches:
            for doc_id, row, text, mine, known in zip(pdf["doc_id"].tolist(), pdf["row"].tolist(), pdf["text"].tolist(), pdf["cells"], pdf["known"]):
                w = hashed(words_of(text))
                flagged = np.concatenate([np.asarray(mine, np.int64), *[np.frombuffer(x, np.int64) for x in known]])
                at = np.flatnonzero(np.isin(_cells(window_parts(w, roller), cells), flagged))
                if len(at):
                    hold.append((roller.runs(w, SPAN)[at], roller.runs(w, SPAN, 1)[at], at, doc_id, row))
                    held += len(at)
                if held >= CHUNK_WORDS:
                    yield from flush()
                    hold, held = [], 0
        if hold:
            yield from flush()

    return run


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    n_words, n_removed, kept_text = [], [], []
    for text, ats, held in zip(pdf["text"].tolist(), pdf["ats"], pdf["runs"]):
        words = words_of(text)
        n_words.append(len(words))
        if ats is not None:
            runs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in held]
            runs = np.concatenate([np.stack([np.asarray(ats, np.int32), np.ones(len(ats), np.int32)], 1), *runs]).astype(np.int64)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0], 1)
            np.subtract.at(edge, np.minimum(runs.sum(1) + SPAN - 1, len(words)), 1)
            keep = np.cumsum(edge[:-1]) == 0
            words = [w for w, k in zip(words, keep.tolist()) if k]
        n_removed.append(n_words[-1] - len(words))
        kept_text.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept": kept_text})


def _finish(batches):
    return map(_cut, batches)


def remove_repeats(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Every document with its repeated words removed: doc_id, n_words, n_removed, kept (words joined by one space).

    A document with a smaller id keeps the words; equal ids (repeated rows) never remove from each
    other. Rows with a null id keep all their words and remove nothing; null and empty texts have
    no words. Other columns are ignored. An empty table gives an empty table. Fewer ``cells`` let
    more candidates pass and change no result.
    """
    docs = common.in_small_batches(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text", "doc_id"))
    known = rows.where("doc_id is not null and length(text) >= 99")  # 50 words take 99 characters
    # An answer shared by two rows of one hash flags more than it must, never less.
    answers = common.written(prefilter(known, cells), "answers")
    asked = common.join_texts(known, answers, ["row"], F.size("cells") * 8 + F.coalesce(F.aggregate("known", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)), most=PLACES_BYTES)
    found = asked.select("doc_id", "row", "text", "cells", "known").mapInPandas(common.releasing(_candidates(cells)), "h1 long, h2 long, doc_id long, row long, at int, runs binary, settled boolean")
    # A window has at most one document of each chunk here, so its group is bounded by the chunks.
    late = found.withColumn("first", F.min("doc_id").over(Window.partitionBy("h1", "h2"))).where("settled or first < doc_id")
    places = common.written(late.groupBy("doc_id", "row").agg(F.collect_set("at").alias("ats"), F.collect_set("runs").alias("runs")), "places")
    sized = F.size("ats") * 4 + F.coalesce(F.aggregate("runs", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))
    out = common.join_texts(rows, places, ["doc_id", "row"], sized, "left", PLACES_BYTES).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "ats", "runs")
    return out.mapInPandas(common.releasing(_finish), "doc_id string, n_words long, n_removed long, kept string").withColumn("doc_id", F.col("doc_id").cast("long"))
