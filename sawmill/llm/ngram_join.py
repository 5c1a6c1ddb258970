"""N-gram Jaccard join: a size-aware join of light and heavy sets of word shingles.

Sets are those of distinct 5-word shingles; two documents link when their Jaccard similarity
reaches 0.8. Equal sets are one node from the start. Candidates come from a size-aware join:

* Elements have one global order: rare ones first, by the counts of a sketch of bounded size.
  Any common order is right; this one keeps shared passages out of most prefixes.
  A pair that links shares at least k elements within prefixes of size - ceil(0.8 size) + k.
* Light sets, up to a boundary size, enumerate the 2-element subsets of their prefix (k = 2):
  two light sets that link share a subset.
* Heavy sets post their prefix (k = 1) in inverted lists, which heavy sets and those light sets
  that a heavy one could link with scan. The boundary is the size that minimises the cost of
  enumerating against that of scanning over the actual sizes.

Only verified links unite documents. A task links the sets of its own chunk exactly, and posts one
set of each linked group in a list, so a group of copies costs a list one row for each chunk. Then:

1. In a list, all pairs of up to ``SHORT`` posted sets whose sizes could link are verified; in a
   longer one each set with the one before it. Links unite groups.
2. What that leaves open is compared whole: where two posted sets did not link but stand for more
   sets, all members of the two groups (each within one chunk, so of bounded bytes); of long lists
   that still hold several groups, all sets of overlapping lists, in one task if they fit and else
   block by block. A set of the largest group is compared with those of the others only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, TIMES, OF = 5, 80, 100
#: Cost of scanning one posting, against enumerating one subset.
SCAN_COST = 4.0
#: Cells in each of the two rows of the sketch of element counts: grows with the input up to 16 MB.
MIN_CELLS, MAX_CELLS, CELL_BLOCK = 1 << 18, 1 << 24, 1 << 18
#: Sizes of one class link with sizes of the classes next to it only.
CLASS = math.log(OF / TIMES)
#: Characters of text whose elements are counted together.
CHUNK_CHARS = 6_000_000
#: Posted sets of a list of which all pairs are verified.
SHORT = 16
#: Bytes of sets that one task compares.
TASK_BYTES = 32_000_000
#: Bits of the filter of nodes whose sets are wanted.
FILTER_BITS = 1 << 28

with np.errstate(over="ignore"):
    _B = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes. Fewer than five words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            total += w[i : i + n] * _B[i]
    return np.unique(_mix(total))


def node_of(s: np.ndarray) -> int:
    """One 64-bit number for a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def needed(size: int) -> int:
    """Elements that a set must share with any set it links with."""
    return -(-TIMES * size // OF)


def links(shared: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return OF * shared >= TIMES * (a + b - shared)


def prefix_size(size: int, k: int) -> int:
    return min(size, size - needed(size) + k)


def _places(elements: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64(cells - 1)
    return [(elements & mask).astype(np.int64), ((elements >> np.uint64(32)) & mask).astype(np.int64)]


class Order:
    """The global order of elements: by rising (estimated, quantised) count, then by hash."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        a, b = _places(s, self.sketch.shape[1])
        return s[np.lexsort((s, np.minimum(self.sketch[0, a], self.sketch[1, b])))[:n]]


def signatures(s: np.ndarray, order: Order, boundary: int) -> np.ndarray:
    """What a set posts: subsets of its prefix if it is light, elements if it is heavy or may link with a heavy set."""
    size, out = len(s), []
    if 2 <= size <= boundary:
        p = order.prefix(s, prefix_size(size, 2))
        i, j = np.triu_indices(len(p), 1)
        lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
        with np.errstate(over="ignore"):
            out.append(_mix(lo * np.uint64(0xBF58476D1CE4E5B9) + _mix(hi)))
    if size > 0.8 * boundary:
        out.append(order.prefix(s, prefix_size(size, 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def choose_boundary(sizes: list[tuple[int, int]], scan_cost: float = SCAN_COST, most: int = 512) -> int:
    """The light sets' largest size: least cost over the sizes (size, how many)."""

    def scan(s: int) -> float:
        return scan_cost * prefix_size(s, 1)

    def cost(b: int) -> float:
        return sum(n * ((math.comb(prefix_size(s, 2), 2) + (scan(s) if s > 0.8 * b else 0)) if s <= b else scan(s)) for s, n in sizes if s >= 2)

    return min(range(1, most + 1), key=lambda b: (cost(b), b)) if sizes else 1


# ---------------------------------------------------------------------- passes over texts


def _members(cells: int):
    """documents -> (kind 0) doc_id, size, node of each row; (kind 1) the task's counts of elements, by blocks of cells."""

    def run(batches):
        counts = np.zeros((2, cells), np.uint8)
        chunk, seen, held = [], set(), 0

        def add():
            for row, at in zip(counts, _places(np.concatenate(chunk), cells)):
                at, n = np.unique(at, return_counts=True)
                row[at] = np.minimum(255, row[at] + n)

        for pdf in batches:
            rows = []
            for doc_id, text, text_hash in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["text_hash"].tolist()):
                s = shingles(text)
                node = node_of(s)
                rows.append((0, doc_id, text_hash, len(s), node, None))
                if doc_id is not None and len(s) and node not in seen:
                    seen.add(node)
                    chunk.append(s)
                    held += len(text)
                    if held >= CHUNK_CHARS:
                        add()
                        chunk, seen, held = [], set(), 0
            yield pd.DataFrame(rows, columns=["kind", "doc_id", "text_hash", "size", "node", "data"])
        if chunk:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        width = min(cells, CELL_BLOCK)
        for r in range(2):
            rows = [(1, None, 0, r, k // width, pack(counts[r, k : k + width].tobytes())) for k in range(0, cells, width) if counts[r, k : k + width].any()]
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "doc_id", "text_hash", "size", "node", "data"])

    return run


def _merge_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block of cells, quantised by their logarithm to a byte."""
    total = None
    for raw in pdf["data"]:
        got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        total = got.astype(np.float64) if total is None else total + got
    out = np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)
    return pd.DataFrame({"r": pdf["size"].iloc[:1], "block": pdf["node"].iloc[:1], "data": [out.tobytes()]})


def _local(sets: list[np.ndarray], sigs: list[np.ndarray]) -> np.ndarray:
    """For each set of a chunk the first set that it is linked with, through others or not; exact."""
    up = np.arange(len(sets))
    sig = np.concatenate(sigs)
    who = np.repeat(up, [len(x) for x in sigs])
    at = np.argsort(sig, kind="stable")
    sig, who = sig[at], who[at]
    same = sig[1:] == sig[:-1]
    if same.any():
        nodes, root = common.roots(who[1:][same], who[:-1][same])
        for first in np.unique(root):
            group = nodes[root == first]
            up[group] = group[solve([sets[i] for i in group])]
    return up


def _postings(sketch, boundary: int):
    """documents -> rows (kind, sig, class, node, group).

    Kind 0: a posted set; group is 0, or names the chunk's linked group that it stands for. Kind 1:
    a member of a group. Kind 2: a link within the chunk, the other node in group. The latter two
    are dealt by their node, which is in sig as well.
    """

    def flush(sets, nodes, order):
        sigs = [signatures(s, order, boundary) for s in sets]
        up = _local(sets, sigs)
        node = np.array(nodes, np.int64)
        size = np.array([int(math.log(len(s)) / CLASS + 1e-9) for s in sets], np.int32)
        members = np.bincount(up, minlength=len(up))
        salt = xxhash.xxh3_64_intdigest(node.tobytes())
        with np.errstate(over="ignore"):
            name = (_mix(node.view(np.uint64) + np.uint64(salt)) | np.uint64(1)).view(np.int64)
        group = np.where(members[up] > 1, name[up], 0)
        n = [len(x) for x in sigs]
        sig, who = np.concatenate(sigs).view(np.int64), np.repeat(np.arange(len(sets)), n)
        # One line for a list, a size class and a linked group: that of the group's first set, if it has the signature.
        at = np.lexsort((who, up[who], size[who], sig))
        sig, who = sig[at], who[at]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (size[who[1:]] != size[who[:-1]]) | (up[who[1:]] != up[who[:-1]])
        sig, who = sig[new], who[new]
        yield pd.DataFrame({"kind": np.int8(0), "sig": sig, "class": size[who], "node": node[who], "group": group[who]})
        several = np.flatnonzero(group)
        yield pd.DataFrame({"kind": np.int8(1), "sig": node[several], "class": np.int32(0), "node": node[several], "group": group[several]})
        linked = np.flatnonzero(up != np.arange(len(up)))
        yield pd.DataFrame({"kind": np.int8(2), "sig": node[linked], "class": np.int32(0), "node": node[linked], "group": node[up[linked]]})

    def run(batches):
        order = Order(sketch.value)
        sets, nodes, seen, held = [], [], set(), 0
        for pdf in batches:
            for text in pdf["text"].tolist():
                s = shingles(text)
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                sets.append(s)
                nodes.append(node)
                held += len(text)
                if held >= CHUNK_CHARS:
                    yield from flush(sets, nodes, order)
                    sets, nodes, seen, held = [], [], set(), 0
        if sets:
            yield from flush(sets, nodes, order)

    return run


def _pairs(short: int):
    """Rows of ``_postings``, posted sets by list and size class -> (kind, a, b, ga, gb).

    Kind 0: a pair to verify, with its groups. Kind 1: a row of a list longer than ``short``: a is
    the list, b the node. Kinds 2 and 3: members and links (1 and 2 there), passed on. A task holds a
    batch and at most ``short`` rows more: of a longer list only its last row is kept.
    """

    def of(sig, size, node, group, opened: bool):
        """Whole lists; the first one, if ``opened``, is long and goes on from its row 0, which was given before."""
        start = np.flatnonzero(np.diff(sig, prepend=sig[:1] - 1))
        length = np.diff(np.append(start, len(sig)))
        long = np.repeat(length > short, length)
        if opened:
            long[: length[0]] = True
        left, right = [], []
        for step in range(1, min(short, int(length.max()))):
            here = np.arange(len(sig) - step)
            ok = (sig[here] == sig[here + step]) & (size[here + step] - size[here] <= 1) & (node[here] != node[here + step])
            if step > 1:
                ok &= ~long[here]
            left.append(here[ok])
            right.append(here[ok] + step)
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            rows = np.unique(np.stack([node[x], node[y], group[x], group[y]], 1), axis=0)
            yield pd.DataFrame({"kind": np.int8(0), "a": rows[:, 0], "b": rows[:, 1], "ga": rows[:, 2], "gb": rows[:, 3]})
        new = np.flatnonzero(long)[int(opened) :]
        yield pd.DataFrame({"kind": np.int8(1), "a": sig[new], "b": node[new], "ga": group[new], "gb": np.int64(0)})

    def run(batches):
        rest, opened = None, False
        for pdf in batches:
            posted = pdf["kind"].to_numpy() == 0
            if not posted.all():
                other = pdf[~posted]
                yield pd.DataFrame({"kind": (other["kind"] + 1).astype("int8"), "a": other["node"], "b": other["group"], "ga": np.int64(0), "gb": np.int64(0)})
            if not posted.any():
                continue
            got = [pdf[c].to_numpy()[posted] for c in ("sig", "class", "node", "group")]
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            # The last list may go on in the next batch.
            end = int(np.searchsorted(got[0], got[0][-1]))
            if len(got[0]) - end > short or opened and end == 0:
                yield from of(*got, opened)
                rest, opened = [x[-1:] for x in got], True
                continue
            if end:
                yield from of(*[x[:end] for x in got], opened)
                opened = False
            rest = [x[end:] for x in got]
        if rest is not None:
            yield from of(*rest, opened)

    return run


def _sets(bits):
    """documents -> (node, elements), each node once a task, of nodes that pass the filter."""

    def run(batches):
        keep = bits.value
        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                s = shingles(text)
                node = node_of(s)
                at = node & (len(keep) * 8 - 1)
                if len(s) and keep[at >> 3] >> (at & 7) & 1 and node not in seen:
                    seen.add(node)
                    rows.append((node, s.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "elements"]).astype({"node": "int64"})

    return run


# ------------------------------------------------------------------------ exact solving


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.up[others], self.up[i]))
        self.up[np.isin(self.up, roots)] = roots[0]


def solve(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of the first set in its component; exact. Sets of one ``known`` component are together from the start.

    A set is compared with all others, one after another, until all that were not are in one
    component: any link among those is within it.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, bool)
    union, done = _Union(m), np.zeros(m, bool)
    if known is not None:
        _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
        union.up = first[inverse]
    while True:
        left = np.flatnonzero(~done)
        if not len(left):
            break
        comp, n = np.unique(union.up[left], return_counts=True)
        if len(comp) == 1:
            break  # whatever was not compared is in one component
        rest = left[union.up[left] != comp[n.argmax()]]
        i = int(rest[0]) if len(comp) > 1 else int(left[0])
        mine = codes[start[i] : start[i] + size[i]]
        mark[mine] = True
        shared = np.add.reduceat(mark[codes], start)
        mark[mine] = False
        union.join(i, np.flatnonzero(links(shared, int(size[i]), size)))
        done[i] = True
    return union.up


def _bytes(x) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _verified(batches):
    """Rows (a, b, elements) in order of a, that of a itself (b = a) first -> the pairs that link."""
    mine, of = None, None
    for pdf in batches:
        ok = []
        for a, b, raw in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["elements"]):
            s = _bytes(raw)
            if b == a:
                mine, of = s, a
            elif of == a:
                ok.append((a, b) if links(np.array([len(np.intersect1d(mine, s, assume_unique=True))]), len(mine), np.array([len(s)]))[0] else None)
        yield pd.DataFrame([x for x in ok if x], columns=["a", "b"]).astype("int64")


def _checked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) that link. The set of a is sent once, and that of b to it for each pair."""
    eight = F.lit(24)
    own = pairs.select(F.col("a").alias("node")).distinct()
    left = common.join_texts(sets, common.written(own, "asking"), ["node"], eight).select(F.col("node").alias("a"), F.col("node").alias("b"), "elements")
    right = common.join_texts(sets, pairs.select(F.col("b").alias("node"), "a"), ["node"], eight).select("a", F.col("node").alias("b"), "elements")
    n = common.partitions(sets.sparkSession)
    first = (F.col("a") != F.col("b")).cast("int")
    dealt = left.union(right).repartition(n, "a").sortWithinPartitions("a", first)
    return dealt.mapInPandas(common.releasing(_verified, "elements"), "a long, b long")


def _solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("node").sort_values("node")
    up = solve([_bytes(x) for x in pdf["elements"]], pdf["component"].to_numpy())
    node = pdf["node"].to_numpy()
    other = node[up]
    return pd.DataFrame({"a": node[other != node], "b": other[other != node]})


def compare(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all links between two lists of sets."""
    size = np.array([len(s) for s in right])
    start = np.cumsum(size) - size
    every, codes = np.unique(np.concatenate(right), return_inverse=True)
    mark = np.zeros(len(every) + 1, bool)
    a, b = [], []
    for i, s in enumerate(left):
        at = np.minimum(np.searchsorted(every, s), len(every) - 1)
        at = at[every[at] == s]
        mark[at] = True
        shared = np.add.reduceat(mark[codes], start)
        mark[at] = False
        hit = np.flatnonzero(links(shared, len(s), size))
        a.append(np.full(len(hit), i))
        b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def _sides(pdf: pd.DataFrame) -> pd.DataFrame:
    """A pair of groups or blocks: links of each set of side 0 with each of side 1, as a forest."""
    left, right = (pdf[pdf["side"] == k].drop_duplicates("node") for k in (0, 1))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    i, j = compare([_bytes(x) for x in left["elements"]], [_bytes(x) for x in right["elements"]])
    x, y = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
    node, root = common.roots(x[x != y], y[x != y])
    return pd.DataFrame({"a": node[node != root], "b": root[node != root]})


def _solve_blocks(sets: DataFrame) -> DataFrame:
    """Links (a, b) of overlapping lists whose sets don't fit one task: sets has list, node, component, elements, blocks.

    The sets outside the list's largest component meet all of its sets, block by block; within the
    largest component nothing is left to find. Blocks hold TASK_BYTES, give or take the hash.
    """
    sized = sets.groupBy("list", "component").agg(F.count("*").alias("n"))
    top = common.written(sized.groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("top")), "tops")
    at = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    every = sets.join(top, "list").withColumn("block", at)
    asking = every.where("component <> top").select("list", "node", "elements", F.lit(0).alias("side"), F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = every.select("list", "node", "elements", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of"), "block")
    return asking.select(*asked.columns).union(asked).groupBy("list", "of", "block").applyInPandas(common.releasing_groups(_sides, "elements"), "a long, b long")


def _filter_bits(nodes: DataFrame, n: int) -> np.ndarray:
    """One bit for each node's low bits, packed: 16 bits a node up to FILTER_BITS (32 MB)."""
    size = 1 << 16
    while size < 16 * n and size < FILTER_BITS:
        size *= 2

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[pdf["at"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = F.col("node").bitwiseAND(F.lit(size - 1))
    parts = nodes.select(at.alias("at")).distinct().withColumn("block", F.shiftright("at", 16).cast("int")).groupBy("block").applyInPandas(merge, "block int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for block, raw in parts.toLocalIterator():
        out[block * 8192 : (block + 1) * 8192] = np.frombuffer(raw, np.uint8)
    return out


def _members_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, components): members has doc_id, text_hash, size, node of each row; components has node, component of linked nodes."""
    docs = common.in_small_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", common.text_hash())
    texts = rows.where("doc_id is not null and text <> ''").select("text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = MIN_CELLS
    while cells < chars // 48 and cells < MAX_CELLS:  # some 8 elements a cell
        cells *= 2
    table = common.written(rows.mapInPandas(common.releasing(_members(cells)), "kind int, doc_id string, text_hash long, size long, node long, data binary"), "members")
    members = table.where("kind = 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "size", "node")
    sketch = np.zeros((2, cells), np.uint8)
    for r, block, raw in table.where("kind = 1").select("size", "node", "data").groupBy("size", "node").applyInPandas(common.releasing_groups(_merge_counts, "data", 200_000), "r long, block long, data binary").toLocalIterator():
        sketch[r, block * len(raw) : (block + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    shared = spark.sparkContext.broadcast(sketch)
    sizes = [(r[0], r[1]) for r in members.where("size between 2 and 4096").groupBy("size").count().collect()]
    boundary = choose_boundary(sizes)

    posted = texts.mapInPandas(common.releasing(_postings(shared, boundary)), "kind byte, sig long, class int, node long, group long")
    # A list has a line for each chunk, size class and linked group. Members and links ride along.
    ordered = posted.repartition(common.partitions(spark), "sig").sortWithinPartitions("kind", "sig", "class")

    table = common.written(ordered.mapInPandas(common.releasing(_pairs(SHORT), None), "kind byte, a long, b long, ga long, gb long"), "pairs")
    # One pair can come from many lists.
    pairs = common.written(table.where("kind = 0").select("a", "b", "ga", "gb").distinct(), "distinct-pairs")
    local = table.where("kind = 3").select("a", "b")
    groups = table.where("kind = 2").select(F.col("b").alias("group"), F.col("a").alias("node"))
    long_rows = table.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"), F.col("ga").alias("group"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, elements) of the wanted nodes, from the texts; a filter lets few others through."""
        nodes = common.written(nodes.distinct(), "wanted")
        bits = spark.sparkContext.broadcast(_filter_bits(nodes, nodes.count()))
        got = texts.mapInPandas(common.releasing(_sets(bits)), "node long, elements binary")
        return common.written(got.dropDuplicates(["node"]), "sets")

    both = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = sets_of(both.union(groups.select("node")).union(long_rows.select("node")))
    checked = _checked(sets, common.written(pairs.select("a", "b").distinct(), "to-check"))
    links_ = common.written(checked.union(local), "links")
    linked = common.components(links_)

    # What is still open.
    named = linked.select(F.col("node").alias("n"), "component")
    part = lambda c: F.coalesce(c, F.col("node"))
    open_pairs = (
        pairs.where("ga <> 0 or gb <> 0")
        .join(named.toDF("a", "ca"), "a", "left")
        .join(named.toDF("b", "cb"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select(F.when(F.col("ga") != 0, F.col("ga")).otherwise(F.col("a")).alias("x"), F.when(F.col("gb") != 0, F.col("gb")).otherwise(F.col("b")).alias("y"), (F.col("ga") != 0).alias("gx"), (F.col("gb") != 0).alias("gy"))
        .distinct()
    )
    open_pairs = common.written(open_pairs, "open-pairs")
    more = []
    if not open_pairs.isEmpty():
        sides = open_pairs.select("x", "y", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("key"), F.col("gx").alias("g")), F.struct(F.lit(1).alias("side"), F.col("y").alias("key"), F.col("gy").alias("g")))).alias("s")).select("x", "y", "s.*")
        expanded = sides.where("g").join(groups.withColumnRenamed("group", "key"), "key").select("x", "y", "side", "node").union(sides.where("not g").select("x", "y", "side", F.col("key").alias("node")))
        expanded = common.written(expanded.distinct(), "open-members")
        more.append(common.join_texts(sets, expanded, ["node"], F.lit(32)).groupBy("x", "y").applyInPandas(common.releasing_groups(_sides, "elements"), "a long, b long"))
    placed = long_rows.join(named.toDF("node", "c"), "node", "left").withColumn("c", part(F.col("c")))
    several = placed.groupBy("sig").agg((F.min("c") != F.max("c")).alias("open"), F.min("node").alias("first")).where("open")
    rows_open = common.written(placed.join(several.select("sig", "first"), "sig").select("first", "node", "group"), "open-lists")
    if not rows_open.isEmpty():
        # Overlapping lists are one; their posted sets stand for their groups.
        whole = rows_open.where("group <> 0").select("node", "group").distinct().join(groups.withColumnRenamed("node", "b"), "group").select(F.col("node").alias("a"), "b")
        joined = rows_open.select(F.col("node").alias("a"), F.col("first").alias("b")).union(whole)
        lists_ = common.components(joined).select("node", F.col("component").alias("list"))
        held = common.join_texts(sets, common.written(lists_, "lists"), ["node"], F.lit(16)).join(named.toDF("node", "c"), "node", "left").withColumn("component", part(F.col("c"))).drop("c")
        held = common.written(held, "open-sets")
        weight = held.groupBy("list").agg(F.ceil(F.sum(F.length("elements")) / TASK_BYTES).cast("int").alias("blocks"), F.countDistinct("component").alias("parts")).where("parts > 1").drop("parts")
        held = held.join(common.written(weight, "weights"), "list").select("list", "node", "component", "elements", "blocks")
        more.append(held.where("blocks = 1").groupBy("list").applyInPandas(common.releasing_groups(_solve_group, "elements"), "a long, b long"))
        if not held.where("blocks > 1").isEmpty():
            more.append(_solve_blocks(held.where("blocks > 1")))
    if more:
        every = links_
        for df in more:
            every = every.union(df)
        linked = common.components(every)
    return members, linked


def _memberships(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    members, linked = _members_of(docs)
    least = members.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = common.written(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(ids, "component").select(F.col("node").alias("_node"), "component_id")
    return members.join(of_node, (F.col("node") == F.col("_node")) & (F.col("size") > 0) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", "text_hash", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def similar(docs: DataFrame) -> DataFrame:
    """Membership of every document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null and empty texts have no shingles and are components of their own. Rows with a null id
    link with nothing and have a null component. Rows of one id with different texts each count.
    Other columns are ignored. An empty table gives an empty table.
    """
    return _memberships(docs).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows whose document has the smallest id of its component; rows without an id stay. All columns are kept.

    Of an id with several texts, each text goes or stays by its own component.
    """
    return common.without_rows(docs, _memberships(docs).where("component_id <> doc_id").select("doc_id", "text_hash"))
