"""Embedding near-dedup with hierarchical navigable small-world graphs.

Equal vectors collapse first (by 128 bits of their values). The distinct ones are dealt over shards
of bounded bytes, each shard gets a graph, and every vector queries every shard in blocks. Beams
widen until a recall audit passes: a sample of the block's queries against brute force, and
queries planted beside known vectors, so that a block whose sample has no links is measured too.
A query whose beam fills up with links goes on to a wider one, and beyond MAX_BEAM its shard is
scanned exactly, so no number of neighbours is capped. Cosines are verified in double precision on
the given values. Links that a beam found count for both ends, whichever end found them. Tasks
work through their links in pieces of bounded size and return counts, the few links of each beam
and a spanning forest, never all pairs of a group; components are the forests' union.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common

COSINE = 0.95
#: Shards and blocks of queries at least, bytes of a shard's or block's vectors at most. A vector is sent
#: once to each shard and a graph once to each block, so both are as large as a task can hold.
MIN_SHARDS, MIN_BLOCKS, SHARD_BYTES = 6, 4, 32_000_000
#: Links of a node and layer, beam of the build, first and last beam of a search.
M, BUILD_BEAM, BEAM, MAX_BEAM = 12, 40, 32, 256
#: Each AUDIT-th query of a block is audited, and PLANTED queries beside vectors of the shard; mean recall of
#: both must reach AUDIT_RECALL (own matches and queries that go on to the exact scan do not count).
AUDIT, PLANTED, AUDIT_RECALL = 20, 256, 0.995
#: Vectors of a shard up to which brute force is cheaper than a walk.
FEW = 128
#: Pairs that a task holds at once, and numbers in double precision.
PAIRS = 2_000_000


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, m: int = M, beam: int = BUILD_BEAM, seed: int = 3):
        self.x, self.m = x, m
        self._flags = np.zeros(0, bool)
        self.layers = layers if layers is not None else self._build(beam, np.random.default_rng(seed))

    def _build(self, beam: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        """Layers from the lowest: (members, neighbours as places in x, -1 where none)."""
        n = len(self.x)
        level = np.floor(-np.log(1 - rng.random(n)) / math.log(self.m)).astype(int)
        if n:
            level = np.minimum(level, max(0, int(math.log(max(n, 2)) / math.log(self.m))))
        order = rng.permutation(n)
        order = order[np.argsort(-level[order], kind="stable")]  # entries of a layer come before the places that they lead to
        self.layers = []
        out = []
        for at in range(int(level.max()) if n else 0, -1, -1):
            members = order[level[order] >= at]
            table = self._layer(members, 2 * self.m if at == 0 else self.m, beam)
            self.layers.insert(0, (members, table))
            out.insert(0, (members, table))
        return out

    def _layer(self, members: np.ndarray, width: int, beam: int) -> np.ndarray:
        table = np.full((len(self.x), width), -1, np.int32)
        done = min(len(members), 4 * width)
        first = members[:done]
        self._link(table, first, *self._dense(first, first, width))
        placed = np.zeros(len(self.x) + 1, bool)
        placed[first] = True
        while done < len(members):
            batch = members[done : done + min(done, 512)]
            at = self._descend(self.x[batch], members[:1])
            at = np.where(placed[at], at, -1)  # a walk from places without links would end there
            at = np.concatenate([at, np.where((at == members[0]).any(1), -1, members[0])[:, None]], 1)
            ids, sims = self._beam(table, self.x[batch], at, beam)
            own, own_sims = self._dense(batch, batch, self.m)
            ids, sims = np.concatenate([ids, own], 1), np.concatenate([sims, own_sims], 1)
            self._link(table, batch, ids, sims)
            placed[batch] = True
            done += len(batch)
        return table

    def _dense(self, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of b for each of a, without itself, by brute force."""
        s = self.x[a] @ self.x[b].T
        s[a[:, None] == b[None, :]] = -2
        k = min(k, len(b))
        top = np.argpartition(-s, k - 1, 1)[:, :k]
        sims = np.take_along_axis(s, top, 1)
        return np.where(sims > -2, b[top], -1), sims

    def _spread(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """For each row of different candidates by falling similarity: those nearer to the node than to one chosen before; then the nearest others."""
        ids, sims = ids[:, : 3 * width], sims[:, : 3 * width]
        out = np.full((len(ids), width), -1, np.int32)
        step = max(1, PAIRS // (ids.shape[1] * self.x.shape[1] + 1))
        for i in range(0, len(ids), step):
            some, near = ids[i : i + step], sims[i : i + step]
            there = self.x[some]
            among = there @ there.transpose(0, 2, 1)
            chosen = np.zeros(some.shape, bool)
            nearest = np.full(some.shape, -2, np.float32)
            count = np.zeros(len(some), int)
            for j in range(some.shape[1]):
                rows = np.flatnonzero((nearest[:, j] <= near[:, j]) & (some[:, j] >= 0) & (count < width))
                chosen[rows, j] = True
                count[rows] += 1
                nearest[rows] = np.maximum(nearest[rows], among[rows, j])
            first = np.argsort(np.where(some < 0, 2, 1 - chosen), 1, kind="stable")[:, :width]
            out[i : i + step, : first.shape[1]] = np.take_along_axis(some, first, 1)
        return out

    def _link(self, table: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links new nodes with some of their candidates (different ones in a row), and these back with them."""
        width = table.shape[1]
        at = np.argsort(np.where(ids < 0, 4, -sims), 1, kind="stable")
        got = self._spread(np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1), self.m if width > self.m else max(2, width // 2))
        table[nodes] = -1
        table[nodes, : got.shape[1]] = got
        ends = np.unique(got[got >= 0]).astype(np.int64)  # products of places exceed 32 bits
        old = table[ends]
        pairs = np.concatenate([(ends[:, None] * len(self.x) + old)[old >= 0], (got.astype(np.int64) * len(self.x) + nodes[:, None])[got >= 0]])
        a, b = np.divmod(np.unique(pairs), len(self.x))
        near = np.empty(len(a), np.float32)
        step = max(1, PAIRS // self.x.shape[1])
        for i in range(0, len(a), step):
            near[i : i + step] = np.einsum("kd,kd->k", self.x[a[i : i + step]], self.x[b[i : i + step]])
        at = np.lexsort((-near, a))
        a, b, near = a[at], b[at], near[at]
        row = np.searchsorted(ends, a)
        place = np.arange(len(a)) - np.searchsorted(a, a)
        fits = place < 3 * width
        held = int(place[fits].max(initial=0)) + 1
        every, by = np.full((len(ends), held), -1, np.int64), np.full((len(ends), held), -3, np.float32)
        every[row[fits], place[fits]], by[row[fits], place[fits]] = b[fits], near[fits]
        crowded = (every >= 0).sum(1) > width
        kept = np.full((len(ends), width), -1, np.int32)
        kept[:, : min(held, width)] = every[:, :width]
        kept[crowded] = self._spread(every[crowded], by[crowded], width)
        table[ends] = kept

    def _descend(self, q: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Entry places for the lowest layer: a narrow search through the layers above it."""
        at = np.repeat(start[:1][None, :] if not self.layers else self.layers[-1][0][:1][None, :], len(q), 0)
        for members, table in self.layers[::-1]:
            at = self._beam(table, q, at, 4)[0][:, :2]
        return at

    def _beam(self, table: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries side by side: (places, similarities) of the best ``width``, -1 where fewer.

        Places in a row of ``start`` differ, as those in a row of ``table`` do.
        """
        n_q, span = len(q), len(self.x) + 1
        step = max(128, PAIRS // span)
        if n_q > step:  # flags that a processor's cache can hold, whatever the size of the graph
            parts = [self._beam(table, q[i : i + step], start[i : i + step], width) for i in range(0, n_q, step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = np.full((n_q, width), -1, np.int64)
        sims = np.full((n_q, width), -3.0, np.float32)
        open_ = np.zeros((n_q, width), bool)
        seen = self._unseen(n_q * span)
        seen[span - 1 :: span] = True  # where -1 points, from the row after (the last one's for the first row)
        marks = []
        fresh, live = start, np.arange(n_q)
        while len(live):
            spots = (live[:, None] * span + fresh).ravel()
            new = np.flatnonzero(~seen[spots])
            spots, row = spots[new], new // fresh.shape[1]
            seen[spots] = True
            marks.append(spots)
            s = np.full(fresh.size, -3.0, np.float32)
            s[new] = np.einsum("kd,kd->k", self.x.take(fresh.ravel()[new], 0), q.take(live[row], 0))
            s = s.reshape(fresh.shape)
            better = np.flatnonzero(s.max(1) > sims[live].min(1))  # rows whose beam changes
            at = live[better]
            s, fresh = s[better], fresh[better]
            all_sims = np.concatenate([sims[at], s], 1)
            top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            top += np.arange(len(at))[:, None] * all_sims.shape[1]
            sims[at] = all_sims.take(top)
            ids[at] = np.concatenate([ids[at], np.where(s > -3, fresh, -1)], 1).take(top)
            open_[at] = np.concatenate([open_[at], s > -3], 1).take(top)
            far = np.where(open_[live], sims[live], -4)
            best = far.argmax(1)
            going = far[np.arange(len(live)), best] > -4
            live, best = live[going], best[going]
            open_[live, best] = False
            fresh = table[ids[live, best]]
        for spots in marks:
            seen[spots] = False
        seen[span - 1 :: span] = False
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _unseen(self, size: int) -> np.ndarray:
        """``size`` flags, all False; a search clears what it sets, so that it costs what it visits and not the whole graph."""
        if len(self._flags) < size:
            self._flags = np.zeros(size, bool)
        return self._flags[:size]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.x):
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
        at = np.repeat(self.layers[-1][0][:1][None, :], len(q), 0)
        for members, table in self.layers[:0:-1]:
            at = self._beam(table, q, at, 4)[0][:, :2]
        return self._beam(self.layers[0][1], q, at, width)


# ------------------------------------------------------------------------------- passes


def unit(raw: np.ndarray) -> np.ndarray:
    out = np.empty(raw.shape, np.float32)
    step = max(1, PAIRS // max(1, raw.shape[1]))
    for i in range(0, len(raw), step):
        x = raw[i : i + step].astype(np.float64)
        out[i : i + step] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _vectors(width: str):
    """embeddings -> vec_id, dim (0: links with nothing), k1 and k2 (128 bits of the values), raw (bytes of ``width``)."""

    def rows_of(pdf: pd.DataFrame):
        for vec_id, e in zip(pdf["vec_id"].tolist(), pdf["embedding"].tolist()):
            ok = e is not None and len(e) > 0
            if ok:
                v = np.array([np.nan if c is None else c for c in e], np.float64) + 0.0
                ok = bool(np.isfinite(v).all()) and bool(v.any()) and vec_id is not None
            if ok:
                if width == "f8":
                    v = v / np.abs(v).max()  # no overflow in the norm; a cosine keeps its value
                raw = v.astype(width).tobytes()
                yield vec_id, len(v), *np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist(), raw
            else:
                yield vec_id, 0, 0, 0, None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(list(rows_of(pdf)), columns=["vec_id", "dim", "k1", "k2", "raw"])

    return run


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [zstandard.ZstdCompressor(level=1).compress(a.tobytes()) for a in arrays]


def _build(width: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One shard -> one row with its vectors and graph."""
        pdf = pdf.sort_values("node")
        dim = int(pdf["dim"].iloc[0])
        raw = np.frombuffer(b"".join(pdf["raw"]), width).reshape(-1, dim)
        graph = Graph(unit(raw))
        layers = [x for members, table in graph.layers for x in (members.astype(np.int32), table[members])]
        return pd.DataFrame(
            {
                "dim": [dim],
                "shard": [int(pdf["shard"].iloc[0])],
                "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
                "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
                "raws": [raw.tobytes()],
                "layers": [_pack(*layers)],
            }
        )

    return run


def _open(row, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    nodes, copies = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.copies, np.int64)
    raw = np.frombuffer(row.raws, width).reshape(len(nodes), -1)
    layers, parts = [], [zstandard.ZstdDecompressor().decompress(x) for x in row.layers]
    for k in range(0, len(parts), 2):
        members = np.frombuffer(parts[k], np.int32)
        rows = np.frombuffer(parts[k + 1], np.int32).reshape(len(members), -1)
        table = np.full((len(nodes), rows.shape[1]), -1, np.int32)
        table[members] = rows
        layers.append((members, table))
    return nodes, copies, raw, Graph(unit(raw), layers)


def planted(graph: Graph, cosine: float, n: int = PLANTED) -> tuple[np.ndarray, np.ndarray]:
    """(queries, places): unit vectors halfway between the threshold and the vectors that they were made from."""
    rng = np.random.default_rng(7)
    at = np.unique(np.linspace(0, len(graph.x) - 1, n).astype(int))
    x = graph.x[at].astype(np.float64)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(off, axis=1, keepdims=True)
    c = (1 + cosine) / 2
    return np.where(norm > 1e-9, c * x + np.sqrt(1 - c * c) * off / np.maximum(norm, 1e-9), x).astype(np.float32), at


def find_links(graph: Graph, raw: np.ndarray, queries: np.ndarray, cosine: float, beam: int = BEAM):
    """Yields (query, place, complete) in pieces: links verified in double precision, each once.

    Complete pieces hold all links of their queries (exactly scanned); ``complete`` is their array
    of queries, else None. The beam widens until the audit passes.
    """
    if not len(raw) or not len(queries):
        return
    q = unit(queries)
    near = cosine - 1e-4

    def close(rows: np.ndarray):
        """(query, place) by brute force, PAIRS at most compared at once."""
        step = max(1, PAIRS // len(raw))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            r, c = np.nonzero(q[part] @ graph.x.T >= near)
            yield part, part[r], c

    def searched(x: np.ndarray, width: int):
        """For some queries at a time: their places, what is near, and which beams are full of links."""
        for i in range(0, len(x), 512):
            ids, sims = graph.search(x[i : i + 512], width)
            hit = sims >= near
            yield i, ids, hit, hit.all(1)

    def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.zeros(len(a), bool)
        step = max(1, PAIRS // raw.shape[1])
        for i in range(0, len(a), step):
            x, y = queries[a[i : i + step]].astype(np.float64), raw[b[i : i + step]].astype(np.float64)
            ok[i : i + step] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
        return a[ok], b[ok]

    audit = np.arange(len(q))[::AUDIT]
    sown, source = planted(graph, cosine)

    def passes(width: int) -> bool:
        found = [((ids == source[i : i + 512, None]) & hit).any(1) | full for i, ids, hit, full in searched(sown, width)]
        if np.concatenate(found).mean() < AUDIT_RECALL:
            return False
        shares = []
        for i, ids, hit, full in searched(q[audit], width):
            rows = audit[i : i + 512][~full]
            r, c = np.nonzero(hit[~full])
            have = np.sort(rows[r] * len(raw) + ids[~full][r, c])
            for _, a, b in close(rows):
                own = queries[a, 0] == raw[b, 0]
                own[own] = (queries[a[own]] == raw[b[own]]).all(1)
                a, b = a[~own], b[~own]
                if len(a):
                    _, at = np.unique(a, return_inverse=True)
                    shares.append(np.bincount(at, np.isin(a * len(raw) + b, have)) / np.bincount(at))
        return not shares or np.concatenate(shares).mean() >= AUDIT_RECALL

    if len(raw) <= FEW:
        beam = MAX_BEAM + 1
    while beam <= MAX_BEAM and beam < len(raw) and not passes(beam):
        beam *= 2
    rows = np.arange(len(q))
    while len(rows) and beam <= MAX_BEAM and beam < len(raw):
        rest = []
        for i, ids, hit, full in searched(q[rows], beam):
            part = rows[i : i + 512]
            r, c = np.nonzero(hit & ~full[:, None])
            yield *verified(part[r], ids[r, c]), None
            rest.append(part[full])  # more links may lie beyond the beam
        rows = np.concatenate(rest)
        beam *= 4
    for part, a, b in close(rows):
        yield *verified(a, b), part


_FOUND = "kind int, a long, b long, c long, d long"


def _ask(cosine: float, width: str):
    def run(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """A block of queries against one shard.

        Kind 0: a query (a) that was scanned exactly, its links' copies (b) and the shard (c). Kind 1:
        a forest of all links. Kind 2: a link (a, b) that a beam found, with both ends' copies (c, d).
        """
        if not len(shards) or not len(queries):
            return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("kind", "a", "b", "c", "d")}).astype({"kind": "int32"})
        shard = int(shards["shard"].iloc[0])
        nodes, copies, raw, graph = _open(next(shards.itertuples(index=False)), width)
        q_nodes, q_copies = queries["node"].to_numpy(np.int64), queries["copies"].to_numpy(np.int64)
        q_raw = np.frombuffer(b"".join(queries["raw"]), width).reshape(len(queries), -1)
        out, x, y = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def row(kind: int, a, b, c, d) -> None:
            out.append(pd.DataFrame({"kind": np.int32(kind), "a": a, "b": b, "c": c, "d": d}))

        for a, b, complete in find_links(graph, raw, q_raw, cosine):
            other = q_nodes[a] != nodes[b]
            a, b = a[other], b[other]
            x.append(q_nodes[a])
            y.append(nodes[b])
            if sum(map(len, x)) > PAIRS:
                n, root = common.roots(np.concatenate(x), np.concatenate(y))
                x, y = [n[n != root]], [root[n != root]]
            if complete is not None:
                row(0, q_nodes[complete], np.bincount(a, copies[b], len(q_nodes)).astype(np.int64)[complete], shard, 0)
            elif len(a):
                row(2, q_nodes[a], nodes[b], q_copies[a], copies[b])
        n, root = common.roots(np.concatenate(x), np.concatenate(y))
        row(1, n[n != root], root[n != root], 0, 0)
        return pd.concat(out)

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, min_shards: int = MIN_SHARDS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
    and are components of their own; vectors of different lengths never link. Repeated ids are
    vectors of their own. Rows with a null id link with nothing. Other columns are ignored.
    """
    single = getattr(embeddings.schema["embedding"].dataType, "elementType", None) == FloatType()
    width = "f4" if single else "f8"  # as the values are given; cosines are taken in double precision
    rows = embeddings.select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    table = common.written(rows.mapInPandas(_vectors(width), "vec_id string, dim int, k1 long, k2 long, raw binary").withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    distinct = table.where("dim > 0").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    distinct = common.written(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    size = distinct.agg(F.coalesce(F.sum(F.col("dim").cast("long") * (4 if single else 8)), F.lit(0))).first()[0]
    shards, blocks = (int(max(least, -(-size // SHARD_BYTES))) for least in (min_shards, MIN_BLOCKS))
    shard_of = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(shards)).cast("int")
    sharded = distinct.withColumn("shard", shard_of("node"))
    graphs = common.written(
        sharded.groupBy("dim", "shard").applyInPandas(_build(width), "dim int, shard int, nodes binary, copies binary, raws binary, layers array<binary>"), "graphs"
    )
    asked = distinct.select("node", "copies", "dim", "raw", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "shard", "block"]
    found = common.written(dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_ask(cosine, width), _FOUND), "links")
    whole = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("others"), F.col("c").cast("int").alias("shard"))
    beams = found.where("kind = 2")
    # The other end of a link that a beam found has it too, unless it was scanned exactly against that shard.
    back = beams.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("c").alias("copies")).withColumn("shard", shard_of("other")).join(whole.select("node", "shard"), ["node", "shard"], "left_anti")
    each = beams.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("d").alias("copies")).union(back.select("node", "other", "copies")).distinct()
    counts = whole.select("node", "others").union(each.select("node", F.col("copies").alias("others"))).groupBy("node").agg(F.sum("others").alias("others"))
    comps = common.components(found.where("kind = 1").select("a", "b"))
    named = (
        distinct.select("k1", "k2", "node", "vec_id", "copies")
        .join(counts, "node", "left")
        .join(comps, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = common.written(named, "named")
    ids = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    full = named.join(ids, "component").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = table.where("dim > 0").select("vec_id", "k1", "k2").join(full, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = table.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", F.col("vec_id") == F.col("component_id"))
