import tracemalloc

import numpy as np

from sawmill.llm import neardup


def brute(rows, cosine=0.95):
    ok = []
    for i, e in rows:
        v = None if e is None else np.array([np.nan if c is None else c for c in e], float)
        ok.append(v if i is not None and v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(n):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((-1 if i is None else i, links[k], -1 if i is None else least[root(k)]) for k, (i, _) in enumerate(rows))


def run(df, **kw):
    rows = neardup.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in rows)


def vectors(seed, n=700, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [base[i] for i in range(n)]
    for i in range(60):  # chains
        rows.append(rows[int(rng.integers(len(rows)))] + 0.22 * rng.normal(size=dim))
    rows += [base[3]] * 90 + [base[5] + 0.02 * rng.normal(size=dim) for _ in range(400)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def test_like_brute_force(spark):
    rows = vectors(1)
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.99 * true
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_strange_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e200, 1e190])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, key int")
    want = brute(rows[:-1]) + []
    got = run(df)
    by = {(g[0], g[1], g[2]) for g in got}
    # 7, 8, 8 and 11 point the same way; norms of 11 overflow in a plain product
    assert {(7, 3, 7), (8, 3, 7), (11, 3, 7), (9, 0, 9), (10, 0, 10), (1, 0, 1), (3, 0, 3), (-1, 0, -1)} <= by
    assert len(got) == len(rows) and {w[0] for w in want} | {11} == {g[0] for g in got}


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = neardup.unit(rng.normal(size=(2500, 24)))
    graph = neardup.Graph(x)
    ids, _ = graph.search(x[:200], 64)
    truth = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    hit = np.mean([len(set(t) & set(i)) / 10 for t, i in zip(truth, ids)])
    assert hit >= 0.95
    assert len(graph.layers) > 1 and all((t[m] < len(x)).all() for m, t in graph.layers)


def test_a_large_group_does_not_hide_missed_pairs_from_the_audit():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(501, 32))
    rows = [base[500] + 0.01 * rng.normal(size=32) for _ in range(500)] + [base[i % 500] + 0.01 * rng.normal(size=32) for i in range(1000)]
    raw = np.array(rows)[rng.permutation(1500)]

    class Narrow:
        """Finds everything, but nothing of small groups with a narrow beam."""

        x = neardup.unit(raw)

        def search(self, q, width):
            sims = q @ self.x.T
            ids = np.argsort(-sims, 1)[:, :width]
            sims = np.take_along_axis(sims, ids, 1)
            small = (sims >= 0.95).sum(1) < width
            if width < 64:
                sims[small, 1:] = 0
            return ids, sims

    a, b = found(Narrow(), raw, raw)
    x = raw / np.linalg.norm(raw, axis=1)[:, None]
    true = x @ x.T >= 0.95
    assert len(a) == true.sum() and true[a, b].all()


def found(graph, raw, queries):
    parts = list(neardup.find_links(graph, raw, queries, 0.95))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def test_a_block_whose_sample_has_no_links_is_measured(monkeypatch):
    """Queries planted beside known vectors show that a graph finds nothing, where audited queries have no links."""
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(1200, 16))
    queries = rng.normal(size=(400, 16))
    queries[7] = raw[3] * 2  # no audited place

    class Blind:
        x = neardup.unit(raw)

        def search(self, q, width):
            return np.zeros((len(q), width), np.int64), np.zeros((len(q), width), np.float32)

    a, b = found(Blind(), raw, queries)
    assert (a.tolist(), b.tolist()) == ([7], [3])


def test_few_pairs_are_held(monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 5_000)
    rng = np.random.default_rng(6)
    raw = np.concatenate([rng.normal(size=8) + 0.01 * rng.normal(size=(900, 8)), rng.normal(size=(300, 8))])
    pieces = list(neardup.find_links(neardup.Graph(neardup.unit(raw)), raw, raw, 0.95))
    assert max(len(p[0]) for p in pieces) <= max(5_000, 512 * neardup.MAX_BEAM)
    assert sum(len(p[0]) for p in pieces) >= 900 * 900


def test_links_count_for_both_ends(spark, monkeypatch):
    """Beams that see a link from one end only: here a vector finds those of larger ids alone."""
    plain = neardup.find_links

    def one_way(graph, raw, queries, cosine, **kw):
        for a, b, complete in plain(graph, raw, queries, cosine, **kw):
            ok = queries[a, 0] <= raw[b, 0] if complete is None else np.ones(len(a), bool)
            yield a[ok], b[ok], complete

    monkeypatch.setattr(neardup, "find_links", one_way)
    rows = vectors(3, n=500)
    want = {w[0]: w[1] for w in brute(rows)}
    got = {g[0]: g[1] for g in run(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), min_shards=2)}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want) and all(got[i] <= want[i] for i in want)


def test_a_walk_compares_a_place_once():
    class Counted(np.ndarray):
        """Vectors that note which places are read."""

        def take(self, at, *args):
            got.extend(np.ravel(at).tolist())
            return np.asarray(self).take(at, *args)

        def __getitem__(self, at):
            got.extend(np.ravel(at).tolist())
            return np.asarray(self)[at]

    got = []
    x = neardup.unit(np.random.default_rng(8).normal(size=(900, 16)))
    graph = neardup.Graph(x)
    lowest = neardup.Graph(x.view(Counted), graph.layers[:1])
    ids, _ = lowest.search(x[5:6], 32)
    assert ids[0, 0] == 5 and len(got) > 32 and len(got) == len(set(got))


def test_a_walk_costs_what_it_visits():
    """Memory of a search does not follow the size of the graph: a ring of many places, of which few are visited."""
    n = 200_000
    at = np.arange(n)
    x = neardup.unit(np.random.default_rng(9).normal(size=(n, 4)))
    graph = neardup.Graph(x, [(at, np.stack([(at + 1) % n, (at - 1) % n], 1).astype(np.int32))])
    before = graph.search(x[:64], 4)
    tracemalloc.start()
    after = graph.search(x[:64], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # 64 flags a place would be 12.8 MB
    assert (before[0] == after[0]).all()


def test_spread_and_links():
    rng = np.random.default_rng(10)
    x = neardup.unit(rng.normal(size=(400, 8)))
    graph = neardup.Graph(x)
    ids = np.array([rng.permutation(400)[:30] for _ in range(50)])
    sims = (x[ids] * x[350:, None]).sum(2)
    at = np.argsort(-sims, 1)
    ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    ids[:10, 5:] = -1  # rows with few candidates
    for row, near, got in zip(ids, sims, graph._spread(ids, sims, 8)):
        row = row[row >= 0][:24]
        want = []
        for i, s in zip(row, near):
            if len(want) < 8 and all(x[i] @ x[w] <= s for w in want):
                want.append(i)
        want += [i for i in row if i not in want][: 8 - len(want)]
        assert got[got >= 0].tolist() == want
    for members, table in graph.layers:
        for i in members:
            links = table[i][table[i] >= 0].tolist()
            assert len(links) == len(set(links)) and i not in links and set(links) <= set(members.tolist())
