"""Strategies agree with each other and with a plain search, on small graphs of every kind."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from critpath.functions.weights import edges_long, edges_wide
from critpath.operators import boundary, paths, prep, search
from critpath.operators.kernels import FAR, Adjacency
from critpath.sources.store import Store

GRAPHS = {
    "triangle": [(0, 1, [1, 9]), (1, 2, [1, 9]), (0, 2, [5, 1])],
    "tie": [(0, 1, [1, 1]), (0, 2, [1, 1]), (1, 3, [1, 1]), (2, 3, [1, 1])],
    "null layer": [(0, 1, [3, None]), (1, 2, [4, 2])],
    "split": [(0, 1, [1, 1]), (2, 3, [1, 1])],
}


def random_graph(seed, n=40, m=90):
    rng = random.Random(seed)
    found = {}
    for _ in range(m):
        u, v = sorted(rng.sample(range(n), 2))
        found[u, v] = [rng.randint(1, 20), rng.choice([None, rng.randint(1, 9)])]
    return [(u, v, w) for (u, v), w in found.items()]


GRAPHS["random"] = random_graph(1)


def frame(spark, rows):
    return prep.mirror(spark.createDataFrame(rows, "u long, v long, weights array<int>"))


def plain(rows, s, c):
    near = {}
    for u, v, w in rows:
        if w[c] is not None:
            near.setdefault(u, []).append((v, w[c]))
            near.setdefault(v, []).append((u, w[c]))
    best, queue = {}, [(0, s)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for x, w in near.get(v, ()):
                heapq.heappush(queue, (d + w, x))
    return best


@pytest.mark.parametrize("strategy", list(search.STRATEGIES))
def test_strategies(spark, strategy):
    name = "random" if strategy in ("one_pass", "bidirectional") else "null layer"
    rows = GRAPHS[name]
    ids = sorted({x for u, v, _ in rows for x in (u, v)})
    od = [(i, ids[i % len(ids)], ids[(i * 7 + 3) % len(ids)]) for i in range(8)] + [(8, ids[0], ids[0]), (9, ids[0], 99_999)]
    got = search.mcsp(edges_long(frame(spark, rows)), spark.createDataFrame(od, "query_id long, s long, t long"), 2, strategy).collect()
    want = {(q, c): 0 if s == t else plain(rows, s, c).get(t) for q, s, t in od for c in (0, 1)}
    assert {(r.query_id, r.cri): r.cost for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["triangle", "tie", "split"])
def test_micro_graphs(spark, name):
    rows = GRAPHS[name]
    got = search.sssp(edges_long(frame(spark, rows)), 0, 2, strategy="kernel").collect()
    assert {(r.cri, r.v): r.d for r in got} == {(c, v): d for c in (0, 1) for v, d in plain(rows, 0, c).items()}


@pytest.mark.parametrize("both", [False, True])
def test_overlay_is_exact(spark, both):
    rows = GRAPHS["random"]
    edges = frame(spark, rows)
    long = edges_long(edges)
    ids = sorted({x for u, v, _ in rows for x in (u, v)})
    parts = spark.createDataFrame([(v, v % 4, v) for v in ids], "v long, pid int, pos long")
    found = boundary.boundary(edges, parts)
    short = boundary.shortcuts(long, parts, found, 2)
    od = [(i, ids[i], ids[-1 - i * 2]) for i in range(8)] + [(8, ids[0], ids[0])]
    got = boundary.overlay_search(long, parts, short, found, spark.createDataFrame(od, "query_id long, s long, t long"), 2, both=both, strategy="kernel").collect()
    assert {(r.query_id, r.cri): r.cost for r in got} == {(q, c): 0 if s == t else plain(rows, s, c).get(t) for q, s, t in od for c in (0, 1)}


def test_paths_take_the_smallest_predecessor(spark):
    edges = frame(spark, GRAPHS["tie"])
    long = edges_long(edges)
    walk = paths.paths(long, search.sssp(long, 0, 2), 0, spark.createDataFrame([(3,), (0,), (77,)], "t long"))
    assert sorted((r.cri, r.t, r.path) for r in paths.shown(walk).collect()) == [(0, 0, "1"), (0, 3, "1-->2-->4"), (1, 0, "1"), (1, 3, "1-->2-->4")]
    back = paths.paths(long, search.sssp(long, 3, 2), 3, spark.createDataFrame([(0,)], "t long"))
    assert back.count() == 6


def test_graphs_above_the_bound_take_the_loop(spark):
    rows = GRAPHS["random"]
    long = edges_long(frame(spark, rows)).cache()
    od = spark.createDataFrame([(i, i, (i * 7 + 3) % 30) for i in range(6)], "query_id long, s long, t long")
    want = sorted(map(tuple, search.kernel(long, od, 2).collect()), key=str)
    assert sorted(map(tuple, search.kernel(long, od, 2, limit=0).collect()), key=str) == want
    assert sorted(map(tuple, search.kernel_bidirectional(long, od, 2).collect()), key=str) == want
    start = search.seeds(od, 2).drop("side")
    key = lambda r: (r.query_id, r.cri, r.v, r.d)
    assert sorted(map(key, search.labels_kernel(long, start, limit=0).collect())) == sorted(map(key, search.labels_kernel(long, start).collect()))


def test_a_graph_on_disk(spark, tmp_path):
    rows = GRAPHS["random"]
    e = frame(spark, rows)
    store = Store(spark, str(tmp_path / "g"), 2)
    parts = store.table("partitions", lambda: e.select(F.col("src").alias("v")).distinct().select("v", (F.col("v") % 4).cast("int").alias("pid"), F.col("v").alias("pos")))
    store.edges(e, parts)
    ids = sorted({x for u, v, _ in rows for x in (u, v)})
    od = [(i, ids[i], ids[(i * 7 + 3) % len(ids)]) for i in range(5)] + [(8, ids[0], ids[0]), (9, ids[0], 99_999)]
    frame_ = spark.createDataFrame(od, "query_id long, s long, t long")
    want = {(q, c): 0 if s == t else plain(rows, s, c).get(t) for q, s, t in od for c in (0, 1)}
    for most in (search.MOST_PIDS, 0):
        assert {(r.query_id, r.cri): r.cost for r in search.stored(store, frame_, 2, most_pids=most).collect()} == want


def test_meeting_of_two_searches():
    for seed in range(5):
        rows = random_graph(seed, 30, 45)
        und = [(u, v, w[0]) for u, v, w in rows]
        src, dst, w = (np.array(c) for c in zip(*(und + [(v, u, w) for u, v, w in und])))
        near = Adjacency(src, dst, w)
        for s in range(0, len(near.ids), 4):
            best = plain(rows, int(near.ids[s]), 0)
            for t in range(len(near.ids)):
                assert near.meeting(s, t) == best.get(int(near.ids[t]), FAR)


def test_paths_from_both_ends(spark):
    rows = random_graph(3, 30, 60)
    long = edges_long(frame(spark, rows), 1).cache()
    labels = {s: plain(rows, s, 0) for s in (0, 5, 9, 17)}
    near = {(u, v): w[0] for u, v, w in rows} | {(v, u): w[0] for u, v, w in rows}
    make = lambda s: [(s, 0, v, d) for v, d in labels[s].items()]
    forward = spark.createDataFrame(make(0), "t long, cri int, v long, d long").drop("t")
    backward = spark.createDataFrame([x for s in (5, 9, 17) for x in make(s)], "t long, cri int, v long, d long")
    got = {}
    for r in paths.bidirectional_paths(long, forward, backward, 0).orderBy("t", "step").collect():
        got.setdefault(r.t, []).append(r.v)
    assert set(got) == {t for t in (5, 9, 17) if t in labels[0]}
    for t, p in got.items():
        assert p[0] == 0 and p[-1] == t and sum(near[a, b] for a, b in zip(p, p[1:])) == labels[0][t]


@pytest.mark.parametrize("strategy", ["one_pass", "multi_pass", "bidirectional", "bucketed"])
def test_wide_edges_in_memory_and_by_the_loop(spark, strategy, monkeypatch):
    rows = GRAPHS["random"] if strategy == "multi_pass" else GRAPHS["null layer"]
    wide = edges_wide(frame(spark, rows), 2).cache()
    ids = sorted({x for u, v, _ in rows for x in (u, v)})
    od = [(0, ids[0], ids[-1]), (1, ids[-1], ids[1]), (2, ids[1], ids[1]), (3, ids[0], 99_999)]
    want = {(q, c): 0 if s == t else plain(rows, s, c).get(t) for q, s, t in od for c in (0, 1)}
    pairs = spark.createDataFrame(od, "query_id long, s long, t long")
    run = search.STRATEGIES[strategy]
    assert {(r.query_id, r.cri): r.cost for r in run(wide, pairs, 2, limit=0).collect()} == want
    monkeypatch.setattr(search, "_relaxed", None)  # no round of the loop
    assert {(r.query_id, r.cri): r.cost for r in run(wide, pairs, 2).collect()} == want


@pytest.mark.parametrize("strategy", ["one_pass", "bucketed", "kernel"])
def test_absent_weights_are_no_edges_of_a_task(spark, strategy, monkeypatch):
    rows = [(i, i + 1, [i % 5 + 1 if k == i % 3 else None for k in range(3)]) for i in range(30)] + [(0, 30, [7, 7, 7])]
    monkeypatch.setattr(search, "_relaxed", None)  # no round of the loop
    pairs = spark.createDataFrame([(0, 0, 30), (1, 3, 4), (2, 4, 6)], "query_id long, s long, t long")
    want = {(q, c): plain(rows, s, c).get(t) for q, s, t in ((0, 0, 30), (1, 3, 4), (2, 4, 6)) for c in range(3)}
    found = search.STRATEGIES[strategy](edges_wide(frame(spark, rows), 3), pairs, 3, limit=30)  # 62 rows, 22 edges a criterion
    assert {(r.query_id, r.cri): r.cost for r in found.collect()} == want


def test_near_labels_come_first():
    class Counted:
        def __init__(self, a):
            self.a, self.n = a, 0

        def __getitem__(self, i):
            self.n += len(i)
            return self.a[i]

    n = 2000  # a step of one hop weighs 10, of two hops 2: hop by hop a label is corrected n times
    u = np.arange(0, 2 * n, 2)
    near = Adjacency(np.concatenate([u, u, u + 1]), np.concatenate([u + 2, u + 1, u + 2]), np.repeat([10, 1, 1], n))
    near.to = Counted(near.to)
    best = near.distances(1, np.zeros(1, int), np.zeros(1, int), np.zeros(1, int))[0]
    assert (best == np.arange(2 * n + 1)).all() and near.to.n < 10 * 3 * n


def test_pairs_passed_by_a_third_vertex():
    rng = np.random.default_rng(1)
    for n in (1, 5, 30, 70):
        best = np.where(rng.random((n, n)) < 0.2, FAR, rng.integers(1, 9, (n, n)))
        np.fill_diagonal(best, FAR)
        want = [[best[s, b] < FAR and any(best[s, x] + best[x, b] == best[s, b] for x in range(n) if x not in (s, b)) for b in range(n)] for s in range(n)]
        assert (boundary._passed(best, np.arange(n)) == np.array(want)).all()


def test_partitions_are_read_ahead(spark, tmp_path, monkeypatch):
    n = 60  # a path of 60 partitions took 60 rounds
    e = frame(spark, [(i, i + 1, [1 + i % 3]) for i in range(n - 1)])
    store = Store(spark, str(tmp_path / "g"), 1)
    parts = store.table("partitions", lambda: e.select(F.col("src").alias("v")).distinct().select("v", F.col("v").cast("int").alias("pid"), F.col("v").alias("pos")))
    store.edges(e, parts)
    pairs = spark.createDataFrame([(0, 0, n - 1)], "query_id long, s long, t long")
    want = sum(1 + i % 3 for i in range(n - 1))
    assert [r.cost for r in search.stored(store, pairs, 1, max_rounds=8).collect()] == [want]
    near = {i: {j: 1 for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)}
    assert search._around({10}, near, 4, 1000) == set(range(6, 15)) and search._around({10}, near, 4, 6) == {9, 10, 11}
