"""Searches that end where their results are decided."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from critpath.functions.weights import edges_wide, stacked
from critpath.operators import boundary, paths, prep, search, workload
from critpath.operators.kernels import FAR, Adjacency


def strip(n, columns, seed):
    """u, v, w of a grid."""
    rng = np.random.default_rng(seed)
    return [(v, v + s, int(rng.integers(1, 30))) for v in range(n) for s in (1, columns) if v + s < n and (s > 1 or v % columns < columns - 1)]


def test_a_search_ends_with_enough_edges():
    rows = strip(4000, 4, 1)
    u, v, w = (np.array(x) for x in zip(*rows))
    near = Adjacency(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]))
    at, zero = np.array([0, 2000]), np.zeros(2, np.int64)
    whole = near.distances(2, np.arange(2), at, zero)
    some = near.distances(2, np.arange(2), at, zero, enough=3000)
    degree = np.diff(near.start)
    for k in range(2):
        seen = some[k] < FAR
        assert (some[k][seen] == whole[k][seen]).all() and whole[k][~seen].min() > whole[k][seen].max()  # the nearest, and all of them
        assert 3000 <= degree[seen].sum() < degree.sum()
    assert (near.distances(2, np.arange(2), at, zero, enough=10**9) == whole).all()


def test_coverage_classes_need_no_labels_beyond(spark):
    e = prep.mirror(spark.createDataFrame([(u, v, [w]) for u, v, w in strip(4000, 4, 2)], "u long, v long, weights array<int>"))
    degree = prep.degrees(e)
    start = spark.createDataFrame([(x, 0, x, 0) for x in (0, 7, 2500)], "query_id long, cri int, v long, d long")
    found = []
    for enough in (None, -(-degree.agg(F.sum("degree")).first()[0] * workload.MEDIUM_PERCENT // 100)):
        labels = search.labels_kernel(edges_wide(e, 1), start, enough=enough).select(F.col("query_id").alias("s"), "v", "d")
        classes = workload.coverage_classes(labels, e, degree.select("v"), degree=degree if enough else None)
        found.append((labels.count(), sorted(map(tuple, classes.select("s", "v", "qtype").collect()))))
    assert found[0][1] == found[1][1] and found[1][0] < found[0][0] == 12_000


@pytest.mark.parametrize("limit", [search.KERNEL_ROWS, 0])
def test_labels_nearer_than_the_target(spark, limit):
    e = edges_wide(prep.mirror(spark.createDataFrame([(u, v, [w]) for u, v, w in strip(12, 3, 3)] + [(90, 91, [1])], "u long, v long, weights array<int>")), 1)
    start = spark.createDataFrame([(0, 0, 0, 0, 5), (1, 0, 5, 0, 0), (2, 0, 5, 0, 90), (3, 0, 7, 0, 7)], "query_id long, cri int, v long, d long, t long")
    whole = {(r.query_id, r.v): r.d for r in search.labels_kernel(e, start).collect()}
    goal = {q: whole[q, t] for q, t in ((0, 5), (1, 0), (3, 7))}
    want = {(q, v): d for (q, v), d in whole.items() if q in goal and (d < goal[q] or (q, v) in {(0, 5), (1, 0), (3, 7)})}
    assert {(r.query_id, r.v): r.d for r in search.labels_kernel(e, start, limit, targets=True, nearer=True).collect()} == want
    assert len(want) < sum(q in goal for q, _ in whole)


@pytest.mark.parametrize("rows", [paths.PATH_ROWS, 0])
def test_paths_from_both_ends_need_no_labels_beyond_the_target(spark, monkeypatch, rows):
    monkeypatch.setattr(paths, "PATH_ROWS", rows)
    e = edges_wide(prep.mirror(spark.createDataFrame([(u, v, [w % 3 + 1]) for u, v, w in strip(12, 3, 4)], "u long, v long, weights array<int>")), 1)
    found = []
    for near in (False, True):
        start = spark.createDataFrame([(q, 0, s, 0, t) for q, s, t in ((0, 0, 7), (2, 0, 4), (7, 7, 0), (4, 4, 0))], "query_id long, cri int, v long, d long, t long")
        labels = search.labels_kernel(e, start, targets=near, nearer=near)
        forward = labels.where("query_id in (0, 2)").select("cri", "v", "d").distinct()
        backward = labels.where("query_id in (4, 7)").withColumnRenamed("query_id", "t")
        found.append((labels.count(), sorted(map(tuple, paths.shown(paths.bidirectional_paths(stacked(e), forward, backward, 0)).collect()))))
    assert found[0][1] == found[1][1] and len(found[0][1]) == 2 and found[1][0] < found[0][0] == 48


@pytest.mark.parametrize("pruned", [False, True])
def test_small_partitions_are_searched_together(pruned, monkeypatch):
    """Many partitions at once, of mixed sizes, as one after the other by searches from their starts."""
    rng = np.random.default_rng(5)
    pid, near, starts = np.arange(40) * 3, {}, []
    size = rng.integers(1, 14, 40)
    for c in (0, 2):
        rows = [(pid[p], 100 * p + int(a), 100 * p + int(b), int(rng.integers(1, 6))) for p in range(40) for a, b in rng.integers(0, size[p], (2 * size[p], 2)) if a != b]
        near[c] = tuple(np.array(x) for x in zip(*(rows + [(p, b, a, w) for p, a, b, w in rows])))
    starts = tuple(np.array(x) for x in zip(*((pid[p], 100 * p + a) for p in range(40) for a in range(size[p]) if a % 3)))
    rows = lambda: sorted(x for part in boundary._searched(pid, near, starts, starts, pruned) for x in zip(*(c.tolist() for c in part)))
    calls = []
    tables = boundary._tables
    monkeypatch.setattr(boundary, "_tables", lambda *a: calls.append(1) or tables(*a))
    got = rows()
    assert len(calls) == 1 and len(got) > 500
    monkeypatch.setattr(boundary, "SMALL", 0)
    assert rows() == got and len(calls) == 1


def test_a_search_ends_at_the_goal_beyond_its_ends():
    rows = strip(400, 4, 6)
    u, v, w = (np.array(x) for x in zip(*rows))
    near = Adjacency(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]))
    ends = np.array([0, 0, 1]), np.array([40, 44, 320]), np.array([9, 1, 5])
    args = 2, np.arange(2), np.array([0, 399]), np.zeros(2, np.int64)
    whole, some = near.distances(*args), near.distances(*args, ends=ends)
    cost = lambda best: [min(best[0, 40] + 9, best[0, 44] + 1), best[1, 320] + 5]
    assert cost(whole) == cost(some) and (some < FAR).sum() < (whole < FAR).sum()


@pytest.mark.parametrize("limit", [search.KERNEL_ROWS, 0])
def test_joined_from_one_side(spark, limit):
    e = edges_wide(prep.mirror(spark.createDataFrame([(0, 1, [3, 9]), (1, 2, [4, None]), (0, 2, [9, 1]), (5, 6, [1, 1])], "u long, v long, weights array<int>")), 2)
    start = [(0, c, side, v, d) for c in (0, 1) for side, v, d in ((0, 0, 2), (1, 1, 5), (1, 2, 1))] + [(1, 0, 0, 0, 0), (1, 0, 1, 5, 0), (2, 0, 0, 99, 1), (2, 0, 1, 99, 2)]
    got = search.joined(e, spark.createDataFrame(start, "query_id long, cri int, side int, v long, d long"), limit).collect()
    assert sorted((r.query_id, r.cri, r.cost) for r in got) == [(0, 0, 10), (0, 1, 4), (2, 0, 3)]
