import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from critpath.functions import weights as W
from critpath.functions.ids import ranked
from critpath.operators import boundary, cluster, kernels, metrics, prep, workload

EDGE = "u long, v long, weights array<int>, line long"


def test_clean_and_dedup(spark):
    e = spark.createDataFrame([(0, 1, [5, 5], 0), (1, 0, [2, 2], 1), (1, 1, [4, 4], 2), (2, 1, [7, None], 3)], EDGE)
    assert sorted(map(tuple, prep.dedup(prep.clean(e), "line").collect())) == [(0, 1, [5, 5]), (1, 2, [7, None])]
    assert sorted(map(tuple, prep.dedup(prep.clean(e), "line", keep="last").collect())) == [(0, 1, [2, 2]), (1, 2, [7, None])]
    assert prep.clean(e.limit(0)).count() == 0
    with pytest.raises(Exception, match="not positive"):
        prep.clean(spark.createDataFrame([(0, 1, [0], 0)], EDGE)).collect()
    with pytest.raises(Exception, match="out of bounds"):
        prep.check_bounds(e, 2).collect()
    m = prep.mirror(prep.dedup(e, "line"))
    assert prep.check_symmetric(m).count() == 0 and prep.check_symmetric(m.where("src <> 0")).count() == 1


def test_largest_component_and_relabel(spark):
    e = prep.mirror(spark.createDataFrame([(10, 20, [1], 0), (20, 30, [1], 1), (5, 6, [1], 2)], EDGE))
    big = prep.largest_component(e)
    assert {(r.src, r.dst) for r in big.collect()} == {(10, 20), (20, 10), (20, 30), (30, 20)}
    dense, ids = prep.relabel_dense(big)
    assert {(r.src, r.dst) for r in dense.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert {(r.orig_id, r.v) for r in ids.collect()} == {(10, 0), (20, 1), (30, 2)}


def test_ranked_over_many_partitions(spark):
    xs = random.Random(0).sample(range(10_000), 500)
    got = ranked(spark.createDataFrame([(x,) for x in xs], "x long").repartition(9), "x").collect()
    assert {r.x: r.pos for r in got} == {x: i for i, x in enumerate(sorted(xs))}


def test_weights(spark):
    df = spark.createDataFrame([([7, 8, 10, 1, 2],)], "w array<int>")
    row = df.select(*(W.aggregate_weight(df.w, h).alias(h) for h in ("pri", "ave", "wave", "wave_trunc"))).first()
    assert tuple(row) == (7, 6, 9, 7)
    cats = spark.createDataFrame([(1,), (2,), (3,), (4,), (1023,), (1024,)], "w long").select(W.category("w").alias("c"), W.lower_bound(W.category("w")).alias("b"))
    assert [tuple(r) for r in cats.collect()] == [(0, 1), (1, 2), (1, 2), (2, 4), (9, 512), (10, 1024)]


def test_random_criteria_agree_in_both_directions(spark):
    base = spark.createDataFrame([(i, i + 1, 5 + i) for i in range(50)], "u long, v long, w long")
    m = prep.mirror(prep.random_criteria(base, 5, 54))
    rows = m.collect()
    assert prep.check_symmetric(spark.createDataFrame(rows, m.schema)).count() == 0
    assert all(len(r.weights) == 5 and min(r.weights) >= 5 for r in rows)


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_spanning_tree(spark, strategy):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(30), 2))): rng.randint(1, 5) for _ in range(80)}
    got = cluster.spanning_tree(spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w long"), strategy).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    want = set()
    for w, (u, v) in sorted((w, e) for e, w in edges.items()):
        if root(u) != root(v):
            parent[root(u)] = root(v)
            want.add((u, v, w))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_order_tour_and_packing(spark):
    tree = spark.createDataFrame([(0, 3), (0, 1), (1, 4), (1, 2)], "u long, v long")
    order = [r.v for r in cluster.preorder(tree).orderBy("pos").collect()]
    assert order == [0, 1, 2, 4, 3]
    assert [r.v for r in cluster.euler_tour(tree).orderBy("i").collect()] == [0, 1, 2, 1, 4, 1, 0, 3, 0]
    assert [r.v for r in cluster.list_ranks(cluster.euler_tour(tree)).orderBy("pos").collect()] == order
    rows = spark.createDataFrame([(v, i, d) for i, (v, d) in enumerate([(0, 2), (1, 2), (2, 9), (3, 1), (4, 4), (5, 1)])], "v long, pos long, degree long")
    assert [r.pid for r in cluster.pack(rows, 5).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3]
    assert cluster.capacity(256) == 9362


def test_orders_and_packing_in_rounds(spark):
    rng = random.Random(2)
    rows = [(p, v) if rng.random() < 0.5 else (v, p) for v in range(1, 24) for p in [rng.randrange(max(0, v - 5), v)] if v != 13] + [(40, 41), (41, 50)]
    tree = spark.createDataFrame(rows, "u long, v long").cache()
    for f, key in ((cluster.preorder, "pos"), (cluster.euler_tour, "i")):
        assert [r.v for r in f(tree, "rounds").orderBy(key).collect()] == [r.v for r in f(tree, "kernel").orderBy(key).collect()]
    ordered = spark.createDataFrame([(100 + i, i, rng.choice((0, 1, 2, 3, 9))) for i in range(40)], "v long, pos long, degree long").cache()
    for limit in (5, 100):
        assert sorted(map(tuple, cluster.pack(ordered, limit, "rounds").collect())) == sorted(map(tuple, cluster.pack(ordered, limit, "stream").collect()))


def test_boundary_tags(spark):
    e = prep.mirror(spark.createDataFrame([(0, 1, [1], 0), (1, 2, [1], 1), (2, 3, [1], 2), (3, 4, [1], 3), (4, 5, [1], 4)], EDGE))
    p = spark.createDataFrame([(v, 0 if v < 3 else 1, v) for v in range(6)], "v long, pid int, pos long")
    assert sorted((r.v, r.tag) for r in boundary.boundary(e, p).collect()) == [(2, 1), (3, 1)]
    p = spark.createDataFrame([(v, v // 2, v) for v in range(6)], "v long, pid int, pos long")
    assert sorted((r.v, r.tag) for r in boundary.boundary(e, p).collect()) == [(1, 1), (2, 2), (3, 2), (4, 1)]


def test_metrics(spark):
    r = spark.createDataFrame([(0, 0, 10), (1, 0, None), (2, 0, 2_000_000)], "query_id long, cri int, cost long")
    assert [tuple(x) for x in metrics.average_cost(r).collect()] == [(0, 2, 1_000_005.0)]
    assert [tuple(x) for x in metrics.average_cost_compat(r).collect()] == [(0, 3)]
    t = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "t double")
    assert tuple(metrics.build_times(t).first()) == (4.0, 2.0, 3.0, 6.0)
    took = {}
    with metrics.timed(took, "x"):
        pass
    assert took["x"] >= 0 and metrics.peak_mb() > 0


def test_random_pairs_repeat(spark):
    e = prep.mirror(spark.createDataFrame([(i, i + 1, [1], i) for i in range(20)], EDGE))
    a, b = (sorted(map(tuple, workload.random_pairs(e, 30, seed=3).collect())) for _ in range(2))
    assert a == b and len(a) == 30 and all(s != t for _, s, t in a)
    assert workload.random_pairs(e.limit(0), 30).count() == 0


def test_random_criteria_depend_on_the_edge_alone(spark):
    base = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(100).cast("long").alias("w"))
    a = {(r.u, r.v): r.weights for r in prep.random_criteria(base, 1, 200, seed=3).collect()}
    b = prep.mirror(prep.random_criteria(base.repartition(7, "v").sortWithinPartitions(F.desc("u")), 1, 200, seed=3)).repartition(5)
    assert all(r.weights == a[min(r.src, r.dst), max(r.src, r.dst)] for r in b.collect())
    ones = [w[1] for w in a.values()]
    assert 195 < sum(ones) / 500 < 205 and 7 < (sum((x - 200) ** 2 for x in ones) / 500) ** 0.5 < 13
    assert all(w[1] == 7 for w in (r.weights for r in prep.derive_criteria(base, 1, 200, [F.lit(0.0)] * 3, F.lit(0.5), second=F.lit(7)).collect()))


def test_two_tables_of_weights(spark):
    a = spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "u long, v long, w int")
    b = spark.createDataFrame([(0, 1, 8), (7, 8, 1)], "u long, v long, w int")
    assert sorted(map(tuple, prep.merge_criteria(a, b).collect())) == [(0, 1, [5, 8]), (1, 2, [6, None])]
    for x, y in ((a, b.where("u = 0")), (a.where("u = 0"), b)):
        with pytest.raises(Exception, match="one of the two tables"):
            prep.join_criteria(x, y).collect()
    moved = prep.shift_ids(spark.createDataFrame([(1, 2, 100_000_000), (2, 3, 4)], "u long, v long, w int"), -1, missing=100_000_000)
    assert sorted(map(tuple, moved.collect()), key=str) == [(0, 1, None), (1, 2, 4)]


def test_prim_grows_by_weight_and_vertex():
    u, v, w = (np.array(c) for c in zip(*[(0, 3, 2), (0, 1, 2), (1, 2, 1), (2, 3, 1), (3, 4, 5), (2, 4, 5)]))
    assert kernels.prim(u, v, w) == [(0, 1, 2), (1, 2, 1), (2, 3, 1), (2, 4, 5)]
    with pytest.raises(ValueError, match="connected"):
        kernels.prim(np.array([0, 5]), np.array([1, 6]), np.array([1, 1]))


def test_boundary_less_partition_is_reported(spark):
    e = prep.mirror(spark.createDataFrame([(0, 1, [1], 0), (2, 3, [1], 1)], EDGE))
    p = spark.createDataFrame([(v, v // 2, v) for v in range(4)], "v long, pid int, pos long")
    with pytest.raises(ValueError, match="no boundary"):
        boundary.check_boundary(boundary.boundary(e, p), p)


def test_memory_and_task_io(spark, tmp_path):
    assert metrics.state_mb("bi_multi_hop", 1 << 20, 3, queue_mb=10) == 42 + 60 and metrics.check_memory("dijkstra_io", 100, 1 << 20, queue_mb=50) == 32
    with pytest.raises(ValueError, match="more than 20"):
        metrics.check_memory("em_dijk", 20, 1 << 20, pools_mb=16)
    took = {}
    spark.range(100_000).write.parquet(f"{tmp_path}/x")
    with metrics.counted_io(spark, took, "scan"):
        spark.read.parquet(f"{tmp_path}/x").groupBy("id").count().write.format("noop").mode("overwrite").save()
    assert took["scan"].read > 0 and took["scan"].shuffle_written > 0 and took["scan"] - took["scan"] == metrics.TaskIO()
