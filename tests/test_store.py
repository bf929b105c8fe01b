from critpath.functions.weights import edges_long
from critpath.operators import boundary, prep
from critpath.plans import experiments
from critpath.sources.store import Store


def test_store_and_experiments(spark, tmp_path):
    rows = [(i, j, [1 + (i * j) % 5, None if (i + j) % 4 == 0 else 2]) for i in range(12) for j in (i + 1, i + 3) if j < 12]
    edges = prep.mirror(spark.createDataFrame(rows, "u long, v long, weights array<int>"))
    long = edges_long(edges)
    store = Store(spark, str(tmp_path / "g"), 2)
    parts = store.partitions(edges, partition_kb=1)
    store.edges(edges, parts)
    found = store.boundary(edges, parts)
    short = store.shortcuts(long, parts, found)
    assert parts.select("pid").distinct().count() > 1 and parts.count() == 12
    assert sorted(map(tuple, store.scan().collect())) == sorted(map(tuple, long.collect()))
    own = {r.v for r in parts.where("pid = 0").collect()}
    assert {r.src for r in store.scan([0], k=1).collect()} == own
    plan = store.scan([0], k=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pid" in plan and "w1" not in plan.split("ReadSchema")[1]
    assert store.partitions(edges.limit(0)).count() == 12  # not built again
    od = spark.createDataFrame([(0, "S", 0, 2), (1, "L", 0, 11), (2, "L", 3, 9), (3, "L", 3, 8)], "query_id long, qtype string, s long, t long")
    report = experiments.evaluate(edges, od, strategies=("kernel", "one_pass"), criteria=(2,)).collect()
    assert len(report) == 8 and {r.n_queries for r in report if r.qtype == "L"} == {2}
    costs = {}
    for r in report:
        costs.setdefault((r.qtype, r.cri), set()).add((r.n_reached, r.avg_cost, r.avg_cost_compat))
    assert all(len(c) == 1 for c in costs.values())
    report = experiments.evaluate(edges, od, strategies=("kernel",), criteria=(2,), partitions=parts).collect()
    assert all(r.avg_visited > 0 and r.avg_partitions >= 1 and r.avg_blocks >= r.avg_partitions and r.read_bytes is not None for r in report)
    swept = experiments.sweep_partitions(edges, od, (1, 2), ("pri", "wave"), 2).collect()
    assert [(r.how, r.partition_kb) for r in swept] == [("pri", 1), ("pri", 2), ("wave", 1), ("wave", 2)] and swept[0].n_partitions > 1
    assert {(r.src, r.dst) for r in store.scan_category(0, [0]).collect()} == {(r.src, r.dst) for r in store.scan([0], k=1).collect()}
    assert {r.src for r in store.scan_shortcuts([0]).collect()} <= own and "PartitionFilters: [isnotnull(pid" in store.scan_shortcuts([0])._jdf.queryExecution().toString()
    over = boundary.overlay_search(long, parts, short, found, od, 2, strategy="kernel")
    assert over.where("cost is null").count() == 0
