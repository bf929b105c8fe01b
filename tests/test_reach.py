"""Searches of large graphs over only those edges that their sources reach."""

import pytest

from critpath.functions import weights as W
from critpath.operators import prep, search, workload
from critpath.plans import queries
from critpath.sources import graphs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    rows = [(0, 1, [3, 9]), (1, 2, [4, None]), (0, 2, [9, 1]), (5, 6, [1, 1]), (6, 7, [2, 2])]
    return prep.mirror(spark.createDataFrame(rows, "u long, v long, weights array<int>"))


def test_reachable(spark, split):
    start = spark.createDataFrame([(0,), (0,), (99,), (None,)], "v long")
    assert sorted(r.v for r in search.reachable(split, start).collect()) == [0, 1, 2, 99]
    assert search.reachable(split, start, rounds=1) is None and search.reachable(split, start, most=2) is None


def test_within_gives_the_same_costs(spark, monkeypatch):
    """All strategies on the tables' own graph, and the edges kept are those of the reached vertices."""
    e = queries.supply_edges(spark, SF)
    od = workload.arithmetic_pairs(e, 6)
    near = queries._supply_near(spark, SF, 5)
    edges = W.edges_wide(e, 5)
    assert search.source_bytes(edges) > 0
    some = search.within(edges, spark.createDataFrame([(0,)], "v long"), near, least=0)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, edges.collect()))  # one component
    calls = []
    monkeypatch.setattr(search, "within", lambda edges, start, near=None: calls.append(1) or near(search.reachable(edges, start)))
    want = sorted(map(tuple, search.one_pass(edges, od, 5).collect()))
    assert sorted(map(tuple, search.mcsp(edges, od, 5, "auto", near).collect())) == want and calls


def test_line_items_of_some_suppliers(spark):
    e = graphs.supply(spark, SF)
    own = spark.createDataFrame([(0,), (4,), (7,)], "v long")
    want = e.where("u in (0, 4)")
    assert sorted(map(tuple, graphs.supply(spark, SF, own).collect())) == sorted(map(tuple, want.collect())) != []


def test_supply_vertices(spark):
    want = workload.vertices(queries.supply_edges(spark, SF))
    assert sorted(r.v for r in graphs.supply_vertices(spark, SF).collect()) == sorted(r.v for r in want.collect())


def test_multiplex_vertices(spark):
    rows = [("view", 1, 2, 3), ("view", 1, 2, 0), ("view", 3, 4, 0), ("error", 3, 4, 5), ("click", 5, 6, -1), ("view", 7, 7, 2), ("other", 8, 9, 1), (None, 9, 10, 1)]
    for layered in (spark.createDataFrame(rows, "layer string, u long, v long, w int"), graphs.event_layers(spark, SF)):
        want = workload.vertices(prep.mirror(graphs.multiplex(spark, SF, layered)))
        assert sorted(r.v for r in graphs.multiplex_vertices(layered).collect()) == sorted(r.v for r in want.collect()) != []


def test_multiplex_pairs_need_no_second_graph(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(queries, "give_back", lambda _: calls.append("back"))
    multiplex = graphs.multiplex
    monkeypatch.setattr(graphs, "multiplex", lambda *a: calls.append("graph") or multiplex(*a))
    monkeypatch.setattr(search, "mcsp", lambda edges, od, k, strategy: calls.append(od.count()) or search.one_pass(edges, od, k))
    assert queries.mcsp_multiplex(spark, SF).count() == 5 * calls[-1]
    assert calls == ["back", "back", "graph", calls[-1]]
