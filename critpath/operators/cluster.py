"""Partitioning a graph for locality: spanning tree, its depth-first order, and greedy packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critpath.functions.ids import ranked, running
from critpath.functions.weights import aggregate_weight
from critpath.operators import kernels
from critpath.operators.components import components
from critpath.runtime import checkpointed, ship
from critpath.schema import EDGE_BYTES, PARTITION_KB

#: Undirected edges up to which the spanning tree is built in one task.
TREE_ROWS = 5_000_000
#: Vertices up to which packing streams through one task, at 24 bytes each.
PACK_ROWS = 20_000_000


def weighted(edges: DataFrame, how: str = "wave") -> DataFrame:
    """u, v, w (u < v) of mirrored edges, with one weight for partitioning; absent weights count as 0."""
    full = F.transform("weights", lambda w: F.coalesce(w, F.lit(0)))
    return edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), aggregate_weight(full, how).alias("w"))


def spanning_tree(undirected: DataFrame, strategy: str = "auto") -> DataFrame:
    """u, v, w: the minimum spanning forest of (u, v, w); equal weights in order of u, then v.

    Within TREE_ROWS one task builds it; beyond, rounds in which every component takes its least
    outgoing edge. The order is strict, so both give the same edges. `prim` grows one tree from the least vertex in one
    task, with equal weights in order of the vertex reached, and takes a connected graph only.
    """
    ship(undirected.sparkSession)
    edges = undirected.select("u", "v", F.col("w").cast("long").alias("w")).where("u <> v")
    if strategy == "auto":
        strategy = "kernel" if edges.limit(TREE_ROWS + 1).count() <= TREE_ROWS else "rounds"
    if strategy == "prim":

        def grow(own: pd.DataFrame) -> pd.DataFrame:
            tree = kernels.prim(own.u.to_numpy(), own.v.to_numpy(), own.w.to_numpy())
            return pd.DataFrame([(min(a, b), max(a, b), w) for a, b, w in tree], columns=["u", "v", "w"]).astype("int64")

        return edges.groupBy(F.lit(0).alias("g")).applyInPandas(grow, "u long, v long, w long")
    if strategy == "kernel":

        def run(own: pd.DataFrame) -> pd.DataFrame:
            tree = kernels.spanning_tree(own.u.to_numpy(), own.v.to_numpy(), own.w.to_numpy())
            return pd.DataFrame([(u, v, w) for w, u, v in tree], columns=["u", "v", "w"]).astype("int64")

        return edges.groupBy(F.lit(0).alias("g")).applyInPandas(run, "u long, v long, w long")
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w"))
    label = checkpointed(edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("label", F.col("x")))
    tree = None
    while True:
        a, b = label.withColumnsRenamed({"x": "u", "label": "lu"}), label.withColumnsRenamed({"x": "v", "label": "lv"})
        cross = edges.join(a, "u").join(b, "v").where("lu <> lv").select("lu", "lv", F.struct("w", "u", "v").alias("e"))
        ends = cross.select(F.col("lu").alias("l"), "e").unionByName(cross.select(F.col("lv").alias("l"), "e"))
        chosen = checkpointed(ends.groupBy("l").agg(F.min("e").alias("e")).select("e").distinct().select("e.u", "e.v", "e.w"))
        if chosen.isEmpty():
            return tree if tree is not None else edges.limit(0)
        tree = chosen if tree is None else tree.unionByName(chosen)
        joined = chosen.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        merged = components(joined).withColumnsRenamed({"node": "label", "root": "to"})
        label = checkpointed(label.join(merged, "label", "left").select("x", F.coalesce("to", "label").alias("label")))


def _order(tree: DataFrame, strategy: str) -> str:
    if strategy != "auto":
        return strategy
    return "kernel" if tree.limit(TREE_ROWS + 1).count() <= TREE_ROWS else "rounds"


def _distances(following: DataFrame) -> DataFrame:
    """id, d: how many steps (id, to) lead from id to the end of its list, by doubling; to is null at an end."""
    state = checkpointed(following.select("id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("d")))
    while not (going := state.where("to is not null")).isEmpty():
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        moved = going.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("d") + F.col("more")).alias("d"))
        state = checkpointed(state.where("to is null").unionByName(moved))
    return state.select("id", "d")


def _tour(arcs: DataFrame) -> DataFrame:
    """arcs(a, b, last, root) with `at`, an arc's place in the tour of its tree that leaves each vertex by its arcs in order of (last, b).

    An arc is followed by the next one, round about, that leaves its head; the tour of a tree ends where the root has no further one.
    """
    ids = checkpointed(ranked(arcs, "a", "last", "b", name="id"))
    first = ids.groupBy("a").agg(F.min("id").alias("first"))
    after = ids.select((F.col("id") - 1).alias("id"), F.col("a").alias("next_a"))
    # The arc b -> a is followed by the one after a -> b.
    turn = ids.join(after, "id", "left").join(first, "a")
    more = F.col("next_a").eqNullSafe(F.col("a"))
    to = F.when(more, F.col("id") + 1).when(F.col("a") != F.col("root"), F.col("first"))
    back = turn.select(F.col("b").alias("a"), F.col("a").alias("b"), to.alias("to"))
    left = _distances(ids.select("a", "b", "id").join(back, ["a", "b"]).select("id", "to"))
    placed = ids.join(left, "id")
    length = placed.groupBy("root").agg(F.max("d").alias("most"))
    return checkpointed(placed.join(length, "root").select("a", "b", "last", "root", (F.col("most") - F.col("d")).alias("at")))


def _walk(tree: DataFrame) -> DataFrame:
    """a, b, last, root, at: the tour that takes children by ascending id; last: the arc goes up to the parent.

    A first tour, in any order, tells which way an arc goes: down is taken before up.
    """
    both = tree.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(tree.select(F.col("v").alias("a"), F.col("u").alias("b"))).distinct()
    roots = components(tree.select("u", "v")).select(F.col("node").alias("a"), "root")
    arcs = checkpointed(both.join(roots, "a").withColumn("last", F.lit(False)))
    found = _tour(arcs)
    up = found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("at").alias("back"))
    return _tour(found.join(up, ["a", "b"]).select("a", "b", "root", (F.col("at") > F.col("back")).alias("last")))


def preorder(tree: DataFrame, strategy: str = "auto") -> DataFrame:
    """v, pos: vertices in depth-first order of a forest (u, v), children by ascending id.

    Within TREE_ROWS one task walks it; beyond, rounds of doubling rank the arcs of its Euler tour.
    """
    ship(tree.sparkSession)
    if _order(tree, strategy) == "rounds":
        walk = _walk(tree)
        entered = walk.where("not last").select("root", F.col("b").alias("v"), "at")
        tops = walk.select("root").distinct().select("root", F.col("root").alias("v"), F.lit(-1).cast("long").alias("at"))
        return ranked(entered.unionByName(tops), "root", "at").select("v", "pos")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        order = kernels.preorder(zip(own.u.tolist(), own.v.tolist()))
        return pd.DataFrame({"v": order, "pos": range(len(order))}, dtype="int64")

    return tree.select("u", "v").groupBy(F.lit(0).alias("g")).applyInPandas(run, "v long, pos long")


def euler_tour(tree: DataFrame, strategy: str = "auto") -> DataFrame:
    """i, v: the walk of length 2n - 1 that goes down to each child and back up, from the smallest vertex of each tree; as preorder."""
    ship(tree.sparkSession)
    if _order(tree, strategy) == "rounds":
        walk = _walk(tree)
        steps = walk.select("root", F.col("b").alias("v"), "at")
        tops = walk.select("root").distinct().select("root", F.col("root").alias("v"), F.lit(-1).cast("long").alias("at"))
        return ranked(steps.unionByName(tops), "root", "at", name="i").select("i", "v")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(own.u.tolist(), own.v.tolist()):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        walk, seen = [], set()
        for r in sorted(near):
            if r in seen:
                continue
            seen.add(r)
            walk.append(r)
            path = [(r, iter(sorted(near[r])))]
            while path:
                child = next((y for y in path[-1][1] if y not in seen), None)
                if child is None:
                    path.pop()
                    if path:
                        walk.append(path[-1][0])
                else:
                    seen.add(child)
                    walk.append(child)
                    path.append((child, iter(sorted(near[child]))))
        return pd.DataFrame({"i": range(len(walk)), "v": walk}, dtype="int64")

    return tree.select("u", "v").groupBy(F.lit(0).alias("g")).applyInPandas(run, "i long, v long")


def list_ranks(tour: DataFrame) -> DataFrame:
    """v, pos: vertices by their first place in a tour (i, v)."""
    return ranked(tour.groupBy("v").agg(F.min("i").alias("i")), "i").select("v", "pos")


def capacity(partition_kb: int = PARTITION_KB) -> int:
    """Directed edges that a partition holds."""
    return partition_kb * 1024 // EDGE_BYTES


def _packed_in_rounds(ordered: DataFrame, limit: int) -> DataFrame:
    """pack without a sequential fold: where a partition would end is known for every place it could begin at, and
    doubling finds the beginnings that follow from the first."""
    rows = checkpointed(running(ordered.select("v", F.col("pos").cast("long").alias("pos"), F.col("degree").cast("long").alias("degree")), "degree", "pos", name="before"))
    rows = rows.withColumn("before", F.col("before").cast("long"))
    # A partition that begins at i ends before the first place whose running sum is above before(i) + limit.
    sums = rows.select((F.col("before") + F.col("degree")).alias("x"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("pos"), F.lit(1).cast("long").alias("one"))
    asks = rows.select((F.col("before") + limit).alias("x"), F.lit(1).alias("asks"), "pos", F.lit(0).cast("long").alias("one"))
    ends = running(sums.unionByName(asks), "one", "x", "asks", name="end").where("asks = 1")
    n = rows.count()
    jump = checkpointed(ends.select("pos", F.greatest(F.col("end").cast("long"), F.col("pos") + 1).alias("to")).where(F.col("to") < n))
    jumps = [jump]
    while not (jump := checkpointed(jumps[-1].join(jumps[-1].select(F.col("pos").alias("to"), F.col("to").alias("next")), "to").select("pos", F.col("next").alias("to")))).isEmpty():
        jumps.append(jump)
    begins = rows.where("pos = 0").select("pos")
    for jump in reversed(jumps):
        begins = checkpointed(begins.unionByName(begins.join(jump, "pos").select(F.col("to").alias("pos"))).distinct())
    marked = rows.join(begins.withColumn("new", F.lit(1).cast("long")), "pos", "left").withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
    counted = running(marked.select("v", "pos", "new"), "new", "pos", name="earlier")
    return counted.select("v", (F.col("earlier") + F.col("new") - 1).cast("int").alias("pid"), "pos")


def pack(ordered: DataFrame, limit: int, strategy: str = "auto") -> DataFrame:
    """v, pid, pos from (v, pos, degree): vertices in order, from place 0, fill partitions of at most `limit` edges.

    A vertex above the limit has a partition of its own. Within PACK_ROWS the fold streams over one sorted partition and holds
    one batch at a time; beyond, rounds of doubling give the same partitions.
    """
    if strategy == "rounds" or strategy == "auto" and ordered.limit(PACK_ROWS + 1).count() > PACK_ROWS:
        return _packed_in_rounds(ordered, limit)

    def run(batches):
        pid, used, first = 0, 0, True
        for batch in batches:
            degree, out = batch.column(2).to_pylist(), []
            for d in degree:
                if not first and used + d > limit:
                    pid, used = pid + 1, 0
                used, first = used + d, False
                out.append(pid)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.int32)), batch.column(1)], names=["v", "pid", "pos"])

    single = ordered.select("v", F.col("pos").cast("long").alias("pos"), F.col("degree").cast("long").alias("degree")).repartition(1).sortWithinPartitions("pos")
    return single.mapInArrow(run, "v long, pid int, pos long")


def partition_info(partitions: DataFrame) -> DataFrame:
    """pid, n_vertices, vertices: the vertices of each partition in order; a partition is bounded by its capacity."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "v")))
    return partitions.groupBy("pid").agg(F.count("*").alias("n_vertices"), F.transform(rows, lambda x: x["v"]).alias("vertices"))


def partition(edges: DataFrame, how: str = "wave", partition_kb: int = PARTITION_KB) -> DataFrame:
    """v, pid, pos: weight, spanning tree, depth-first order and packing of mirrored edges."""
    order = preorder(spanning_tree(weighted(edges, how)))
    degree = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return pack(order.join(degree, "v"), capacity(partition_kb))


def with_external(assignment: DataFrame, n_parts: int) -> DataFrame:
    """v, pid, pos of partitions made by another program (v, pid); a pid out of range is an error."""
    ok = F.col("pid").between(0, n_parts - 1)
    pid = F.when(ok, F.col("pid")).otherwise(F.raise_error(F.lit("a partition id is out of range")).cast("int"))
    return assignment.select("v", pid.cast("int").alias("pid"), (F.row_number().over(Window.partitionBy("pid").orderBy("v")) - 1).cast("long").alias("pos"))
