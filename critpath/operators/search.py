"""Multi-criteria shortest paths: the least cost of each criterion for each pair, by several strategies.

All give the same result. `one_pass` relaxes all queries and criteria in one loop over one
table of edges; `multi_pass` one criterion after the other; `bidirectional` grows labels from
both ends; `bucketed` expands near labels first; `kernel` and `kernel_bidirectional` search in memory. Where the edges of a
criterion are bounded, one task holds them and expands its labels to the end in one round, in the strategy's own order;
beyond the bound all strategies take the loop, a hop a round. Of a large graph only the edges that the sources reach are
searched, if a few rounds find them (`within`). `stored` reads a partitioned graph on disk, and of it only the
partitions that have labels to expand, and some around them.

Edges are long (cri, src, dst, w) or wide (src, dst, w0, w1, ..); the wide ones take a row for all criteria.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critpath.functions.weights import stacked, wide_columns
from critpath.operators.kernels import FAR, Adjacency
from critpath.runtime import checkpointed, ship

KEY = ["query_id", "cri", "side", "v"]
#: Edges of one criterion that a task holds, at 8 bytes each and up to 30 while they are read.
KERNEL_ROWS = 8_000_000
#: Labels that a task works on at once, at 8 bytes each.
KERNEL_LABELS = 8_000_000
#: Partitions up to which a round of `stored` names those it reads; beyond, it reads all.
MOST_PIDS = 4096
#: Edges of one criterion that a round of `stored` searches together.
STORED_ROWS = 1_000_000
#: Bytes of a table beneath the edges from which those that searches reach are found first.
REACH_BYTES = 1 << 26
#: Rounds of that search, and vertices that it sends to all tasks; beyond either all edges are kept.
REACH_ROUNDS = 12
REACH_VERTICES = 1_000_000


def seeds(od: DataFrame, criteria: int, both: bool = False) -> DataFrame:
    """Labels that a search starts from: the source at 0, and with `both` the target from the other side."""
    cri = F.explode(F.sequence(F.lit(0), F.lit(criteria - 1)))
    ends = [F.struct(F.lit(0).alias("side"), F.col("s").alias("v"))] + [F.struct(F.lit(1).alias("side"), F.col("t").alias("v"))] * both
    return od.select("query_id", cri.alias("cri"), F.explode(F.array(*ends)).alias("e")).select("query_id", "cri", "e.side", "e.v", F.lit(0).cast("long").alias("d"))


def source_bytes(df: DataFrame) -> int:
    """Size of the largest table of files that the rows come from, by Spark's own estimate; 0 without one."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    own = [leaves.apply(i) for i in range(leaves.size())]
    return max((int(str(x.stats().sizeInBytes())) for x in own if x.getClass().getSimpleName() == "LogicalRelation"), default=0)


def reachable(edges: DataFrame, start: DataFrame, rounds: int = REACH_ROUNDS, most: int = REACH_VERTICES) -> DataFrame | None:
    """v: what start(v) reaches over the edges, itself included; None if that takes more rounds or vertices.

    A round reads the ends of edges only and keeps those whose source is new, a broadcast that Spark applies before it groups or
    shuffles the rows that make the edges.
    """
    links = edges.select("src", F.col("dst").alias("v"))
    known = front = checkpointed(start.select("v").where("v is not null").distinct())
    n = known.count()
    for _ in range(rounds):
        if n > most:
            return None
        next_ = links.join(F.broadcast(front.withColumnRenamed("v", "src")), "src", "left_semi").select("v").where("v is not null").distinct()
        front = checkpointed(next_.join(known, "v", "left_anti"))
        found = front.count()
        if not found:
            return known
        known, n = checkpointed(known.unionByName(front)), n + found
    return None


def within(edges: DataFrame, start: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None, least: int = REACH_BYTES) -> DataFrame:
    """The edges that searches from start(v) can pass: near(v) gives those of these vertices, without grouping the rows of others.

    All edges without `near`, or of a graph whose tables have fewer than `least` bytes, or if the vertices aren't found in a few rounds.
    """
    if near is None or source_bytes(edges) < least or (known := reachable(edges, start)) is None:
        return edges
    return checkpointed(near(known))


def kept(edges: DataFrame) -> DataFrame:
    """The edges with v for src, cached as they come."""
    names = wide_columns(edges)
    return edges.select(*([] if names else ["cri"]), F.col("src").alias("v"), "dst", *(names or ["w"])).persist(StorageLevel.MEMORY_AND_DISK)


def dealt(rows: DataFrame) -> DataFrame:
    """Edges that are kept as the loop joins them, and no longer as they were: by vertex (long: by criterion and vertex), sorted and cached."""
    keys = ["v"] if wide_columns(rows) else ["cri", "v"]
    edges = rows.repartition(*keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    edges.count()
    rows.unpersist()
    return edges


def _weight(edges: DataFrame) -> Column:
    """A row's weight under its criterion."""
    w = F.col("w") if not wide_columns(edges) else F.lit(None)
    for c, name in enumerate(wide_columns(edges)):
        w = F.when(F.col("cri") == c, F.col(name)).otherwise(w)
    return w.cast("long")


def relax(edges: DataFrame, start: DataFrame, od: DataFrame | None = None, meet: bool = False, width: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """query_id, cri, side, v, d: final labels.

    A round joins the labels that changed with the edges and keeps the least label of each
    vertex, in one shuffle by the labels' key. Edges are dealt and sorted once and cached, so a round
    shuffles and sorts labels only. With `od` a label that can't improve its query's
    answer is neither expanded nor made: one as far as the target's; or with `meet`, expanded past half of the best
    meeting (an optimal path always has labels up to its half from both sides) or made beyond it. With `width`
    only the nearest bucket of that width is expanded.
    """
    edges = dealt(kept(edges))
    try:
        return _relaxed(edges, start, od, meet, width, max_rounds)
    finally:
        edges.unpersist()


def _relaxed(edges: DataFrame, start: DataFrame, od: DataFrame | None = None, meet: bool = False, width: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """relax over edges that are dealt."""
    on = ["v"] if wide_columns(edges) else ["cri", "v"]
    state = checkpointed(start.groupBy(*KEY).agg(F.min("d").alias("d")).withColumns({"open": F.lit(True), "done": F.lit(False)}))
    for _ in range(max_rounds):
        ready = state.where("open").drop("done")
        most = F.lit(None).cast("long")
        if od is not None:
            if meet:
                ends = state.groupBy("query_id", "cri", "v").agg(F.min(F.when(F.col("side") == 0, F.col("d"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("d"))).alias("b"))
                bound = ends.where("a is not null and b is not null").groupBy("query_id", "cri").agg(F.min(F.col("a") + F.col("b")).alias("most"))
                ready = ready.join(bound, ["query_id", "cri"], "left").where("most is null or 2 * d <= most")
            else:
                bound = state.join(od.select("query_id", F.col("t").alias("v")), ["query_id", "v"]).select("query_id", "cri", F.col("d").alias("most"))
                ready = ready.join(bound, ["query_id", "cri"], "left").where("most is null or d < most")
            most = F.col("most")
        if width is not None:
            near = ready.groupBy("query_id", "cri").agg(F.min(F.expr(f"d div {width}")).alias("near"))
            ready = ready.join(near, ["query_id", "cri"]).where(f"d div {width} <= near").drop("near")
        reach = F.col("d") + _weight(edges)
        useful = "most is null or " + ("reach <= most" if meet else "reach < most")
        reached = ready.join(edges, on).select(*KEY, "dst", reach.alias("reach"), most.alias("most")).where("reach is not null").where(useful).select("query_id", "cri", "side", F.col("dst").alias("v"), F.col("reach").alias("d"))
        ready = ready.select(*KEY, "d", "open")
        marked = (
            state.drop("done").withColumn("was", F.col("d"))
            .unionByName(ready.withColumn("was", F.lit(None).cast("long")).withColumn("done", F.lit(True)), allowMissingColumns=True)
            .unionByName(reached, allowMissingColumns=True)
        )
        state = checkpointed(
            marked.groupBy(*KEY)
            .agg(F.min("d").alias("d"), F.min("was").alias("was"), F.bool_or(F.coalesce("done", F.lit(False))).alias("done"), F.bool_or(F.coalesce("open", F.lit(False))).alias("o"))
            .select(*KEY, "d", (F.col("was").isNull() | (F.col("d") < F.col("was")) | (F.col("o") & ~F.col("done"))).alias("open"), "done")
        )
        if state.where("done").isEmpty():  # nothing was left to expand
            return state.drop("open", "done")
    raise RuntimeError("the search did not settle")


def _answers(od: DataFrame, criteria: int, found: DataFrame) -> DataFrame:
    """One row for each query and criterion; 0 from a vertex to itself, NULL if unreachable."""
    rows = od.select("query_id", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(criteria - 1))).alias("cri"))
    cost = F.when(F.col("s") == F.col("t"), F.lit(0)).otherwise(F.col("cost")).cast("long")
    return rows.join(found, ["query_id", "cri"], "left").select("query_id", "cri", cost.alias("cost"))


def _in_tasks(edges: DataFrame, start: DataFrame, n: int, schema: str, search: Callable) -> DataFrame:
    """Rows that search(near, rows) yields for each criterion: its edges and its rows of `start` meet in one task.

    start(query_id, cri, side, v, d, t); `rows` has these columns as arrays. Edges are kept as they are read in 12 bytes each if ids
    and weights allow.
    """
    ship(edges.sparkSession)
    long = edges.withColumnRenamed("v", "src")
    long = stacked(long) if wide_columns(long) else long
    seed = start.select("cri", F.lit(True).alias("seed"), "query_id", F.col("side").cast("int").alias("side"), "v", F.col("t").alias("x"), "d")
    none = F.lit(None)
    rows = long.select("cri", F.lit(False).alias("seed"), none.cast("long").alias("query_id"), none.cast("int").alias("side"), F.col("src").alias("v"), F.col("dst").alias("x"), F.col("w").alias("d"))

    def narrow(column) -> np.ndarray:
        a = column.to_numpy(zero_copy_only=False)
        return a.astype(np.int32) if len(a) and a.min() >= -(1 << 31) and a.max() < 1 << 31 else a

    def run(batches):
        read, seeds_ = {}, []
        for b in batches:
            is_seed = b.column("seed").to_numpy(zero_copy_only=False)
            if is_seed.any():
                seeds_.append(b.filter(b.column("seed")).to_pandas())
                b = b.filter(pa.array(~is_seed))
            cri = b.column("cri").to_numpy()
            for c in np.unique(cri):
                own = b if cri[0] == c == cri[-1] and (cri == c).all() else b.filter(pa.array(cri == c))
                read.setdefault(int(c), []).append(tuple(narrow(own.column(x)) for x in ("v", "x", "d")))
        found = pd.concat(seeds_, ignore_index=True).rename(columns={"x": "t"}) if seeds_ else pd.DataFrame({"cri": []})
        for c, own in found.groupby("cri"):
            parts = read.pop(int(c), None)
            src, dst, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            del parts
            near = Adjacency(src, dst, w)
            del src, dst, w
            for out in search(near, own):
                for i in range(0, len(out), 200_000):
                    yield pa.RecordBatch.from_pandas(out[i : i + 200_000].assign(cri=int(c))[names], schema=arrow, preserve_index=False)

    kinds = {"int": pa.int32(), "long": pa.int64()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    names = arrow.names
    return rows.unionByName(seed).repartitionById(n, "cri").mapInArrow(run, schema)


def _by_task(near: Adjacency, own: pd.DataFrame, width: int | None, targets: bool, nearer: bool = False, enough: int | None = None):
    """Labels (query_id, v, d) from own(query_id, v, d, t) under one criterion; with `targets` only those of t, with `nearer` and of all nearer ones, and nothing beyond them."""
    asked = {}
    if targets:
        goals = own.drop_duplicates("query_id").set_index("query_id").t
        place, there = near.places(goals.to_numpy(np.int64))
        asked = dict(zip(goals.index[there], place[there]))
    at, known = near.places(own.v.to_numpy(np.int64))
    apart = own[~known]  # a vertex without edges reaches itself
    apart = apart[apart.v == apart.t] if targets else apart
    yield apart.groupby(["query_id", "v"], as_index=False).d.min()
    q, d = own.query_id.to_numpy()[known], own.d.to_numpy(np.int64)[known]
    at = at[known]
    ids = np.unique(q)
    ids = ids[[x in asked for x in ids]] if targets else ids
    step = max(1, KERNEL_LABELS // max(1, len(near.ids)))
    for i in range(0, len(ids), step):
        some = ids[i : i + step]
        mine = np.isin(q, some)
        goal = np.array([asked[x] for x in some]) if targets else None
        best = near.distances(len(some), np.searchsorted(some, q[mine]), at[mine], d[mine], goal, width, enough)
        if targets:
            least = best[np.arange(len(some)), goal]
            if not nearer:
                yield pd.DataFrame({"query_id": some, "v": near.ids[goal], "d": least})[least < FAR]
                continue
            best[(best >= least[:, None]) | (least[:, None] == FAR)] = FAR
            best[np.arange(len(some)), goal] = least
        for k, x in enumerate(some):
            seen = np.flatnonzero(best[k] < FAR)
            yield pd.DataFrame({"query_id": np.full(len(seen), x), "v": near.ids[seen], "d": best[k, seen]})


def _by_meeting(near: Adjacency, own: pd.DataFrame):
    """query_id, cost from own(query_id, side, v, d) under one criterion: least sum of both sides."""
    for x, rows in own.groupby("query_id"):
        sides = [rows[rows.side == k].groupby("v").d.min() for k in (0, 1)]
        here = (sides[0] + sides[1]).min() if len(sides[0].index.intersection(sides[1].index)) else FAR
        ends = []
        for k in (0, 1):
            at, known = near.places(sides[k].index.to_numpy(np.int64))
            ends.append((at[known], sides[k].to_numpy(np.int64)[known]))
        (s, ds), (t, dt) = ends
        cost = near.meeting(s, t, ds, dt, int(here)) if len(s) and len(t) else int(here)
        if cost < FAR:
            yield pd.DataFrame({"query_id": [x], "cost": [cost]})


def _by_ends(near: Adjacency, own: pd.DataFrame):
    """query_id, cost from own(query_id, side, v, d) under one criterion: least sum of both sides, by searches from side 0."""
    at, known = near.places(own.v.to_numpy(np.int64))
    both = own[own.side == 0].merge(own[own.side == 1], on=["query_id", "v"])  # some of them may have no edges
    here = (both.d_x + both.d_y).groupby(both.query_id).min()
    own, at = own[known], at[known]
    q, d, side = own.query_id.to_numpy(), own.d.to_numpy(np.int64), own.side.to_numpy()
    ids, step = np.unique(q), max(1, KERNEL_LABELS // max(1, len(near.ids)))
    for i in range(0, len(ids), step):
        some = ids[i : i + step]
        a, b = (np.isin(q, some) & (side == k) for k in (0, 1))
        ends = np.searchsorted(some, q[b]), at[b], d[b]
        best = near.distances(len(some), np.searchsorted(some, q[a]), at[a], d[a], ends=ends)
        cost = np.full(len(some), FAR)
        np.minimum.at(cost, ends[0], best[ends[0], ends[1]] + ends[2])
        here = pd.concat([here, pd.Series(cost, some)[cost < FAR]])
    here = here.groupby(level=0).min()
    yield pd.DataFrame({"query_id": here.index.to_numpy(np.int64), "cost": here.to_numpy(np.int64)})


def _tasks(edges: DataFrame, limit: int) -> int:
    """Tasks that hold a criterion each of kept edges, or 0 if one of them has more than `limit` edges; an absent weight is no edge."""
    if names := wide_columns(edges):
        return len(names) if max(edges.agg(*(F.count(n) for n in names)).first()) <= limit else 0
    n = {r.cri: r["count"] for r in edges.groupBy("cri").count().collect()}
    return 1 + max(n, default=0) if max(n.values(), default=0) <= limit else 0


def labels_kernel(edges: DataFrame, start: DataFrame, limit: int = KERNEL_ROWS, targets: bool = False, width: int | None = None, nearer: bool = False, enough: int | None = None) -> DataFrame:
    """query_id, cri, v, d from start(query_id, cri, v, d[, t]).

    One task holds the edges of a criterion if they are at most `limit`; else labels come from the loop. With `targets` a
    search ends at t, and only t's label is returned, with `nearer` and the labels of all that is nearer than t; none if t isn't reached. With
    `enough` a search may end once the vertices nearer than all others have that many edges of the criterion; their labels are returned. The
    labels are computed at once and checkpointed.
    """
    rows = kept(edges)
    try:
        if n := _tasks(rows, limit):
            own = start.select("query_id", "cri", F.lit(0).alias("side"), "v", "d", F.col("t") if targets else F.lit(None).cast("long").alias("t"))
            return checkpointed(_in_tasks(rows, own, n, "query_id long, cri int, v long, d long", lambda near, rows: _by_task(near, rows, width, targets, nearer, enough)))
        rows = dealt(rows)
        od = start.select("query_id", "t").distinct() if targets else None
        labels = _relaxed(rows, start.select("query_id", "cri", F.lit(0).alias("side"), "v", "d"), od, width=width).drop("side")
        if not targets:
            return labels
        goals = labels.join(od.withColumnRenamed("t", "v"), ["query_id", "v"], "left_semi")
        if not nearer:
            return goals
        most = goals.select("query_id", "cri", F.col("v").alias("t"), F.col("d").alias("most"))
        return labels.join(most, ["query_id", "cri"]).where("d < most or v = t").select("query_id", "cri", "v", "d")
    finally:
        rows.unpersist()


def met(edges: DataFrame, start: DataFrame, od: DataFrame, limit: int = KERNEL_ROWS) -> DataFrame:
    """query_id, cri, cost: the least way from the labels of side 0 in `start` to those of side 1, by a search from both."""
    rows = kept(edges)
    try:
        if n := _tasks(rows, limit):
            own = start.select(*KEY, "d", F.lit(None).cast("long").alias("t"))
            return checkpointed(_in_tasks(rows, own, n, "query_id long, cri int, cost long", _by_meeting))
        rows = dealt(rows)
        labels = _relaxed(rows, start, od, meet=True)
    finally:
        rows.unpersist()
    a, b = labels.where("side = 0"), labels.where("side = 1").select("query_id", "cri", "v", F.col("d").alias("e"))
    return a.join(b, ["query_id", "cri", "v"]).groupBy("query_id", "cri").agg(F.min(F.col("d") + F.col("e")).alias("cost"))


def joined(edges: DataFrame, start: DataFrame, limit: int = KERNEL_ROWS) -> DataFrame:
    """query_id, cri, cost: the least way from the labels of side 0 in `start` to those of side 1, by a search from side 0."""
    rows = kept(edges)
    try:
        if n := _tasks(rows, limit):
            own = start.select(*KEY, "d", F.lit(None).cast("long").alias("t"))
            return checkpointed(_in_tasks(rows, own, n, "query_id long, cri int, cost long", _by_ends))
        rows = dealt(rows)
        labels = _relaxed(rows, start.where("side = 0"))
    finally:
        rows.unpersist()
    last = start.where("side = 1").select("query_id", "cri", "v", F.col("d").alias("e"))
    return labels.join(last, ["query_id", "cri", "v"]).groupBy("query_id", "cri").agg(F.min(F.col("d") + F.col("e")).alias("cost"))


def _goals(edges: DataFrame, start: DataFrame, od: DataFrame, limit: int, width: int | None = None) -> DataFrame:
    """query_id, cri, cost of the targets."""
    start = start.drop("side").join(od.select("query_id", "t"), "query_id")
    return labels_kernel(edges, start, limit, targets=True, width=width).select("query_id", "cri", F.col("d").alias("cost"))


def one_pass(edges: DataFrame, od: DataFrame, criteria: int, limit: int = KERNEL_ROWS) -> DataFrame:
    return _answers(od, criteria, _goals(edges, seeds(od, criteria), od, limit))


def multi_pass(edges: DataFrame, od: DataFrame, criteria: int, limit: int = KERNEL_ROWS) -> DataFrame:
    out = None
    for c in range(criteria):
        if wide_columns(edges):
            mine = edges.select("src", "dst", *(F.col(f"w{c}") if x == c else F.lit(None).cast("int").alias(f"w{x}") for x in range(c + 1))).where(F.col(f"w{c}").isNotNull())
        else:
            mine = edges.where(F.col("cri") == c)
        found = _goals(mine, seeds(od, criteria).where(F.col("cri") == c), od, limit)
        out = found if out is None else out.unionByName(found)
    return _answers(od, criteria, out)


def bidirectional(edges: DataFrame, od: DataFrame, criteria: int, limit: int = KERNEL_ROWS) -> DataFrame:
    return _answers(od, criteria, met(edges, seeds(od, criteria, both=True), od, limit))


def bucketed(edges: DataFrame, od: DataFrame, criteria: int, width: int = 64, limit: int = KERNEL_ROWS) -> DataFrame:
    return _answers(od, criteria, _goals(edges, seeds(od, criteria), od, limit, width))


def kernel(edges: DataFrame, od: DataFrame, criteria: int, limit: int = KERNEL_ROWS) -> DataFrame:
    return one_pass(edges, od, criteria, limit)


def kernel_bidirectional(edges: DataFrame, od: DataFrame, criteria: int, limit: int = KERNEL_ROWS) -> DataFrame:
    """Searches from both ends, with labels past half of the best meeting left unexpanded."""
    return bidirectional(edges, od, criteria, limit)


def _around(pids: set[int], near: dict[int, dict[int, int]], hops: int, rows: int) -> set[int]:
    """The partitions and those up to so many hops away, a hop at a time while they have at most `rows` edges; `near`: their neighbours, with the edges to each."""
    size = lambda ps: sum(sum(near.get(p, {}).values()) for p in ps)
    found, edge = set(pids), set(pids)
    for _ in range(hops):
        edge = {q for p in edge for q in near.get(p, {})} - found
        if not edge or size(found) + size(edge) > rows:
            break
        found |= edge
    return found


def stored(store, od: DataFrame, criteria: int, most_pids: int = MOST_PIDS, max_rounds: int = 100_000, rows: int = STORED_ROWS) -> DataFrame:
    """query_id, cri, cost over a graph on disk (sources.store.Store), a partition at a time.

    A round reads the partitions that hold labels to expand, by their folders, and searches inside each until nothing
    changes there; labels that leave a partition are open in the next round. Partitions around them are read ahead and searched together,
    four times as far in each round, while they have at most `rows` edges; beyond that rounds are as many
    as such groups on a path, not vertices. A label as far as its target's isn't expanded.
    """
    spark, od = store.spark, od.select("query_id", "s", "t")
    ship(spark)
    parts = store.saved("partitions").select("v", F.col("pid").cast("int").alias("pid"))
    key = ["query_id", "cri", "v"]
    links = store.neighbours().limit(16 * most_pids + 1).collect()
    near_, hops = {}, 1
    for r in links if len(links) <= 16 * most_pids else []:
        near_.setdefault(r.pid, {})[r.to] = r.n
    start = seeds(od, criteria).drop("side").join(parts, "v", "left")
    state = checkpointed(start.select(*key, "pid", "d", F.lit(True).alias("open")))

    def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in (*key, "d", "inside")})]
        by_cri = dict(list(edges.groupby("cri")))
        for c, labels in own.groupby("cri"):
            if c not in by_cri:
                out.append(labels[[*key, "d"]].assign(inside=1))
                continue
            e = by_cri[c]
            near = Adjacency(e.src.to_numpy(), e.dst.to_numpy(), e.w.to_numpy())
            inside = np.isin(near.ids, e.src.to_numpy())
            queries, of = np.unique(labels.query_id.to_numpy(), return_inverse=True)
            at, known = near.places(labels.v.to_numpy(np.int64))
            out.append(labels[~known][[*key, "d"]].assign(inside=1))
            best = near.distances(len(queries), of[known], at[known], labels.d.to_numpy(np.int64)[known])
            q, x = np.nonzero(best < FAR)
            out.append(pd.DataFrame({"query_id": queries[q], "cri": np.full(len(q), c), "v": near.ids[x], "d": best[q, x], "inside": inside[x].astype(int)}))
        return pd.concat(out, ignore_index=True).astype("int64")

    for _ in range(max_rounds):
        bound = state.join(od.select("query_id", F.col("t").alias("v")), ["query_id", "v"]).select("query_id", "cri", F.col("d").alias("most"))
        ready = state.where("open").join(bound, ["query_id", "cri"], "left").where("pid is not null and (most is null or d < most)")
        pids = [r.pid for r in ready.select("pid").distinct().limit(most_pids + 1).collect()]
        if not pids:
            found = state.join(od.select("query_id", F.col("t").alias("v")), ["query_id", "v"]).select("query_id", "cri", F.col("d").alias("cost"))
            return _answers(od, criteria, found)
        together = bool(near_) and len(pids) <= most_pids and sum(sum(near_.get(p, {}).values()) for p in pids) <= rows
        if together:
            pids, hops = sorted(_around(set(pids), near_, hops, rows)), hops * 4
        edges = store.scan(pids if len(pids) <= most_pids or together else None, criteria, with_pid=True)
        by = "cri" if together else "pid"
        reached = ready.select("pid", *key, "d").groupBy(by).cogroup(edges.groupBy(by)).applyInPandas(run, "query_id long, cri int, v long, d long, inside long")
        # Of equal labels the one that is not open counts.
        old = state.select(*key, F.struct("d", F.col("open").cast("int").alias("o")).alias("x"))
        new = reached.select(*key, F.struct("d", (1 - F.col("inside")).cast("int").alias("o")).alias("x"))
        least = old.unionByName(new).groupBy(*key).agg(F.min("x").alias("x"))
        state = checkpointed(least.join(parts, "v", "left").select(*key, "pid", "x.d", (F.col("x.o") == 1).alias("open")))
    raise RuntimeError("the search did not settle")


STRATEGIES = {"one_pass": one_pass, "multi_pass": multi_pass, "bidirectional": bidirectional, "bucketed": bucketed, "kernel": kernel, "kernel_bidirectional": kernel_bidirectional}


def mcsp(edges: DataFrame, od: DataFrame, criteria: int, strategy: str = "auto", near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, cri, cost of od(query_id, s, t) over long or wide edges; `near` as in `within`, in the form of the edges."""
    od = checkpointed(od.select("query_id", "s", "t"))
    edges = within(edges, od.select(F.col("s").alias("v")), near)
    names = wide_columns(edges)
    edges = edges.select("src", "dst", *names[:criteria]) if names else edges.where(F.col("cri") < criteria)
    return STRATEGIES["kernel" if strategy == "auto" else strategy](edges, od, criteria)


def sssp(edges: DataFrame, source: int, criteria: int, strategy: str = "auto") -> DataFrame:
    """cri, v, d: distances from one vertex to all it reaches."""
    names = wide_columns(edges)
    edges = edges.select("src", "dst", *names[:criteria]) if names else edges.where(F.col("cri") < criteria)
    od = edges.sparkSession.createDataFrame([(0, source, source)], "query_id long, s long, t long")
    start = seeds(od, criteria)
    labels = relax(edges, start) if strategy == "loop" else labels_kernel(edges, start.drop("side"))
    return labels.select("cri", "v", "d")
