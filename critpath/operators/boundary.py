"""Boundary vertices of partitions, and the shortcut overlay between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.functions.weights import stacked, wide_columns
from critpath.operators import search
from critpath.operators.kernels import FAR, Adjacency
from critpath.runtime import checkpointed, ship

#: Vertices of a partition up to which it is searched together with others, all its distances at once.
SMALL = 64
#: Cells of the distance tables that are worked on at once.
CELLS = 1 << 18
#: Rows of small partitions that a task reads before it searches them.
TOGETHER = 200_000
#: Partitions asked for up to which they are sent to all tasks.
OWN_PIDS = 100_000


def with_pids(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Edges with the partitions of both ends (ps, pd); edges that have them already stay as they are."""
    if {"ps", "pd"} <= set(edges.columns):
        return edges
    p = partitions.select("v", "pid")
    return edges.join(p.withColumnsRenamed({"v": "src", "pid": "ps"}), "src").join(p.withColumnsRenamed({"v": "dst", "pid": "pd"}), "dst")


def check_boundary(found: DataFrame, partitions: DataFrame) -> DataFrame:
    """The same boundary; a partition without a boundary vertex is an error."""
    bare = partitions.select("pid").distinct().join(found.select("pid").distinct(), "pid", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"partition {bare[0].pid} has no boundary vertex")
    return found


def boundary(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """v, pid, tag of vertices with a neighbour in another partition.

    tag 2: all neighbours in its own partition are boundary vertices (or it has none); tag 1: not so.
    """
    marked = with_pids(edges.select("src", "dst", *({"ps", "pd"} & set(edges.columns))), partitions)
    found = marked.groupBy(F.col("src").alias("v"), F.col("ps").alias("pid")).agg(F.bool_or(F.col("ps") != F.col("pd")).alias("b")).where("b").select("v", "pid")
    inner = marked.where("ps = pd").join(found.select(F.col("v").alias("dst"), F.lit(True).alias("edge")), "dst", "left")
    full = inner.groupBy(F.col("src").alias("v")).agg(F.bool_and(F.coalesce("edge", F.lit(False))).alias("full"))
    tag = F.when(F.coalesce("full", F.lit(True)), F.lit(2)).otherwise(F.lit(1)).cast("tinyint")
    return found.join(full, "v", "left").select("v", "pid", tag.alias("tag"))


def boundary_stats(found: DataFrame) -> DataFrame:
    """All boundary vertices, and the mean (rounded down) and most in a partition."""
    n = found.groupBy("pid").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_boundary"), F.floor(F.sum("n") / F.count("*")).alias("avg_boundary"), F.max("n").alias("max_boundary"))


def _passed(best: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which distances best[s, b] between the same vertices are also those of a way through a third one.

    Finite positive distances; `to` are the columns of the rows' own vertices. One vertex in the middle is tried at a time, or all of
    a small table at once.
    """
    if best.shape[0] ** 2 * best.shape[1] <= 1 << 18:
        first, second = best[:, to].copy(), best.copy()
        first[np.arange(len(to)), np.arange(len(to))] = second[np.arange(len(to)), to] = FAR  # not the ends themselves
        return ((first[:, :, None] + second[None, :, :] == best[:, None, :]).any(1)) & (best < FAR)
    through = np.zeros(best.shape, bool)
    for x in range(len(to)):
        first, second = best[:, to[x]].copy(), best[x].copy()
        first[x] = second[to[x]] = FAR  # not the ends themselves
        through |= (first[:, None] + second[None, :] == best) & (best < FAR)
    return through


def _tables(near: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n: int, size: int) -> list[np.ndarray]:
    """For each criterion the least distances between all vertices of n partitions, [partition, from, to], from edges (partition, from, to, w); FAR: none."""
    heaviest = max((int(w.max()) for *_, w in near if len(w)), default=0)
    kind, far = (np.int32, 1 << 29) if heaviest * size < 1 << 29 else (np.int64, FAR)
    out = []
    for p, a, b, w in near:
        d = np.full((n, size, size), far, kind)
        np.minimum.at(d, (p, a, b), w.astype(kind))
        d[:, np.arange(size), np.arange(size)] = 0
        sums = np.empty_like(d)
        for x in range(size):  # ways through one vertex after the other
            np.add(d[:, :, x, None], d[:, None, x, :], out=sums)
            np.minimum(d, sums, out=d)
        out.append(d)
    return out


def _kept(tables: list[np.ndarray], asked: np.ndarray, pruned: bool) -> list[np.ndarray]:
    """Which of the asked distances stay under each criterion; pruned: those of pairs that under some criterion no way of that length through a third vertex joins."""
    found, kept = [], np.zeros(asked.shape, bool)
    for d in tables:
        far = FAR if d.dtype == np.int64 else 1 << 29
        found.append(asked & (d < far))
        if pruned:
            own = np.where(found[-1], d, np.array(far, d.dtype))
            through, sums = np.zeros(asked.shape, bool), np.empty_like(own)
            for x in range(d.shape[1]):
                np.add(own[:, :, x, None], own[:, None, x, :], out=sums)
                through |= sums == own
            kept |= found[-1] & ~through
    return [f & kept for f in found] if pruned else found


def _searched(pid: np.ndarray, near: dict[int, tuple[np.ndarray, ...]], starts: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], pruned: bool):
    """Columns pid, cri, s, b, dist of some partitions: near: edges (pid, src, dst, w) of each criterion; starts and ends: (pid, v)."""
    v = np.unique(np.concatenate([starts[1], ends[1], *(x for e in near.values() for x in e[1:3])]))
    code = lambda p, x: np.searchsorted(pid, p) * len(v) + np.searchsorted(v, x)
    coded = {c: (np.searchsorted(pid, e[0]), code(e[0], e[1]), code(e[0], e[2]), e[3]) for c, e in near.items()}
    from_, to = code(*starts), code(*ends)
    keys = np.unique(np.concatenate([from_, to, *(x for e in coded.values() for x in e[1:3])]))
    of = keys // len(v)
    first = np.searchsorted(of, np.arange(len(pid) + 1))
    sizes = np.diff(first)
    is_start, is_end = np.isin(keys, from_), np.isin(keys, to)
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(pid), np.int64)
    rank[order] = np.arange(len(pid))
    sorted_ = {}
    for c, (p, a, b, w) in coded.items():
        by = np.argsort(rank[p], kind="stable")
        p, a, b = p[by], np.searchsorted(keys, a[by]), np.searchsorted(keys, b[by])
        sorted_[c] = (rank[p], a - first[p], b - first[p], w[by])
    i = 0
    while i < len(order):
        size = max(1, int(sizes[order[i]]))
        j = i + 1
        if size <= SMALL:
            j = min(len(order), i + max(1, CELLS // size**2))
            j = max(i + 1, int(np.searchsorted(sizes[order[i:j]], SMALL, "right")) + i)
        size, own = max(1, int(sizes[order[j - 1]])), order[i:j]
        edges = {c: tuple(x[slice(*np.searchsorted(r[0], [i, j]))] for x in r) for c, r in sorted_.items()}
        if size > SMALL:
            of_one = slice(first[own[0]], first[own[0] + 1])
            names = v[keys[of_one] % len(v)]
            goals = np.flatnonzero(is_end[of_one])
            for c, x, y, d in _one({c: e[1:] for c, e in edges.items()}, np.flatnonzero(is_start[of_one]), goals, pruned):
                yield np.full(len(x), pid[own[0]]), np.full(len(x), c), names[x], names[y], d
            i = j
            continue
        place = first[own][:, None] + np.arange(size)
        real = np.arange(size) < sizes[own][:, None]
        place = np.where(real, place, 0)
        s, b = is_start[place] & real, is_end[place] & real
        asked = s[:, :, None] & b[:, None, :] & ~np.eye(size, dtype=bool)
        tables = _tables([(r - i, x, y, w) for r, x, y, w in edges.values()], len(own), size)
        names = v[keys % len(v)][place]
        for c, d, k in zip(edges, tables, _kept(tables, asked, pruned)):
            p, x, y = np.nonzero(k)
            yield pid[own[p]], np.full(len(p), c), names[p, x], names[p, y], d[p, x, y].astype(np.int64)
        i = j


def _one(edges: dict[int, tuple[np.ndarray, ...]], starts: np.ndarray, goals: np.ndarray, pruned: bool):
    """cri, s, b, dist of one larger partition with edges (from, to, w), by searches from its starts."""
    rows, kept = [], [np.zeros(0, np.int64)]
    v = np.union1d(starts, goals)
    for c, (a, b, w) in edges.items():
        near = Adjacency(a, b, w)
        at, known = near.places(starts)
        to, there = near.places(goals)
        some, ends = starts[known], goals[there]
        own = [np.zeros((0, 3), np.int64)]
        for i in range(0, len(some), 256):  # so many searches at once
            n = len(some[i : i + 256])
            best = near.distances(n, np.arange(n), at[known][i : i + 256], np.zeros(n, np.int64), width=FAR)[:, to[there]]
            x, y = np.nonzero((best < FAR) & (some[i : i + 256, None] != ends[None, :]))
            own.append(np.stack([some[i + x], ends[y], best[x, y]], 1))
        s, b, d = np.concatenate(own).T
        s_, b_ = np.searchsorted(v, s), np.searchsorted(v, b)
        rows.append((c, s, b, d, s_ * len(v) + b_))
        if pruned:
            best = np.full((len(v), len(v)), FAR)
            best[s_, b_] = d
            x, y = np.nonzero((best < FAR) & ~_passed(best, np.arange(len(v))))
            kept.append(x * len(v) + y)
    for c, s, b, d, pair in rows:
        stays = np.isin(pair, np.concatenate(kept)) if pruned else np.ones(len(s), bool)
        yield c, s[stays], b[stays], d[stays]


def local_distances(edges: DataFrame, partitions: DataFrame, starts: DataFrame, ends: DataFrame, pruned: bool = False) -> DataFrame:
    """pid, cri, s, b, dist: least distances inside a partition, from its starts(v, pid) to its ends(v, pid), over long or wide edges.

    A partition's edges meet in one task, which searches many small partitions together; a partition's size is bounded by the partitioner. Pruned
    (starts and ends alike): a pair stays if under some criterion no shortest path between them passes another of the vertices.
    """
    ship(edges.sparkSession)
    names = wide_columns(edges)
    weights = names or ["w"]
    own = checkpointed(starts.select(F.col("pid").alias("ps")).distinct())  # a partition without a start has no distances
    own = F.broadcast(own) if own.count() <= OWN_PIDS else own
    none = lambda kind: F.lit(None).cast(kind)
    cri = none("int") if names else F.col("cri").cast("int")
    inner = with_pids(edges, partitions).where("ps = pd").join(own, "ps", "left_semi")
    rows = inner.select(F.col("ps").cast("int").alias("pid"), F.lit(0).alias("kind"), cri.alias("cri"), "src", "dst", *(F.col(n).cast("long").alias(n) for n in weights))
    ends = ends.join(own, ends["pid"] == own["ps"], "left_semi")
    for kind, asked in ((1, starts), (2, ends)):
        rows = rows.unionByName(asked.select(F.col("pid").cast("int").alias("pid"), F.lit(kind).alias("kind"), none("int").alias("cri"), F.col("v").alias("src"), none("long").alias("dst"), *(none("long").alias(n) for n in weights)))

    def found(t: pa.Table):
        t = t.combine_chunks()
        get = lambda rows, *cols: tuple(rows.column(c).to_numpy() for c in cols)
        kind = t.column("kind").to_numpy()
        edge, s, b = (t.filter(pa.array(kind == k)) for k in (0, 1, 2))
        near = {}
        for n, name in enumerate(names):
            near[n] = get(edge.filter(pa.compute.is_valid(edge.column(name))), "pid", "src", "dst", name)
        for c in np.unique(edge.column("cri").to_numpy()) if not names else ():
            near[int(c)] = get(edge.filter(pa.compute.equal(edge.column("cri"), int(c))), "pid", "src", "dst", "w")
        pid = np.unique(t.column("pid").to_numpy())
        for columns in _searched(pid, near, get(s, "pid", "src"), get(b, "pid", "src"), pruned):
            for i in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000], k) for x, k in zip(columns, out.types)], schema=out)

    out = pa.schema([("pid", pa.int32()), ("cri", pa.int32()), ("s", pa.int64()), ("b", pa.int64()), ("dist", pa.int64())])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER and held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
                t = pa.Table.from_batches(held)
                pid = t.column("pid").to_numpy()
                cut = int(np.searchsorted(pid, pid[-1]))  # the last partition may go on
                yield from found(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), len(pid) - cut
        if n:
            yield from found(pa.Table.from_batches(held))

    return rows.repartition("pid").sortWithinPartitions("pid").mapInArrow(run, "pid int, cri int, s long, b long, dist long")


def shortcuts_long(long: DataFrame, partitions: DataFrame, found: DataFrame, pruned: bool = True) -> DataFrame:
    """pid, cri, s, b, dist between boundary vertices of a partition.

    Pruned: a pair stays if under some criterion no shortest path between them passes
    another boundary vertex; then its distances under all criteria stay.
    """
    return local_distances(long, partitions, found.select("v", "pid"), found.select("v", "pid"), pruned)


def shortcuts(long: DataFrame, partitions: DataFrame, found: DataFrame, criteria: int, pruned: bool = True) -> DataFrame:
    """pid, src, dst, weights: overlay edges, those inside partitions and the graph's own between partitions."""
    inside = shortcuts_long(long, partitions, found, pruned)
    inside = inside.select("pid", F.col("s").alias("src"), F.col("b").alias("dst"), "cri", F.col("dist").alias("w"))
    across = with_pids(long, partitions).where("ps <> pd")
    across = (stacked(across, "ps") if wide_columns(long) else across).select(F.col("ps").alias("pid"), "src", "dst", "cri", "w")
    picks = [F.max(F.when(F.col("cri") == c, F.col("w"))) for c in range(criteria)]
    return inside.unionByName(across).groupBy("pid", "src", "dst").agg(F.array(*picks).alias("weights"))


def overlay_long(short: DataFrame) -> DataFrame:
    return short.select("src", "dst", F.posexplode("weights").alias("cri", "w")).where("w is not null").select("cri", "src", "dst", "w")


def overlay_wide(short: DataFrame, criteria: int) -> DataFrame:
    """src, dst, w0, w1, ..: a row for all criteria of an overlay edge."""
    return short.select("src", "dst", *(F.col("weights")[c].alias(f"w{c}") for c in range(criteria)))


def overlay_search(edges: DataFrame, partitions: DataFrame, short: DataFrame, found: DataFrame, od: DataFrame, criteria: int, both: bool = False, strategy: str = "loop") -> DataFrame:
    """query_id, cri, cost by local searches at both ends, over long or wide edges, and a search over the overlay between them."""
    od = checkpointed(od.select("query_id", "s", "t"))  # several joins read it
    p = partitions.select("v", "pid")
    ends = od.join(p.withColumnsRenamed({"v": "s", "pid": "ps"}), "s").join(p.withColumnsRenamed({"v": "t", "pid": "pt"}), "t")
    starts = ends.select(F.col("s").alias("v"), F.col("ps").alias("pid")).unionByName(ends.select(F.col("t").alias("v"), F.col("pt").alias("pid"))).distinct()
    goals = found.select("v", "pid").unionByName(starts).distinct()
    local = checkpointed(local_distances(edges, partitions, starts, goals))
    rows = od.select("query_id", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(criteria - 1))).alias("cri"))
    edge = found.select(F.col("v").alias("b"))

    def labels(end: str, side: int) -> DataFrame:
        """A query's boundary labels from one of its ends; the end itself too, if it is one."""
        own = rows.join(local.select("cri", F.col("s").alias(end), "b", F.col("dist").alias("d")), ["cri", end]).join(edge, "b", "left_semi").select("query_id", "cri", F.col("b").alias("v"), "d")
        self_ = rows.join(edge.withColumnRenamed("b", end), end, "left_semi").select("query_id", "cri", F.col(end).alias("v"), F.lit(0).cast("long").alias("d"))
        return own.unionByName(self_).withColumn("side", F.lit(side))

    over = overlay_wide(short, criteria)
    last = labels("t", 1)
    if both:
        via = search.met(over, labels("s", 0).unionByName(last), od)
    else:
        via = search.joined(over, labels("s", 0).unionByName(last), **({} if strategy == "kernel" else {"limit": 0}))
    direct = rows.join(local.select("cri", "s", F.col("b").alias("t"), F.col("dist").alias("cost")), ["cri", "s", "t"]).select("query_id", "cri", "cost")
    best = via.unionByName(direct).groupBy("query_id", "cri").agg(F.min("cost").alias("cost"))
    return search._answers(od, criteria, best)
