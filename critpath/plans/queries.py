"""Registered queries of the engine, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.functions import weights as W
from critpath.operators import boundary as B
from critpath.operators import cluster, metrics, paths, prep, search, workload
from critpath.plans import oracles as O
from critpath.runtime import checkpointed, give_back, shared_folder
from critpath.sources import graphs, writers
from critpath.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Vertices in a partition of the grid, for queries on given partitions.
PART = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def wide(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """Weight vectors as columns w0, w1, ..."""
    return df.select(*keys, *(F.col("weights")[i].cast("long").alias(f"w{i}") for i in range(k)))


def grid_edges(spark: SparkSession, d: str) -> DataFrame:
    return prep.mirror(graphs.grid(spark, d))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    return prep.mirror(graphs.supply(spark, d))


def grid_parts(edges: DataFrame, size: int = PART, own: DataFrame | None = None) -> DataFrame:
    v = workload.vertices(edges) if own is None else own
    return v.select("v", F.expr(f"cast(v div {size} as int)").alias("pid"), F.col("v").alias("pos"))


# ---- cleaning and preparation


@query(f"with {O.LAYERED} select u, v, k as layer, w, cast(event_id as bigint) line from l_ where w > 0")
def edges_clean(spark, d):
    e = graphs.event_layers(spark, d).withColumn("weights", F.array("w"))
    return prep.clean(e.where("w > 0")).select("u", "v", "layer", F.col("w").cast("long").alias("w"), F.col("line").cast("long").alias("line"))


@query(f"with {O.LAYERED} select u, v, cast(arg_min(w, event_id) as bigint) w from l_ group by u, v")
def edges_dedup_first(spark, d):
    e = graphs.event_layers(spark, d).withColumn("weights", F.array("w"))
    return prep.dedup(e, "line").select("u", "v", F.col("weights")[0].cast("long").alias("w"))


@query(f"with {O.LAYERED} select u, v, cast(arg_max(w, event_id) as bigint) w from l_ group by u, v")
def edges_dedup_last(spark, d):
    e = graphs.event_layers(spark, d).withColumn("weights", F.array("w"))
    return prep.dedup(e, "line", keep="last").select("u", "v", F.col("weights")[0].cast("long").alias("w"))


@query(f"with {O.SUPPLY} select u src, v dst, w0, w1, w2, w3, w4 from g union all select v, u, w0, w1, w2, w3, w4 from g")
def edges_mirror(spark, d):
    return wide(supply_edges(spark, d), 5, "src", "dst")


@query(f"with {O.SUPPLY}, {O.BOTH} select v, d as degree from deg")
def vertex_degree(spark, d):
    return prep.degrees(supply_edges(spark, d))


@query(f"with {O.SUPPLY}, {O.BOTH} select count(*) n_vertices, cast(sum(d) as bigint) n_edges, max(d) max_degree, min(d) min_degree, cast(sum(d) // count(*) as bigint) avg_degree from deg")
def degree_stats(spark, d):
    return prep.degree_stats(supply_edges(spark, d))


@query(f"with {O.GRID}, {O.BOTH} select g.u, g.v, cast(greatest(1, 2 * (select max(d) from deg) // (a.d + b.d)) as bigint) w from g join deg a on a.v = g.u join deg b on b.v = g.v")
def base_weight(spark, d):
    return prep.base_weights(graphs.grid(spark, d))


@query(f"with {O.MULTIPLEX} select u, v, w0, w1, w2, w3, w4 from g")
def multiplex_pivot(spark, d):
    return wide(graphs.multiplex(spark, d), 5, "u", "v")


@query(f"with {O.LAYERED} select k as layer, count(distinct (u, v)) n_edges from l_ where w > 0 group by k")
def layer_counts(spark, d):
    return graphs.event_layers(spark, d).where("w > 0").groupBy("layer").agg(F.countDistinct("u", "v").alias("n_edges"))


@query(f"with {O.SUPPLY} select u, v, w0, w1, w2 from g")
def criteria_project(spark, d):
    e = graphs.supply(spark, d)
    return wide(e.withColumn("weights", W.project(F.col("weights"), 3)), 3, "u", "v")


@query(f"with {O.GRID}, {O.long(3, 3)} select cast(c as bigint) cri, min(w) min_w, max(w) max_w, count(*) n from el group by c")
def criteria_minmax(spark, d):
    r = prep.criteria_range(W.edges_long(grid_edges(spark, d)))
    return r.select(F.col("cri").cast("long").alias("cri"), "min_w", "max_w", "n")


_NOISE = [f"(((u * {a} + v * {b}) % 21) - 10) / 10.0" for a, b in ((7, 3), (5, 11), (13, 2))]
_UNIFORM = "((u * 31 + v * 17) % 100) / 100.0"


def _noise_sql(e: str) -> str:
    return f"cast({e.split(' / ')[0]} as double) / {e.split(' / ')[1]}"


@query(
    f"""with {O.GRID}, r as (select min(w0) lo, max(w0) hi from g), x as (select u, v, cast(w0 as double) w, lo, hi,
    {_noise_sql(_NOISE[0])} n0, {_noise_sql(_NOISE[1])} n1, {_noise_sql(_NOISE[2])} n2, {_noise_sql(_UNIFORM)} f from g, r)
    select u, v, cast(w as bigint) w0, greatest(cast(trunc((2 + cast(0.1 as double) * n0) * w) as bigint), lo) w1, greatest(cast(trunc((1 + cast(0.1 as double) * n1) * w) as bigint), lo) w2,
    greatest(cast(trunc(1000 * (hi - (1 + cast(0.1 as double) * n2) * w) / hi) as bigint), lo) w3, cast(lo + trunc(1000 * f * (hi - lo) / hi) as bigint) w4 from x"""
)
def criteria_corr_deterministic(spark, d):
    base = graphs.grid(spark, d).select("u", "v", F.col("weights")[0].cast("long").alias("w"))
    r = base.agg(F.min("w"), F.max("w")).first()
    return wide(prep.derive_criteria(base, r[0], r[1], [F.expr(f"cast({e.split(' / ')[0]} as double) / 10.0D") for e in _NOISE], F.expr("cast((u * 31 + v * 17) % 100 as double) / 100.0D")), 5, "u", "v")


@query(
    f"""with {O.GRID}, r as (select min(w0) lo, max(w0) hi from g), x as (select u, v, cast(w0 as double) w, lo, hi,
    {_noise_sql(_NOISE[0])} n0, {_noise_sql(_NOISE[1])} n1, {_noise_sql(_NOISE[2])} n2, {_noise_sql(_UNIFORM)} f from g, r)
    select u, v, cast(w as bigint) w0, greatest(cast(trunc((cast(0.5 as double) + cast(0.2 as double) * n0) * w) as bigint), lo) w1, greatest(cast(trunc((cast(0.7 as double) + cast(0.2 as double) * n1) * w) as bigint), lo) w2,
    greatest(cast(trunc(1000 * (hi - (1 + cast(0.2 as double) * n2) * w) / hi) as bigint), lo) w3, cast(lo + trunc(1000 * f * (hi - lo) / hi) as bigint) w4 from x"""
)
def criteria_earlier_form(spark, d):
    base = graphs.grid(spark, d).select("u", "v", F.col("weights")[0].cast("long").alias("w"))
    r = base.agg(F.min("w"), F.max("w")).first()
    noise = [F.expr(f"cast({e.split(' / ')[0]} as double) / 10.0D") for e in _NOISE]
    return wide(prep.derive_criteria(base, r[0], r[1], noise, F.expr("cast((u * 31 + v * 17) % 100 as double) / 100.0D"), 20, (0.5, 0.7)), 5, "u", "v")


_TERMS = "(33 * w0)", "(33 * w1)", "(33 * w2)"
for _how, _sql in {
    "pri": "w0",
    "ave": "cast(ceil((w0 + w1 + w2 + w3 + w4) / 5.0) as bigint)",
    "wave": "(33 * w0 + 33 * w1 + 33 * w2 + 99) // 100",
    "wave_trunc": "(((33 * w0) // 100) * 100 + 33 * w1) // 100 + 0 * w2",
}.items():
    if _how == "wave_trunc":
        _sql = "((((33 * w0) // 100 * 100 + 33 * w1) // 100) * 100 + 33 * w2) // 100"

    def _agg(spark, d, how=_how):
        return cluster.weighted(supply_edges(spark, d), how)

    _agg.__name__ = f"agg_weight_{_how}"
    query(f"with {O.SUPPLY} select least(u, v) u, greatest(u, v) v, cast({_sql} as bigint) w from g")(_agg)


def _two_graphs(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the multiplex graph and of the grid, whose ids are turned into negative ones: a graph of two components at least."""
    grid = graphs.grid(spark, d).select((-1 - F.col("v")).alias("u"), (-1 - F.col("u")).alias("v"), "weights")
    return prep.mirror(graphs.multiplex(spark, d).select("u", "v", "weights").unionByName(grid))


@query(O.components(O.TWO_GRAPHS) + " select v, l as label from lab")
def component_labels(spark, d):
    return prep.component_labels(_two_graphs(spark, d))


@query(O.components(O.TWO_GRAPHS) + " select l as label, count(*) size from lab group by l")
def component_sizes(spark, d):
    return prep.component_sizes(prep.component_labels(_two_graphs(spark, d)))


@query(O.components(O.TWO_GRAPHS) + ", big as (select l from lab group by l order by count(*) desc, l limit 1) select s src, t dst from e2 join lab on lab.v = e2.s join big on big.l = lab.l")
def largest_component(spark, d):
    return prep.largest_component(_two_graphs(spark, d)).select("src", "dst")


@query(f"with {O.SUPPLY}, {O.BOTH}, ids as (select v, row_number() over (order by v) - 1 x from vs) select a.x src, b.x dst, w0, w1, w2, w3, w4 from (select * from g union all select v, u, w0, w1, w2, w3, w4 from g) h join ids a on a.v = h.u join ids b on b.v = h.v")
def relabel_dense(spark, d):
    return wide(prep.relabel_dense(supply_edges(spark, d))[0], 5, "src", "dst")


@query(
    f"with recursive {O.GRID}, v0 as (select u v from g union select v from g), pt as (select v, v % 7 pid from v0), b0 as (select u s, v t from g union all select v, u from g), "
    "e2 as (select b0.* from b0 join pt a on a.v = b0.s join pt b on b.v = b0.t where a.pid = b.pid), vs as (select v from v0), "
    + O.COMPONENTS
    + " select cast(pt.pid as bigint) pid, pt.v, l as label from lab join pt on pt.v = lab.v"
)
def partition_components(spark, d):
    e = grid_edges(spark, d)
    p = workload.vertices(e).select("v", (F.col("v") % 7).cast("int").alias("pid"))
    return prep.partition_components(e, p).select(F.col("pid").cast("long").alias("pid"), "v", "label")


@query(f"with {O.SUPPLY}, {O.long(5, 5)} select cast(c as bigint) cri, cast(floor(log2(w)) as bigint) cat, count(*) n from el group by 1, 2")
def weight_category(spark, d):
    e = W.edges_long(supply_edges(spark, d)).groupBy(F.col("cri").cast("long").alias("cri"), W.category(F.col("w")).cast("long").alias("cat"))
    return e.agg(F.count("*").alias("n"))


@query(f"with {O.SUPPLY}, {O.long(5, 5)} select s v, cast(c as bigint) cri, cast(bit_or(cast(1 as bigint) << (1 + cast(floor(log2(w)) as int))) as bigint) mask from el group by s, c")
def category_bitmask(spark, d):
    return prep.category_bitmask(W.edges_long(supply_edges(spark, d))).select("v", F.col("cri").cast("long").alias("cri"), "mask")


# ---- searches


@query(O.sssp(O.SUPPLY, 5, 5, 0))
def sssp_single(spark, d):
    found = search.sssp(W.edges_wide(supply_edges(spark, d), 5), 0, 5, strategy="loop")
    return found.select(F.col("cri").cast("long").alias("cri"), "v", "d")


@query(O.sssp(O.GRID, 3, 3, 0))
def sssp_grid(spark, d):
    found = search.sssp(W.edges_wide(grid_edges(spark, d), 3), 0, 3)
    return found.select(F.col("cri").cast("long").alias("cri"), "v", "d")


def _supply_near(spark: SparkSession, d: str, k: int) -> Callable[[DataFrame], DataFrame]:
    """For search.within: whole components of the supply graph, whose line items are found by supplier."""
    return lambda v: W.edges_wide(prep.mirror(graphs.supply(spark, d, v)), k)


def _multiplex_mcsp(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    give_back(spark)  # what earlier queries of the session left in the driver's heap counts as this one's memory
    layered = graphs.event_layers(spark, d)
    od = checkpointed(workload.arithmetic_pairs(layered, 6, graphs.multiplex_vertices(layered)))
    give_back(spark)  # plans and figures of the ranking
    edges = prep.mirror(graphs.multiplex(spark, d, layered))
    return _costs(search.mcsp(W.edges_wide(edges, 5), od, 5, strategy))


def _supply_mcsp(spark: SparkSession, d: str, k: int, strategy: str) -> DataFrame:
    edges = supply_edges(spark, d)
    od = workload.arithmetic_pairs(edges, 6, graphs.supply_vertices(spark, d))
    return _costs(search.mcsp(W.edges_wide(edges, k), od, k, strategy, _supply_near(spark, d, k)))


def _costs(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("cri").cast("long").alias("cri"), "cost")


for _strategy in ("one_pass", "multi_pass", "bidirectional", "bucketed", "kernel", "kernel_bidirectional"):

    def _search(spark, d, strategy=_strategy):
        return _supply_mcsp(spark, d, 3, strategy)

    _search.__name__ = f"mcsp_{_strategy}"
    query(O.mcsp(O.SUPPLY, 5, 3, 6))(_search)

for _k in (2, 4, 5):

    def _search(spark, d, k=_k):
        return _supply_mcsp(spark, d, k, "auto")

    _search.__name__ = f"mcsp_k{_k}"
    query(O.mcsp(O.SUPPLY, 5, _k, 6))(_search)


@query(O.mcsp(O.MULTIPLEX, 5, 5, 6))
def mcsp_multiplex(spark, d):
    return _multiplex_mcsp(spark, d, "one_pass")


def _overlay(spark, d, **how) -> DataFrame:
    e = grid_edges(spark, d)
    parts = checkpointed(grid_parts(e))
    e = checkpointed(B.with_pids(W.edges_wide(e, 3), parts))
    found = checkpointed(B.boundary(e, parts))
    short = B.shortcuts(e, parts, found, 3)
    r = B.overlay_search(e, parts, short, found, workload.arithmetic_pairs(e, 6, parts.select("v")), 3, **how)
    return r.select("query_id", F.col("cri").cast("long").alias("cri"), "cost")


@query(O.mcsp(O.GRID, 3, 3, 6))
def mcsp_overlay_uni(spark, d):
    return _overlay(spark, d, strategy="kernel")


@query(O.mcsp(O.GRID, 3, 3, 6))
def mcsp_overlay_bi(spark, d):
    return _overlay(spark, d, both=True)


# ---- a graph on disk


def _store(spark, d, shortcuts: bool = False, size: int = PART) -> Store:
    """The grid by partitions of ids, written to the shared folder."""
    store = Store(spark, shared_folder(spark), 3)
    e = grid_edges(spark, d)
    p = store.table("partitions", lambda: grid_parts(e, size))
    store.edges(e, p)
    if shortcuts:
        store.shortcuts(W.edges_long(e), p, store.boundary(e, p))
    return store


_SCAN = f"with {O.GRID}, {O.BOTH}, {O.grid_parts(PART)}, {O.long(3, 3)}"


@query(O.mcsp(O.GRID, 3, 3, 6))
def mcsp_stored(spark, d):
    r = search.stored(_store(spark, d, size=8 * PART), workload.arithmetic_pairs(grid_edges(spark, d), 6), 3)
    return r.select("query_id", F.col("cri").cast("long").alias("cri"), "cost")


@query(_SCAN + " select cast(c as bigint) cri, s src, t dst, w from el join pt on pt.v = el.s where pid in (1, 2) and c < 2")
def partition_scan(spark, d):
    return _store(spark, d).scan([1, 2], k=2).select(F.col("cri").cast("long").alias("cri"), "src", "dst", "w")


@query(_SCAN + " select cast(c as bigint) cri, s src, t dst, w from el join pt on pt.v = el.s where pid = 1 union all select c, t, s, w from el join pt on pt.v = el.s where pid = 1")
def partition_scan_both(spark, d):
    return _store(spark, d).scan([1], both=True).select(F.col("cri").cast("long").alias("cri"), "src", "dst", "w")


@query(_SCAN + " select s src, t dst, w, cast(floor(log2(w)) as bigint) cat from el join pt on pt.v = el.s where pid = 1 and c = 2")
def category_scan(spark, d):
    return _store(spark, d).scan_category(2, [1]).select("src", "dst", "w", F.col("cat").cast("long").alias("cat"))


@query(
    O.local_labels(PART, "select v from bd")
    + """, keep as (select distinct s, b from full_ f where not exists (select 1 from full_ x join full_ y on y.s = x.b and y.c = x.c
        where x.s = f.s and x.c = f.c and y.b = f.b and x.b <> f.b and x.dist + y.dist = f.dist))
    select cast(c as bigint) cri, s src, b dst, cast(dist as bigint) w from full_ join keep using (s, b) where pid = 1
    union all select cast(c as bigint), el.s, el.t, w from el join pt a on a.v = el.s join pt b on b.v = el.t where a.pid = 1 and b.pid <> 1"""
)
def shortcut_scan(spark, d):
    return _store(spark, d, shortcuts=True).scan_shortcuts([1]).select(F.col("cri").cast("long").alias("cri"), "src", "dst", "w")


@query(f"with {O.GRID}, {O.long(3, 3)} select s v, cast(c as bigint) cri, cast(bit_or(cast(1 as bigint) << (1 + cast(floor(log2(w)) as int))) as bigint) mask from el group by s, c")
def category_index(spark, d):
    store = _store(spark, d)
    store.categories(store.scan())
    return store.saved("categories").select("v", F.col("cri").cast("long").alias("cri"), "mask")


@query(
    f"with {O.SUPPLY}, {O.long(5, 5)}, top_ as (select c, 1 + cast(floor(log2(max(w))) as bigint) n from el group by c) "
    "select cast(c as bigint) cri, cast(x.range as bigint) cat, cast(1 as bigint) << cast(x.range as int) as lower, n n_pools from top_, range(64) x where x.range < n"
)
def category_pools(spark, d):
    return prep.category_pools(W.edges_long(supply_edges(spark, d))).select(*(F.col(c).cast("long").alias(c) for c in ("cri", "cat", "lower", "n_pools")))


@query(f"with {O.SUPPLY}, {O.BOTH} select v, d as degree, cast(coalesce(sum(d) over (order by v rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from deg")
def prefix_offsets(spark, d):
    return prep.prefix_offsets(supply_edges(spark, d)).select("v", "degree", F.col("offset").cast("long").alias("offset"))


# ---- partitions

_FOLD = f"with recursive {O.SUPPLY}, {O.BOTH}, {O.fold('select v, d, row_number() over (order by v) - 1 pos from deg', 2000)}"


def _packed(spark, d) -> DataFrame:
    from critpath.functions.ids import ranked

    return cluster.pack(ranked(prep.degrees(supply_edges(spark, d)), "v"), 2000)


@query(_FOLD + " select o.v, r.pid, r.pos from r join o on o.pos = r.pos")
def partition_pack(spark, d):
    return _packed(spark, d).select("v", F.col("pid").cast("long").alias("pid"), "pos")


@query(_FOLD + " select r.pid, count(*) n_vertices, string_agg(cast(o.v as varchar), ' ' order by r.pos) vertices from r join o on o.pos = r.pos group by r.pid")
def partition_info(spark, d):
    p = cluster.partition_info(_packed(spark, d))
    return p.select(F.col("pid").cast("long").alias("pid"), "n_vertices", F.concat_ws(" ", F.transform("vertices", lambda v: v.cast("string"))).alias("vertices"))


@query(f"with recursive {O.TREE} select u, v, w from tree")
def mst_edges(spark, d):
    return cluster.spanning_tree(cluster.weighted(grid_edges(spark, d)))


@query()
def mst_prim(spark, d):
    return cluster.spanning_tree(cluster.weighted(grid_edges(spark, d)), "prim")


@query(f"with recursive {O.PREORDER} select v, pos from ord")
def preorder(spark, d):
    return cluster.preorder(cluster.spanning_tree(cluster.weighted(grid_edges(spark, d))))


@query(f"with recursive {O.PREORDER} select v, pos from ord")
def euler_ranks(spark, d):
    return cluster.list_ranks(cluster.euler_tour(cluster.spanning_tree(cluster.weighted(grid_edges(spark, d)))))


@query(f"with recursive {O.PREORDER}, {O.fold('select ord.v, ord.pos, deg.d from ord join deg on deg.v = ord.v', cluster.capacity(4))} select o.v, cast(r.pid as integer) pid, o.pos from r join o on o.pos = r.pos")
def graph_partition(spark, d):
    return cluster.partition(grid_edges(spark, d), partition_kb=4)


@query(f"with {O.boundary(PART)}, i_ as (select x_.s, bool_and(bd.v is not null) f from x_ left join bd on bd.v = x_.t where ps = pd group by x_.s) select bd.v, bd.pid, cast(case when coalesce(i_.f, true) then 2 else 1 end as bigint) tag from bd left join i_ on i_.s = bd.v")
def boundary_vertices(spark, d):
    e = grid_edges(spark, d)
    return B.boundary(e, grid_parts(e)).select("v", F.col("pid").cast("long").alias("pid"), F.col("tag").cast("long").alias("tag"))


@query(f"with {O.boundary(PART)}, n_ as (select pid, count(*) n from bd group by pid) select cast(sum(n) as bigint) n_boundary, cast(sum(n) // count(*) as bigint) avg_boundary, max(n) max_boundary from n_")
def boundary_stats(spark, d):
    e = grid_edges(spark, d)
    return B.boundary_stats(B.boundary(e, grid_parts(e)))


@query(O.local_labels(PART, "select v from bd") + " select cast(pid as bigint) pid, cast(c as bigint) cri, s, b, cast(dist as bigint) dist from full_")
def shortcuts_full(spark, d):
    return _shortcuts(spark, d, False)


@query(
    O.local_labels(PART, "select v from bd")
    + """, keep as (select distinct s, b from full_ f where not exists (select 1 from full_ x join full_ y on y.s = x.b and y.c = x.c
        where x.s = f.s and x.c = f.c and y.b = f.b and x.b <> f.b and x.dist + y.dist = f.dist))
    select cast(pid as bigint) pid, cast(c as bigint) cri, s, b, cast(dist as bigint) dist from full_ join keep using (s, b)"""
)
def shortcuts_pruned(spark, d):
    return _shortcuts(spark, d, True)


def _shortcuts(spark, d, pruned: bool) -> DataFrame:
    e = grid_edges(spark, d)
    p = grid_parts(e)
    s = B.shortcuts_long(W.edges_long(e), p, B.boundary(e, p), pruned)
    return s.select(F.col("pid").cast("long").alias("pid"), F.col("cri").cast("long").alias("cri"), "s", "b", "dist")


@query(O.local_labels(PART, "select v from pt") + " select cast(pid as bigint) pid, cast(c as bigint) cri, s, b, cast(dist as bigint) dist from full_")
def local_boundary_dist(spark, d):
    e = grid_edges(spark, d)
    p = grid_parts(e)
    s = B.local_distances(W.edges_long(e), p, p, B.boundary(e, p))
    return s.select(F.col("pid").cast("long").alias("pid"), F.col("cri").cast("long").alias("cri"), "s", "b", "dist")


# ---- query sets, metrics, paths, exports


@query(f"with {O.SUPPLY}, {O.BOTH}, {O.pairs(50)} select q query_id, s, t from od")
def od_random(spark, d):
    return workload.arithmetic_pairs(supply_edges(spark, d), 50)


_COVER = f"""with recursive {O.GRID}, {O.BOTH}, od as (select v q, v s from vs where v in (0, 77, 123)), {O.criteria(1)}, {O.long(1, 3)},
d(q, c, v, dist) using key (q, c, v) as (
  select q, c, s, cast(0 as bigint) from od, cs
  union
  select d.q, d.c, e.t, min(d.dist + e.w) from d join el e on e.s = d.v and e.c = d.c
    left join recurring.d r on r.v = e.t and r.c = e.c and r.q = d.q
  group by d.q, d.c, e.t, r.dist having min(d.dist + e.w) < coalesce(r.dist, 9223372036854775807)),
run as (select d.q s, d.v, deg.d, sum(deg.d) over (partition by d.q order by d.dist, d.v) cum, (select count(*) from e2) tot from d join deg on deg.v = d.v),
seen as (select * from run where (cum - d) * 100 < tot * 40),
near as (select s, v, case when cum >= 10 and cum * 100 < tot * 10 and v <> s then 'S' when cum * 100 >= tot * 10 and cum * 100 < tot * 40 then 'M' end qtype from seen),
cls as (select s, v, qtype from near where qtype is not null union all
  select od.s, vs.v, 'L' from od, vs where not exists (select 1 from seen where seen.s = od.s and seen.v = vs.v))"""


@query(_COVER + " select s, qtype, min(v) t, count(*) n from cls group by s, qtype")
def od_coverage_sml(spark, d):
    e = checkpointed(W.edges_wide(grid_edges(spark, d), 1))
    degree = checkpointed(prep.degrees(e))
    v = degree.select("v")
    start = v.where("v in (0, 77, 123)").select(F.col("v").alias("query_id"), F.lit(0).alias("cri"), "v", F.lit(0).cast("long").alias("d"))
    enough = -(-(degree.agg(F.sum("degree")).first()[0] or 0) * workload.MEDIUM_PERCENT // 100)  # no label beyond decides a class
    labels = search.labels_kernel(e, start, enough=enough).select(F.col("query_id").alias("s"), "v", "d")
    c = workload.coverage_classes(labels, e, v, degree=degree)
    return c.groupBy("s", "qtype").agg(F.min("v").alias("t"), F.count("*").alias("n"))


def _labels(spark, d, k: int = 3, n_pairs: int = 6):
    e = supply_edges(spark, d)
    own = graphs.supply_vertices(spark, d)
    od = checkpointed(workload.arithmetic_pairs(e, n_pairs, own))
    edges = search.within(W.edges_wide(e, k), od.select(F.col("s").alias("v")), _supply_near(spark, d, k))
    return e, od, search.labels_kernel(edges, search.seeds(od, k).drop("side"))


_SETTLED = O.searches(O.SUPPLY, 5, 3, 6) + """, goal as (select d.q, d.c, d.dist dt from d join od on od.q = d.q and od.t = d.v),
st as (select d.q, d.c, d.v, od.t from d join od on od.q = d.q left join goal on goal.q = d.q and goal.c = d.c where dt is null or dist < dt or (dist = dt and d.v <= od.t))"""


@query(_SETTLED + " select q query_id, cast(c as bigint) cri, count(*) visited from st group by q, c")
def visited_count(spark, d):
    _, od, labels = _labels(spark, d)
    return metrics.visited_count(labels, od).select("query_id", F.col("cri").cast("long").alias("cri"), "visited")


@query(_SETTLED + ", ps as (select distinct q, c, v // 100 pid from st where v <> t) select q query_id, count(distinct pid) n_partitions, count(*) - count(distinct pid) n_shared from ps group by q")
def partitions_touched(spark, d):
    e, od, labels = _labels(spark, d)
    return metrics.partitions_touched(labels, od, grid_parts(e, 100, graphs.supply_vertices(spark, d)))


@query(_SETTLED + " select q query_id, count(distinct v) n_union from st group by q")
def union_visited(spark, d):
    _, od, labels = _labels(spark, d)
    return metrics.union_visited(labels, od)


@query(
    _SETTLED
    + """, n_ as (select q, count(*) visited from st group by q), ps as (select distinct q, c, v // 100 pid from st where v <> t),
    sh as (select q, count(distinct pid) np, count(*) - count(distinct pid) ns from ps group by q),
    sz as (select v // 100 pid, (2 + sum(2 + 4 * d)) // 65536 + 1 nb from (select s v, count(*) d from e2 group by s) group by 1),
    bl as (select q, sum(nb) nb from (select distinct q, pid from ps) join sz using (pid) group by q)
    select avg(nb) avg_blocks, cast(sum(visited) // count(*) as bigint) avg_visited, cast(sum(ns) // count(*) as bigint) avg_shared, avg(np) avg_partitions from n_ join sh using (q) join bl using (q)"""
)
def avg_visited(spark, d):
    e, od, labels = _labels(spark, d)
    io = metrics.query_io(labels, od, e, grid_parts(e, 100, graphs.supply_vertices(spark, d)), 3)
    return metrics.averages(io.withColumn("seconds", F.lit(0.0))).select("avg_blocks", "avg_visited", "avg_shared", "avg_partitions")


@query(f"with {O.SUPPLY}, {O.BOTH}, i_ as (select v // 100 pid, cast(2 + sum(2 + 6 * d) as bigint) n_ints from deg group by 1) select cast(pid as bigint) pid, n_ints, cast(n_ints // 65536 + 1 as bigint) n_blocks from i_")
def io_blocks(spark, d):
    e = supply_edges(spark, d)
    return metrics.io_blocks(e, grid_parts(e, 100), 5).select(F.col("pid").cast("long").alias("pid"), "n_ints", "n_blocks")


@query(f'with rr as ({O.mcsp(O.MULTIPLEX, 5, 5, 6)}) select cri, count("cost") n_reached, avg("cost") avg_cost from rr group by cri')
def avg_cost(spark, d):
    return metrics.average_cost(_multiplex_mcsp(spark, d, "kernel"))


@query(f'with rr as ({O.mcsp(O.SUPPLY, 5, 5, 6)}) select cri, cast(sum(case when "cost" < 200 then "cost" else 0 end) // count(*) as bigint) avg_cost from rr group by cri')
def avg_cost_compat(spark, d):
    return metrics.average_cost_compat(_supply_mcsp(spark, d, 5, "kernel"), threshold=200)


@query(
    O.sssp(O.SUPPLY, 5, 2, 0).rsplit("\nselect", 1)[0]
    + """, pr as (select a.c, e.t v, min(e.s) pred from el e join d a on a.c = e.c and a.v = e.s join d b on b.c = e.c and b.v = e.t where a.dist + e.w = b.dist group by a.c, e.t),
    wk(c, t, v, back) as (select c, v, v, 0 from d where v in (7, 41, 100, 163) union all select wk.c, wk.t, pr.pred, wk.back + 1 from wk join pr on pr.c = wk.c and pr.v = wk.v where wk.v <> 0)
    select cast(c as bigint) cri, t, string_agg(cast(v + 1 as varchar), '-->' order by back desc) path from wk group by c, t"""
)
def sp_path(spark, d):
    long = W.edges_long(supply_edges(spark, d), 2)
    labels = search.sssp(long, 0, 2)
    targets = spark.createDataFrame([(x,) for x in (7, 41, 100, 163)], "t long")
    return paths.shown(paths.paths(long, labels, 0, targets)).select(F.col("cri").cast("long").alias("cri"), "t", "path")


@query(
    f"""with recursive {O.GRID}, {O.BOTH}, {O.criteria(2)}, {O.long(2, 3)}, od as (select v q, v s from vs where v in (0, 7, 61, 139, 199)),
    d(q, c, v, dist) using key (q, c, v) as (
      select q, c, s, cast(0 as bigint) from od, cs
      union
      select d.q, d.c, e.t, min(d.dist + e.w) from d join el e on e.s = d.v and e.c = d.c
        left join recurring.d r on r.v = e.t and r.c = e.c and r.q = d.q
      group by d.q, d.c, e.t, r.dist having min(d.dist + e.w) < coalesce(r.dist, 9223372036854775807)),
    mt as (select c, t, arg_min(v, (off, v)) m from (select a.c, b.q t, a.v, abs(a.dist - b.dist) off, a.dist + b.dist tot, min(a.dist + b.dist) over (partition by a.c, b.q) lo
      from d a join d b on b.c = a.c and b.v = a.v where a.q = 0 and b.q <> 0) where tot = lo group by c, t),
    pr as (select a.q, a.c, e.t v, min(e.s) pred from el e join d a on a.c = e.c and a.v = e.s join d b on b.c = e.c and b.v = e.t and b.q = a.q where a.dist + e.w = b.dist group by a.q, a.c, e.t),
    w1(c, t, v, back) as (select c, t, m, 0 from mt union all select w1.c, w1.t, pr.pred, w1.back + 1 from w1 join pr on pr.q = 0 and pr.c = w1.c and pr.v = w1.v where w1.v <> 0),
    w2(c, t, v, ahead) as (select c, t, m, 0 from mt union all select w2.c, w2.t, pr.pred, w2.ahead + 1 from w2 join pr on pr.q = w2.t and pr.c = w2.c and pr.v = w2.v where w2.v <> w2.t)
    select cast(c as bigint) cri, t, string_agg(cast(v + 1 as varchar), '-->' order by k) path from (select c, t, v, -back k from w1 union all select c, t, v, ahead from w2 where ahead > 0) group by c, t"""
)
def sp_path_bidirectional(spark, d):
    edges = checkpointed(W.edges_wide(grid_edges(spark, d), 2))
    ends = [r.src for r in edges.select("src").where("src in (0, 7, 61, 139, 199)").distinct().collect()]
    pairs = [(2 * t + k, *((0, t) if k == 0 else (t, 0))) for t in ends if t and 0 in ends for k in (0, 1)]  # query ids: even forward, odd back
    start = search.seeds(spark.createDataFrame(pairs, "query_id long, s long, t long"), 2).drop("side")
    start = start.join(spark.createDataFrame(pairs, "query_id long, s long, t long").drop("s"), "query_id")
    labels = search.labels_kernel(edges, start, targets=True, nearer=True)
    forward = checkpointed(labels.where("query_id % 2 = 0").select("cri", "v", "d").distinct())
    backward = labels.where("query_id % 2 = 1").select(F.expr("query_id div 2").alias("t"), "cri", "v", "d")
    long = W.stacked(edges)
    return paths.shown(paths.bidirectional_paths(long, forward, backward, 0)).select(F.col("cri").cast("long").alias("cri"), "t", "path")


_EXPORT = "x_ as (select least(u, v) u, greatest(u, v) v, ((((33 * w0) // 100 * 100 + 33 * w1) // 100) * 100 + 33 * coalesce(w2, 0)) // 100 w from g)"


@query(f"with {O.GRID}, {_EXPORT}, b_ as (select u, v, w from x_ union all select v, u, w from x_) select u v, string_agg(cast(v + 1 as varchar) || ' ' || cast(w as varchar), ' ' order by v) line from b_ group by u")
def export_metis_lines(spark, d):
    return writers.metis_lines(grid_edges(spark, d))


@query(f"with {O.GRID}, {_EXPORT} select u, v, cast(w as varchar) || ' ' || cast(u + 1 as varchar) || ' ' || cast(v + 1 as varchar) line from x_")
def export_hyper_lines(spark, d):
    return writers.hyper_lines(grid_edges(spark, d))


@query(f"with {O.GRID}, b_ as (select * from g union all select v, u, w0, w1, w2 from g) select u src, v dst, u || ' ' || v || ' ' || w0 || ' ' || w1 || ' ' || coalesce(w2, 1000000) line from b_")
def export_multi_lines(spark, d):
    return writers.multi_lines(grid_edges(spark, d))
