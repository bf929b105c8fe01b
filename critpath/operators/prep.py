"""Cleaning and preparation of edge tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critpath.functions.ids import ranked, running
from critpath.operators.components import components


def clean(edges: DataFrame) -> DataFrame:
    """Edges (u, v, weights, ...) without self-loops; a weight that isn't positive is an error."""
    ok = F.forall("weights", lambda w: w.isNull() | (w > 0))
    edges = edges.where("u <> v")
    return edges.withColumn("weights", F.when(ok, F.col("weights")).otherwise(F.raise_error(F.lit("a weight is not positive"))))


def check_bounds(edges: DataFrame, n: int) -> DataFrame:
    """The same edges; an id outside 0..n-1 is an error."""
    ok = F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1)
    return edges.withColumn("u", F.when(ok, F.col("u")).otherwise(F.raise_error(F.lit("a vertex id is out of bounds"))))


def shift_ids(edges: DataFrame, by: int, missing: int | None = None) -> DataFrame:
    """Ids moved by a constant (1-based files: -1); a weight w of the value `missing` becomes null."""
    moved = edges.withColumns({"u": F.col("u") + by, "v": F.col("v") + by})
    return moved if missing is None else moved.withColumn("w", F.when(F.col("w") != missing, F.col("w")))


def dedup(edges: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """u < v, weights: one edge for each undirected pair, the first or last in `order`, whichever way it was given."""
    pick = F.min_by if keep == "first" else F.max_by
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weights", order)
    return pairs.groupBy("u", "v").agg(pick("weights", order).alias("weights"))


def mirror(undirected: DataFrame) -> DataFrame:
    """src, dst, weights in both directions."""
    forth = undirected.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weights")
    return forth.unionByName(undirected.select(F.col("v").alias("src"), F.col("u").alias("dst"), "weights"))


def check_symmetric(edges: DataFrame) -> DataFrame:
    """Directed edges whose mirror is missing or weighs otherwise: none in a sound graph."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weights")
    return edges.join(back, (edges["src"] == back["src"]) & (edges["dst"] == back["dst"]) & edges["weights"].eqNullSafe(back["weights"]), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """v, degree of a mirrored edge table."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Vertices, directed edges, and the largest, smallest and mean degree (a whole number, rounded down)."""
    d = degrees(edges)
    return d.agg(
        F.count("*").alias("n_vertices"),
        F.sum("degree").alias("n_edges"),
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
        F.floor(F.sum("degree") / F.count("*")).alias("avg_degree"),
    )


def base_weights(undirected: DataFrame) -> DataFrame:
    """u, v, w: heavier between vertices of low degree, 2 * max degree div (sum of both degrees), at least 1."""
    d = degrees(mirror(undirected.withColumn("weights", F.lit(None).cast("array<int>"))))
    top = d.agg(F.max("degree").alias("top"))
    du, dv = d.select(F.col("v").alias("u"), F.col("degree").alias("du")), d.select("v", F.col("degree").alias("dv"))
    joined = undirected.select("u", "v").join(du, "u").join(dv, "v").join(F.broadcast(top))  # top is one row
    return joined.select("u", "v", F.greatest(F.lit(1), F.expr("2 * top div (du + dv)")).cast("long").alias("w"))


def bounded(w: Column, least: int) -> Column:
    return F.greatest(w.cast("int"), F.lit(least))


def derive_criteria(
    base: DataFrame, least: int, most: int, noise: Sequence[Column], uniform: Column, sigma_percent: int = 10, factors: tuple[float, float] = (2, 1), second: Column | None = None
) -> DataFrame:
    """u, v, weights of five criteria from one base weight w of each undirected edge.

    base; correlated around twice and around once the base (`factors`); anti-correlated; independent. With `second`
    that column of base is the second criterion. The earlier form has factors 0.5 and 0.7 and a sigma of 20 %.
    `noise` gives three standard normal draws (or any other columns) and `uniform` one in
    [0, 1). Draw before mirroring, so that both directions agree.
    """
    w, s = F.col("w"), sigma_percent / 100
    n1, n2, n3 = noise
    return base.select(
        "u",
        "v",
        F.array(
            w.cast("int"),
            bounded((factors[0] + s * n1) * w, least) if second is None else second.cast("int"),
            bounded((factors[1] + s * n2) * w, least),
            bounded(1000 * (most - (1 + s * n3) * w) / most, least),
            (least + (1000 * uniform * (most - least) / most).cast("int")).cast("int"),
        ).alias("weights"),
    )


def drawn(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on the seed and the keys' values alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def drawn_normal(seed: int, *keys: str) -> Column:
    """A standard normal number, likewise."""
    return F.sqrt(-2 * F.log(drawn(2 * seed, *keys))) * F.cos(2 * math.pi * drawn(2 * seed + 1, *keys))


def random_criteria(base: DataFrame, least: int, most: int, seed: int = 1, sigma_percent: int = 10, **how) -> DataFrame:
    """derive_criteria with draws that an edge's ends decide, so reruns, shuffles and both directions agree."""
    return derive_criteria(base, least, most, [drawn_normal(4 * seed + i, "u", "v") for i in range(3)], drawn(8 * seed + 7, "u", "v"), sigma_percent, **how)


def pivot_layers(layered: DataFrame, layers: Sequence, order: str = "line") -> DataFrame:
    """u, v, weights from rows (layer, u, v, w): one criterion a layer, the last row in `order` wins; self-loops and w <= 0 go."""
    wide = layered.where("u <> v and w > 0").groupBy("u", "v")
    picks = [F.max_by(F.when(F.col("layer") == x, F.col("w")), F.when(F.col("layer") == x, F.col(order))).cast("int") for x in layers]
    return wide.agg(F.array(*picks).alias("weights"))


def join_criteria(first: DataFrame, second: DataFrame) -> DataFrame:
    """u, v, weights from two single-criterion tables (u, v, w); an edge that one of them lacks is an error."""
    a, b = (t.select("u", "v", F.col("w").cast("int").alias(f"w{i}"), F.lit(True).alias(f"in{i}")) for i, t in enumerate((first, second)))
    joined = a.join(b, ["u", "v"], "full")
    whole = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    u = F.when(whole, F.col("u")).otherwise(F.raise_error(F.lit("an edge is in one of the two tables only")).cast("long"))
    return joined.select(u.alias("u"), "v", F.array("w0", "w1").alias("weights"))


def merge_criteria(first: DataFrame, second: DataFrame) -> DataFrame:
    """u, v, weights: each edge (u, v, w) of the first table, with its weight in the second or null; of repeated rows the largest."""
    b = second.groupBy("u", "v").agg(F.max("w").cast("int").alias("w1"))
    return first.join(b, ["u", "v"], "left").select("u", "v", F.array(F.col("w").cast("int"), "w1").alias("weights"))


def prefix_offsets(edges: DataFrame) -> DataFrame:
    """v, degree, offset: where a vertex's edges begin in a list of all, by ascending vertex."""
    return running(degrees(edges), "degree", "v", name="offset")


def component_labels(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex of its component, of a mirrored edge table."""
    found = components(edges.where("src > dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return found.select(F.col("node").alias("v"), F.col("root").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest component; of equal ones, of that with the smallest vertex."""
    labels = component_labels(edges)
    best = component_sizes(labels).orderBy(F.desc("size"), "label").limit(1).select("label")
    inside = labels.join(F.broadcast(best), "label").select(F.col("v").alias("src"))  # best is one row
    return edges.join(inside, "src", "left_semi").select("src", "dst", "weights")


def partition_components(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """pid, v, label: components inside each partition."""
    p = partitions.select("v", "pid")
    a, b = p.withColumnsRenamed({"v": "src", "pid": "ps"}), p.withColumnsRenamed({"v": "dst", "pid": "pd"})
    inner = edges.join(a, "src").join(b, "dst").where("ps = pd")
    labels = component_labels(inner.select("src", "dst"))
    return p.join(labels, "v", "left").select("pid", "v", F.coalesce("label", "v").alias("label"))


def relabel_dense(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over ids 0..n-1, in ascending order of the old ids, and the table (orig_id, v)."""
    ids = ranked(edges.select(F.col("src").alias("orig_id")).distinct(), "orig_id", name="v")
    a, b = ids.withColumnsRenamed({"orig_id": "src", "v": "a"}), ids.withColumnsRenamed({"orig_id": "dst", "v": "b"})
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weights"), ids


def criteria_range(long: DataFrame) -> DataFrame:
    """cri, min_w, max_w, n of long edges."""
    return long.groupBy("cri").agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.count("*").alias("n"))


def category_bitmask(long: DataFrame) -> DataFrame:
    """v, cri, mask: bit c + 1 is set if a weight of category c leaves the vertex; bit 0 is kept free for marking."""
    from critpath.functions.weights import category

    bit = F.expr("shiftleft(1L, 1 + cat)")
    return long.withColumn("cat", category(F.col("w"))).groupBy(F.col("src").alias("v"), "cri").agg(F.bit_or(bit).alias("mask"))


def category_pools(long: DataFrame) -> DataFrame:
    """cri, cat, lower, n_pools: for each criterion the categories 0.. up to that of its largest weight, each with its least weight."""
    from critpath.functions.weights import category

    top = long.groupBy("cri").agg((category(F.max("w")) + 1).alias("n_pools"))
    pools = top.select("cri", "n_pools", F.explode(F.sequence(F.lit(0), F.col("n_pools") - 1)).alias("cat"))
    return pools.select("cri", "cat", F.expr("shiftleft(1L, cat)").alias("lower"), "n_pools")
