"""Query sets: arithmetic or random pairs, and pairs stratified by how much of the graph a search covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critpath.functions.ids import ranked


#: Per cent of the edges that a search relaxes before what is left is far.
MEDIUM_PERCENT = 40


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).distinct()


def arithmetic_pairs(edges: DataFrame, n_pairs: int, own: DataFrame | None = None) -> DataFrame:
    """query_id, s, t: the same pairs at every run, ids mapped to existing vertices (`own`, if known); pairs of one vertex are left out."""
    ids = ranked(vertices(edges) if own is None else own, "v")
    n = ids.count()
    i = F.col("id")
    rows = edges.sparkSession.range(n_pairs).select(i.alias("query_id"), ((i * 7919 + 13) % n).alias("ps"), ((i * 104729 + 7) % n).alias("pt"))
    a, b = ids.select(F.col("pos").alias("ps"), F.col("v").alias("s")), ids.select(F.col("pos").alias("pt"), F.col("v").alias("t"))
    return rows.join(a, "ps").join(b, "pt").where("s <> t").select("query_id", "s", "t")


def random_pairs(edges: DataFrame, n_pairs: int, seed: int = 1) -> DataFrame:
    """query_id, s, t: n_pairs pairs of different vertices, uniform, decided by the seed; no rows if there are fewer than two vertices."""
    ids = ranked(vertices(edges), "v")
    n = ids.count()
    if n < 2:
        return edges.sparkSession.createDataFrame([], "query_id long, s long, t long")
    s = F.pmod(F.xxhash64(F.lit(2 * seed), "id"), F.lit(n))
    step = F.pmod(F.xxhash64(F.lit(2 * seed + 1), "id"), F.lit(n - 1)) + 1
    rows = edges.sparkSession.range(n_pairs).select(F.col("id").alias("query_id"), s.alias("ps"), ((s + step) % n).alias("pt"))
    a, b = ids.select(F.col("pos").alias("ps"), F.col("v").alias("s")), ids.select(F.col("pos").alias("pt"), F.col("v").alias("t"))
    return rows.join(a, "ps").join(b, "pt").select("query_id", "s", "t")


def coverage_classes(labels: DataFrame, edges: DataFrame, vertex_table: DataFrame, first: int = 10, short_percent: int = 10, medium_percent: int = MEDIUM_PERCENT, most_sources: int = 1000, degree: DataFrame | None = None) -> DataFrame:
    """s, v, qtype by the edges that a search from s has relaxed when it settles v.

    labels(s, v, d) hold the search's order (d, v), up to medium_percent at least; degree(v, degree) is that of the edges, if known. S: from `first` edges to short_percent of all, M: to
    medium_percent, L: vertices that the search never reaches before that. The
    vertex that passes the last limit is in no class. Sources are a stated set of at most `most_sources`.
    """
    degree = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree")) if degree is None else degree
    total = degree.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("total"))
    order = Window.partitionBy("s").orderBy("d", "v").rowsBetween(Window.unboundedPreceding, 0)
    run = labels.join(degree, "v").withColumn("cum", F.sum("degree").over(order)).join(F.broadcast(total))  # total is one row
    part = lambda p: F.col("cum") * 100 < F.col("total") * p
    qtype = F.when((F.col("cum") >= first) & part(short_percent) & (F.col("v") != F.col("s")), "S").when(part(medium_percent) & (F.col("cum") * 100 >= F.col("total") * short_percent), "M")
    seen = run.withColumn("before", F.col("cum") - F.col("degree")).where(F.col("before") * 100 < F.col("total") * medium_percent)
    near = seen.select("s", "v", qtype.alias("qtype")).where("qtype is not null")
    sources = [r.s for r in labels.select("s").distinct().limit(most_sources + 1).collect()]
    if len(sources) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    stated = F.explode(F.array(*map(F.lit, sources)).cast("array<bigint>")).alias("s")
    far = vertex_table.select("v", stated).join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit("L").alias("qtype"))
    return near.unionByName(far)


def coverage_pairs(classes: DataFrame) -> DataFrame:
    """s, qtype, t: of each source and class the smallest vertex; an empty class gives no row."""
    return classes.groupBy("s", "qtype").agg(F.min("v").alias("t"))
