"""Column functions on weight vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hundredths by which criteria count in the weighted average.
WAVE_PERCENT = (33, 33, 33, 0, 0)


def project(weights: Column, k: int) -> Column:
    """The first k criteria."""
    return F.slice(weights, 1, k)


def category(w: Column) -> Column:
    """floor(log2 w), exact for integers."""
    return (F.length(F.bin(w)) - 1).cast("int")


def lower_bound(cat: Column) -> Column:
    """The least weight of a category."""
    return F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), cat).cast("long")


def aggregate_weight(weights: Column, how: str, percent: Sequence[int] = WAVE_PERCENT) -> Column:
    """One weight for partitioning: `pri` the first, `ave` the mean and `wave` the weighted mean, both rounded up.

    `wave_trunc` drops the fraction after every term, as exports do. Integer arithmetic only.
    """
    if how == "pri":
        return F.element_at(weights, 1).cast("long")
    if how == "ave":
        total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)
        return F.ceil(total / F.size(weights)).cast("long")
    shares = F.array(*(F.lit(p) for p in percent))
    terms = F.zip_with(weights, F.slice(shares, F.lit(1), F.size(weights)), lambda w, p: w.cast("long") * p)
    if how == "wave":
        total = F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.expr("0L") + ((total + 99) / 100).cast("long")
    if how == "wave_trunc":
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: ((a * 100 + x) / 100).cast("long"))
    raise ValueError(f"unknown aggregation {how!r}")


def edges_long(edges: DataFrame, k: int | None = None) -> DataFrame:
    """cri, src, dst, w: a row for each weight that is present, of the first k criteria."""
    weights = F.col("weights") if k is None else project(F.col("weights"), k)
    long = edges.select("src", "dst", F.posexplode(weights).alias("cri", "w")).where("w is not null")
    return long.select("cri", "src", "dst", F.col("w").cast("long").alias("w"))


def edges_wide(edges: DataFrame, k: int) -> DataFrame:
    """src, dst, w0, w1, ..: one row an edge, with the first k criteria in columns."""
    return edges.select("src", "dst", *(F.col("weights")[c].alias(f"w{c}") for c in range(k)))


def wide_columns(edges: DataFrame) -> list[str]:
    """Names of the weights of edges in that form; none if they are long."""
    return [c for c in edges.columns if c[0] == "w" and c[1:].isdigit()]


def stacked(wide: DataFrame, *keys: str) -> DataFrame:
    """cri, src, dst, w (and the keys first) of edges in that form."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("cri"), F.col(n).cast("long").alias("w")) for c, n in enumerate(wide_columns(wide))))).alias("x")
    return wide.select(*keys, "src", "dst", rows).select(*keys, "x.cri", "src", "dst", "x.w").where("w is not null")
