"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critpath.runtime import checkpointed


def _offsets(parts: DataFrame, value: str) -> DataFrame:
    """_part, _offset: the sum of `value` over the ranges before each; there is one figure a range."""
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.expr(value).alias("n")).collect()}
    offset, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, offset))
        offset += sizes[p]
    return F.broadcast(parts.sparkSession.createDataFrame(rows, "_part int, _offset long"))


def ranked(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds the row's place (from 0) in the given order.

    Rows are range-partitioned and ranked inside their range; a range's offset is the number of rows in those
    before it.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(_offsets(parts, "count(*)"), "_part").withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def running(df: DataFrame, value: str, *order: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each, in the given order, likewise."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(_offsets(parts, f"sum({value})"), "_part").withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")
