"""Writers of graph formats. Tables go to Parquet; text exports are one line a row."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.operators.cluster import weighted
from critpath.schema import MISSING_WEIGHT


def table(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet, in one folder for each value of `by`; mode `ignore` keeps what exists."""
    if by:
        df.repartition(by).write.mode(mode).partitionBy(by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def single_lines(edges: DataFrame, criterion: int = 0) -> DataFrame:
    """`u v w` lines of one criterion, both directions."""
    return edges.select("src", "dst", F.concat_ws(" ", "src", "dst", F.coalesce(F.col("weights")[criterion], F.lit(MISSING_WEIGHT))).alias("line"))


def multi_lines(edges: DataFrame) -> DataFrame:
    """`u v w1..wk` lines."""
    weights = F.transform("weights", lambda w: F.coalesce(w, F.lit(MISSING_WEIGHT)).cast("string"))
    return edges.select("src", "dst", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), weights).alias("line"))


def metis_lines(edges: DataFrame, how: str = "wave_trunc") -> DataFrame:
    """v, line: `neighbour weight ..` of each vertex, 1-based, in ascending order of neighbours; a hub's line is long."""
    w = weighted(edges, how)
    both = w.unionByName(w.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    near = F.transform(F.sort_array(F.collect_list(F.struct("v", "w"))), lambda x: F.concat_ws(" ", (x["v"] + 1).cast("string"), x["w"].cast("string")))
    return both.groupBy("u").agg(F.concat_ws(" ", near).alias("line")).select(F.col("u").alias("v"), "line")


def hyper_lines(edges: DataFrame, how: str = "wave_trunc") -> DataFrame:
    """u, v, line: one hyperedge `w u v` for each undirected edge, 1-based."""
    return weighted(edges, how).select("u", "v", F.concat_ws(" ", "w", F.col("u") + 1, F.col("v") + 1).alias("line"))


def multiplex_lines(undirected: DataFrame) -> DataFrame:
    """`layer u v w` lines, layers from 1; absent layers have no line."""
    rows = undirected.select("u", "v", F.posexplode("weights").alias("layer", "w")).where("w is not null")
    return rows.select("layer", "u", "v", F.concat_ws(" ", F.col("layer") + 1, "u", "v", "w").alias("line"))


def od_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", F.concat_ws(" ", "s", "t").alias("line"))


def boundary_lines(found: DataFrame) -> DataFrame:
    """pid, line: `count (v tag)*` of each partition."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("v", "tag"))), lambda x: F.concat_ws(" ", x["v"].cast("string"), x["tag"].cast("string")))
    return found.groupBy("pid").agg(F.concat_ws(" ", F.count("*").cast("string"), F.concat_ws(" ", own)).alias("line"))


def partition_lines(partitions: DataFrame) -> DataFrame:
    """pid, line: `size v..` of each partition, in its order."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"].cast("string"))
    return partitions.groupBy("pid").agg(F.concat_ws(" ", F.count("*").cast("string"), F.concat_ws(" ", own)).alias("line"))


def text(lines: DataFrame, path: str, order: list[str], header: list[str] = ()) -> None:
    """One text file in order, after header lines: for programs that read a single file."""
    spark = lines.sparkSession
    body = lines.select(F.lit(1).alias("_kind"), F.struct(*order).cast("string").alias("_x"), "line", *[c for c in order if c != "line"])
    head = spark.createDataFrame([(i, h) for i, h in enumerate(header)] or [], "i int, line string").select(F.lit(0).alias("_kind"), "i", "line")
    whole = head.unionByName(body.drop("_x"), allowMissingColumns=True)
    whole.repartition(1).sortWithinPartitions("_kind", F.col("i").asc_nulls_last(), *order).select("line").write.text(path)


def binary_partitions(edges: DataFrame, partitions: DataFrame, header: bool = True) -> DataFrame:
    """pid, content: a partition packed into 32-bit integers; a weight that isn't positive is an error."""
    rows = edges.join(partitions.select(F.col("v").alias("src"), "pid", "pos"), "src").select("pid", "pos", "src", "dst", "weights")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out = [int(own.pid.iloc[0]), own.src.nunique()] if header else []
        for _, e in own.sort_values(["pos", "dst"]).groupby("pos", sort=True):
            out += [int(e.src.iloc[0]), len(e)]
            for v, weights in zip(e.dst, e.weights):
                packed = [MISSING_WEIGHT if w is None or w != w else int(w) for w in weights]
                if min(packed) <= 0:
                    raise ValueError("a weight is not positive")
                out += [int(v), *packed]
        return pd.DataFrame({"pid": [int(own.pid.iloc[0])], "content": [struct.pack(f"<{len(out)}i", *out)]})

    return rows.groupBy("pid").applyInPandas(run, "pid int, content binary")
