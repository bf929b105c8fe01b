"""Readers of graph formats. Lines keep their order in `line`; ids become 0-based."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.operators import prep
from critpath.schema import MISSING_WEIGHT


def _lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """line, text, without blank lines unless asked for.

    A line's number orders the lines of a file; a folder's files follow each other by name, whatever way Spark packs them
    into tasks.
    """
    from critpath.functions.ids import ranked

    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"), F.trim("value").alias("text"))
    if len(rows.inputFiles()) > 1:
        rows = ranked(rows, "file", "at", name="line").select("line", "text")
    else:  # one file's parts are read in order
        rows = rows.select(F.col("at").alias("line"), "text")
    return rows if blank else rows.where("text <> ''")


def _fields() -> Column:
    return F.split("text", r"\s+")


def _weight(x: Column) -> Column:
    """A weight, or null for the value that stands for a missing edge."""
    return F.when(x.cast("int") != MISSING_WEIGHT, x.cast("int"))


def edge_list(spark: SparkSession, path: str, base: int = 1, weighted: bool = False) -> DataFrame:
    """line, u, v[, w] of `u v [w]` rows after a header `n m`, `# n m` or `% ...`."""
    lines = _lines(spark, path)
    first = lines.agg(F.min("line")).first()[0]
    rows = lines.where((F.col("line") != F.lit(first)) & ~F.col("text").rlike("^[#%]")).withColumn("f", _fields())
    cols = ["line", (F.col("f")[0].cast("long") - base).alias("u"), (F.col("f")[1].cast("long") - base).alias("v")]
    return rows.select(*cols, *([_weight(F.col("f")[2]).alias("w")] if weighted else []))


def single_criterion(spark: SparkSession, path: str) -> DataFrame:
    """line, u, v, w of 0-based `u v w` rows after `n m`."""
    return edge_list(spark, path, base=0, weighted=True)


def dimacs(spark: SparkSession, path: str, criterion: int = 0) -> DataFrame:
    """line, u, v, w of DIMACS arcs `a u v w..`, with one criterion."""
    rows = _lines(spark, path).where(F.col("text").startswith("a ")).withColumn("f", _fields())
    return rows.select("line", (F.col("f")[1].cast("long") - 1).alias("u"), (F.col("f")[2].cast("long") - 1).alias("v"), _weight(F.col("f")[3 + criterion]).alias("w"))


def dimacs_range(spark: SparkSession, path: str, criterion: int = 0) -> tuple[DataFrame, tuple[int | None, int | None]]:
    """dimacs, and the least and largest weight."""
    rows = dimacs(spark, path, criterion)
    return rows, tuple(rows.agg(F.min("w"), F.max("w")).first())


def head(spark: SparkSession, path: str, n: int = 10) -> list[str]:
    """The first n lines."""
    return [r.text for r in _lines(spark, path, blank=True).orderBy("line").limit(n).collect()]


def dimacs_multi(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """line, u, v, weights of DIMACS arcs with many weights, and the names in `p criteria k ..`."""
    lines = _lines(spark, path)
    head = lines.where(F.col("text").startswith("p criteria")).first()
    names = head.text.split()[3:] if head else []
    rows = lines.where(F.col("text").startswith("a ")).withColumn("f", _fields())
    weights = F.transform(F.slice("f", F.lit(4), F.size("f") - 3), _weight)
    return rows.select("line", (F.col("f")[1].cast("long") - 1).alias("u"), (F.col("f")[2].cast("long") - 1).alias("v"), weights.alias("weights")), names


def dimacs_pair(spark: SparkSession, distance: str, time: str) -> DataFrame:
    """u, v, weights of two DIMACS files over the same arcs; an arc that one lacks is an error."""
    a, b = (dimacs(spark, p).groupBy("u", "v").agg(F.min_by("w", "line").alias("w")) for p in (distance, time))
    return prep.join_criteria(a, b)


def multi_criteria(spark: SparkSession, path: str, stored_once: bool = False) -> tuple[DataFrame, list[str]]:
    """Edges (src, dst, weights) and names of `n m`, `k names..`, then 0-based `u v w1..wk` rows.

    Self-loops go; a row with another number of weights, or an id out of bounds, is an error. A file that stores edges
    once is mirrored.
    """
    lines = _lines(spark, path)
    head = lines.orderBy("line").limit(2).collect()
    n, names = int(head[0].text.split()[0]), head[1].text.split()[1:]
    rows = lines.where(F.col("line") > head[1].line).withColumn("f", _fields())
    f = F.when(F.size("f") == 2 + len(names), F.col("f")).otherwise(F.raise_error(F.lit("a row has another number of weights")).cast("array<string>"))
    rows = rows.select(f.alias("f")).select(F.col("f")[0].cast("long").alias("u"), F.col("f")[1].cast("long").alias("v"), F.transform(F.slice("f", 3, max(1, len(names))), _weight).alias("weights"))
    rows = prep.clean(prep.check_bounds(rows, n))
    return (prep.mirror(rows) if stored_once else rows.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weights")), names


def whole_stream(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """line, u, v, weights and names of the white-space stream `n m k names.. (u v w1..wk)*`, 1-based, on any lines."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "x")).where("x <> ''")
    from critpath.functions.ids import ranked

    tokens = ranked(lines, "line", "at")
    k = int(tokens.where("pos = 2").first().x)
    names = [r.x for r in tokens.where(f"pos between 3 and {k + 2}").orderBy("pos").collect()]
    own = tokens.where(f"pos >= {k + 3}").select(F.expr(f"(pos - {k + 3}) div {k + 2}").alias("line"), F.expr(f"(pos - {k + 3}) % {k + 2}").cast("int").alias("c"), "x")
    wide = own.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("f"))  # k + 2 values
    return wide.select("line", (F.col("f")[0].cast("long") - 1).alias("u"), (F.col("f")[1].cast("long") - 1).alias("v"), F.transform(F.slice("f", 3, k), _weight).alias("weights")), names


def multiplex(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """u, v, weights and layer names of `n k names..`, then `layer u v w` rows with layers from 1; the last row of an edge wins."""
    lines = _lines(spark, path)
    head = lines.orderBy("line").first()
    names = head.text.split()[2:]
    rows = lines.where(F.col("line") > head.line).withColumn("f", _fields())
    rows = rows.select("line", F.col("f")[0].cast("int").alias("layer"), F.col("f")[1].cast("long").alias("a"), F.col("f")[2].cast("long").alias("b"), F.col("f")[3].cast("int").alias("w"))
    rows = rows.select("line", "layer", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")
    return prep.pivot_layers(rows, range(1, len(names) + 1)), names


def od_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """query_id, s, t of a count and `s t` rows; with `limit` the first of them."""
    lines = _lines(spark, path)
    first = lines.agg(F.min("line")).first()[0]
    rows = lines.where(F.col("line") != F.lit(first)).withColumn("f", _fields())
    from critpath.functions.ids import ranked

    rows = ranked(rows.select("line", F.col("f")[0].cast("long").alias("s"), F.col("f")[1].cast("long").alias("t")), "line", name="query_id").select("query_id", "s", "t")
    return rows.where(F.col("query_id") < limit) if limit is not None else rows


def partition_info(spark: SparkSession, path: str) -> DataFrame:
    """v, pid, pos of `n m`, names, count, then a line `size v..` for each partition."""
    from critpath.functions.ids import ranked

    rows = ranked(_lines(spark, path), "line").where("pos >= 3").select((F.col("pos") - 3).cast("int").alias("pid"), F.split("text", r"\s+").alias("f"))
    return rows.select("pid", F.posexplode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("pos", "v")).select(F.col("v").cast("long").alias("v"), "pid", F.col("pos").cast("long").alias("pos"))


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """v, pid, tag of a count, then a line `count (v tag)*` for each partition."""
    from critpath.functions.ids import ranked

    rows = ranked(_lines(spark, path), "line").where("pos >= 1").select((F.col("pos") - 1).cast("int").alias("pid"), F.split("text", r"\s+").alias("f"))
    pairs = F.explode(F.when(F.col("f")[0].cast("int") > 0, F.sequence(F.lit(0), F.col("f")[0].cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("pid", "f", pairs.alias("i"))
    return rows.select(F.expr("f[2 * i + 1]").cast("long").alias("v"), "pid", F.expr("f[2 * i + 2]").cast("tinyint").alias("tag"))


def metis_parts(spark: SparkSession, path: str) -> DataFrame:
    """v, pid: the line's number is the vertex, its value the partition; a blank line counts as a vertex and has no partition."""
    from critpath.functions.ids import ranked

    return ranked(_lines(spark, path, blank=True), "line", name="v").select("v", F.col("text").try_cast("int").alias("pid")).where("pid is not null")


def _contents(run):
    """run over batches of file contents."""
    from types import SimpleNamespace

    return lambda batches: run(SimpleNamespace(content=[c.as_buffer() for c in batch.column(0)]) for batch in batches)


def binary_partitions(spark: SparkSession, path: str, criteria: int, header: bool = True) -> DataFrame:
    """pid, src, dst, weights of packed 32-bit files: [pid, size,] then (u, degree, (v, w1..wk)*)*; pid is null without the header.

    A file is one partition, whose size the partitioner bounds.
    """

    def run(batches):
        for files in batches:
            for content in files.content:
                x = np.frombuffer(content, "<i4", len(content) // 4)
                pid, at = (int(x[0]), 2) if header else (None, 0)
                starts, degrees = [], []
                while at < len(x):  # a step a vertex; its edges are read as one block
                    starts.append(at)
                    degrees.append(int(x[at + 1]))
                    at += 2 + degrees[-1] * (1 + criteria)
                first, n = np.array(starts, np.int64) + 2, np.array(degrees, np.int64)
                edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(first, n) + edge * (1 + criteria)
                w = x[place[:, None] + np.arange(1, criteria + 1)] if len(place) else np.zeros((0, criteria), np.int32)
                flat = pa.array(w.ravel(), pa.int32(), mask=w.ravel() == MISSING_WEIGHT)
                weights = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * criteria, pa.int32()), flat)
                pids = pa.array(np.full(len(place), pid or 0), pa.int32(), mask=np.full(len(place), pid is None))
                src = np.repeat(x[first - 2], n) if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pids, pa.array(src.astype(np.int64)), pa.array(x[place].astype(np.int64) if len(place) else src.astype(np.int64)), weights], names=["pid", "src", "dst", "weights"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_contents(run), "pid int, src long, dst long, weights array<int>")
