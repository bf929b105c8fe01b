"""A graph on disk, in one folder: edges by partition, partitions, boundary and shortcuts.

A step whose table exists is not built again. Scans of given partitions read only their
folders, and of the wide weight columns only the first k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.functions.weights import category
from critpath.operators import boundary, cluster, prep
from critpath.sources import writers


class Store:
    def __init__(self, spark: SparkSession, path: str, criteria: int):
        self.spark, self.path, self.criteria = spark, path.rstrip("/"), criteria

    def _existing(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def saved(self, name: str) -> DataFrame:
        """The table of this name, which must exist."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The table of this name; built and written first if it doesn't exist."""
        if (found := self._existing(name)) is None:
            writers.table(build(), f"{self.path}/{name}", by)
            found = self.spark.read.parquet(f"{self.path}/{name}")
        return found

    def partitions(self, edges: DataFrame, how: str = "wave", partition_kb: int = cluster.PARTITION_KB) -> DataFrame:
        return self.table("partitions", lambda: cluster.partition(edges, how, partition_kb))

    def edges(self, edges: DataFrame, partitions: DataFrame) -> DataFrame:
        """src, dst, w0, w1, .. and pid of src, in a folder for each partition."""

        def build() -> DataFrame:
            wide = edges.select("src", "dst", *(F.col("weights")[c].alias(f"w{c}") for c in range(self.criteria)))
            return wide.join(partitions.select(F.col("v").alias("src"), "pid"), "src")

        return self.table("edges", build, by="pid")

    def neighbours(self) -> DataFrame:
        """pid, to, n: edges from each partition to each."""

        def build() -> DataFrame:
            ends = self.saved("partitions").select(F.col("v").alias("dst"), F.col("pid").cast("int").alias("to"))
            return self.saved("edges").select("pid", "dst").join(ends, "dst").groupBy("pid", "to").agg(F.count("*").alias("n"))

        return self.table("neighbours", build)

    def boundary(self, edges: DataFrame, partitions: DataFrame) -> DataFrame:
        return self.table("boundary", lambda: boundary.boundary(edges, partitions))

    def shortcuts(self, long: DataFrame, partitions: DataFrame, found: DataFrame) -> DataFrame:
        """The overlay; a weight that isn't positive is an error."""

        def build() -> DataFrame:
            s = boundary.shortcuts(long, partitions, found, self.criteria)
            ok = F.forall("weights", lambda w: w.isNull() | (w > 0))
            return s.withColumn("weights", F.when(ok, F.col("weights")).otherwise(F.raise_error(F.lit("a shortcut's weight is not positive")).cast("array<bigint>")))

        return self.table("shortcuts", build, by="pid")

    def scan(self, pids: Iterable[int] | None = None, k: int | None = None, with_pid: bool = False, both: bool = False) -> DataFrame:
        """Long edges (cri, src, dst, w[, pid]) of some or all partitions, of the first k criteria; `both`: with the reversed ones."""
        k = self.criteria if k is None else k
        rows = self._of("edges", pids)
        stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("cri"), F.col(f"w{c}").cast("long").alias("w")) for c in range(k)))).alias("x")
        own = ["pid"] if with_pid else []
        out = rows.select(*own, "src", "dst", stacked).select(*own, "x.cri", "src", "dst", "x.w").where("w is not null")
        back = out.select(*own, "cri", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return out.unionByName(back) if both else out

    def scan_category(self, cri: int, pids: Iterable[int] | None = None) -> DataFrame:
        """src, dst, w, cat: edges of one criterion, of some or all partitions, with the category of their weight."""
        rows = self._of("edges", pids).select("src", "dst", F.col(f"w{cri}").cast("long").alias("w")).where("w is not null")
        return rows.withColumn("cat", category(F.col("w")))

    def scan_shortcuts(self, pids: Iterable[int] | None = None, k: int | None = None) -> DataFrame:
        """Long overlay edges (cri, src, dst, w) of some or all partitions, of the first k criteria."""
        rows = self._of("shortcuts", pids).select("src", "dst", F.posexplode("weights").alias("cri", "w")).where("w is not null")
        return rows.select("cri", "src", "dst", F.col("w").cast("long").alias("w")).where(F.col("cri") < (self.criteria if k is None else k))

    def categories(self, long: DataFrame) -> DataFrame:
        """v, cri, mask: which categories of weights leave each vertex."""
        return self.table("categories", lambda: prep.category_bitmask(long))

    def _of(self, name: str, pids: Iterable[int] | None) -> DataFrame:
        rows = self.saved(name)
        return rows if pids is None else rows.where(F.col("pid").isin([int(p) for p in pids]))
