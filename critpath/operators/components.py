"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.runtime import checkpointed


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the smallest node that it reaches.

    Each round joins links with the least neighbour of every node, so no neighbourhood is
    gathered in one place; its result is checkpointed in the shared folder.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = checkpointed(tidy(links.select("u", "v")))
    before = digest(edges)
    for _ in range(max_rounds):
        # large star: every neighbour above u links to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: u and its neighbours below link to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(
            tidy(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        )
        if (now := digest(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
