"""Shortest paths as vertex lists, from final labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critpath.runtime import checkpointed

#: Labels up to which their vertices are sent to all tasks, and a path is walked in one.
PATH_ROWS = 1_000_000


def predecessors(long: DataFrame, labels: DataFrame) -> DataFrame:
    """cri, v, pred: of the neighbours on a shortest path to v, the one with the smallest id."""
    a = labels.select("cri", F.col("v").alias("src"), F.col("d").alias("da"))
    b = labels.select("cri", F.col("v").alias("dst"), F.col("d").alias("db"))
    tight = long.join(a, ["cri", "src"]).join(b, ["cri", "dst"]).where("da + w = db")
    return tight.groupBy("cri", F.col("dst").alias("v")).agg(F.min("src").alias("pred"))


def paths(long: DataFrame, labels: DataFrame, source: int, targets: DataFrame) -> DataFrame:
    """cri, t, step, v for targets(t): the path's vertices from the source (step 0) on; none if unreachable.

    A round goes one vertex back on all paths at once; weights are positive, so it ends.
    """
    pred = checkpointed(predecessors(long, labels))
    at = targets.join(labels.withColumnRenamed("v", "t"), "t").select("cri", "t", F.col("t").alias("v"), F.lit(0).alias("back"))
    at = checkpointed(at)
    walked = at
    while not (at := checkpointed(at.where(F.col("v") != source).join(pred, ["cri", "v"]).select("cri", "t", F.col("pred").alias("v"), (F.col("back") + 1).alias("back")))).isEmpty():
        walked = walked.unionByName(at)
    length = walked.groupBy("cri", "t").agg(F.max("back").alias("n"))
    return walked.join(length, ["cri", "t"]).select("cri", "t", (F.col("n") - F.col("back")).cast("int").alias("step"), "v")


def meetings(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """cri, t, v, cost: where searches from the source, forward(cri, v, d), and from each target, backward(t, cri, v, d), meet.

    Of the vertices on a shortest path that nearest its middle, then the smallest.
    """
    both = forward.join(backward.withColumnRenamed("d", "e"), ["cri", "v"])
    best = both.groupBy("cri", "t").agg(F.min(F.struct((F.col("d") + F.col("e")).alias("cost"), F.abs(F.col("d") - F.col("e")).alias("off"), "v")).alias("m"))
    return best.select("cri", "t", "m.v", "m.cost")


def bidirectional_paths(long: DataFrame, forward: DataFrame, backward: DataFrame, source: int) -> DataFrame:
    """cri, t, step, v: paths from the source to each target t, put together at the vertex where the two searches meet.

    Of forward(cri, v, d) and backward(t, cri, v, d) no more is needed than the labels up to each target's distance. If they are few, only edges
    between their vertices are looked at, and the walks of a criterion and target run in one task; else in a round a step.
    """
    met = checkpointed(meetings(forward, backward).select("cri", "t", "v"))
    few = forward.count() + backward.count() <= PATH_ROWS
    if few:
        near = F.broadcast(forward.select("v").union(backward.select("v")).distinct())
        long = checkpointed(long.join(near.withColumnRenamed("v", "src"), "src", "left_semi").join(near.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    first = checkpointed(predecessors(long, forward))
    tight = long.join(backward.select("t", "cri", F.col("v").alias("src"), F.col("d").alias("da")), ["cri", "src"])
    tight = tight.join(backward.select("t", "cri", F.col("v").alias("dst"), F.col("d").alias("db")), ["t", "cri", "dst"]).where("da + w = db")
    last = checkpointed(tight.groupBy("t", "cri", F.col("dst").alias("v")).agg(F.min("src").alias("pred")))

    def walked_in_tasks(ends: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
        back, out = dict(zip(pred.v, pred.pred)), []
        for c, t, v, end in zip(ends.cri, ends.t, ends.v, ends.end):
            out.append((c, t, v, n := 0))
            while v != end and v in back:
                out.append((c, t, v := back[v], n := n + 1))
        return pd.DataFrame(out, columns=["cri", "t", "v", "back"])

    def walk(pred: DataFrame, on: list[str], end) -> DataFrame:
        if few:
            by = on[:-1]
            return met.withColumn("end", end.cast("long")).groupBy(*by).cogroup(pred.groupBy(*by)).applyInPandas(walked_in_tasks, f"cri {dict(met.dtypes)['cri']}, t long, v long, back int")
        at = met.select("cri", "t", "v", F.lit(0).alias("back"))
        walked = at
        while not (at := checkpointed(at.where(F.col("v") != end).join(pred, on).select("cri", "t", F.col("pred").alias("v"), (F.col("back") + 1).alias("back")))).isEmpty():
            walked = walked.unionByName(at)
        return walked

    ahead = walk(first, ["cri", "v"], F.lit(source))
    length = ahead.groupBy("cri", "t").agg(F.max("back").alias("n"))
    ahead = ahead.join(length, ["cri", "t"]).select("cri", "t", (F.col("n") - F.col("back")).alias("step"), "v")
    return joined_paths(ahead, walk(last, ["cri", "t", "v"], F.col("t")).withColumnRenamed("back", "step"))


def joined_paths(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Paths of a bidirectional search: forward to the meeting vertex, then backward from it, in one numbering."""
    n = forward.groupBy("cri", "t").agg(F.max("step").alias("n"))
    rest = backward.join(n, ["cri", "t"]).where("step > 0").select("cri", "t", (F.col("n") + F.col("step")).cast("int").alias("step"), "v")
    return forward.select("cri", "t", F.col("step").cast("int").alias("step"), "v").unionByName(rest)


def shown(walk: DataFrame) -> DataFrame:
    """cri, t, path: vertices joined by arrows, ids from 1; a path is gathered in one row."""
    text: Column = F.concat_ws("-->", F.transform(F.sort_array(F.collect_list(F.struct("step", "v"))), lambda x: (x["v"] + 1).cast("string")))
    return walk.groupBy("cri", "t").agg(text.alias("path"))
