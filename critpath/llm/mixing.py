"""Operator 1: mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source are laid out in a seeded order, in shards of bounded size, and cut
into blocks of equal length. Blocks are allocated to sources, and a source's blocks to
its shards, by highest quotients (v, v/3, v/5, ...); a shard's quota of its blocks is then
picked by a seeded step through them.

Defined results: a null or empty text has size 0 and is never taken; the null source is a
source of its own, ordered last; repeated rows count as often as they stand; no rows give no
rows. Only the named columns are read, whatever else the table has.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def apportion(values: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë seats for each value, at most its cap; ties go to the earlier one."""
    values, caps = np.asarray(values, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[values > 0].sum()))
    got = np.zeros(len(values), np.int64)
    if seats <= 0:
        return got

    def at(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.floor(values / divisor + 0.5)).astype(np.int64)

    low, high = 0.0, 2.0 * float(values.max()) + 1.0  # too many seats (or just enough) .. none
    for _ in range(100):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = at(high)
    while (rest := seats - int(got.sum())) > 0:  # those with equal quotients at the last divisor
        quotient = np.where(got < caps, values / (2 * got + 1), -1.0)
        got[np.argsort(-quotient, kind="stable")[:rest]] += 1
    return got


def targets(sizes: list[int], weights: list[int], repeats: int) -> list[float]:
    """Shares of all sizes by weight; none above `repeats` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    active, rest = set(range(len(sizes))), float(sum(sizes))
    while active and rest > 0:
        level = rest / sum(weights[i] for i in active)
        full = [i for i in active if level * weights[i] > repeats * sizes[i]]
        if not full:
            for i in active:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
            active.discard(i)
    return out


def _step(blocks: int, seed: int) -> tuple[int, int]:
    """A step coprime to `blocks` and a start: their multiples meet every block once."""
    step = max(1, int(blocks * (0.31 + 0.38 * (seed % 9973) / 9973)))
    while math.gcd(step, blocks) != 1:
        step += 1
    return step % blocks or 1, seed % blocks


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    repeats: int = 3,
    block_words: int = 16,
    shard_words: int = 1 << 20,
    seed: int = 20240611,
    max_sources: int = 100_000,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, shard_quota for every row of docs(doc_id, text, source).

    Sources in code-point order (null last) weigh `weights`, repeating. The table of sources
    goes to the driver and back to all executors: more than `max_sources` of them is an error,
    never a cut. A shard is one sort group of about `shard_words` words.
    """
    spark = docs.sparkSession
    sized = common.checkpointed(
        docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("own"), F.coalesce(F.regexp_count("text", F.lit(common.SPACED_PATTERN)), F.lit(0)).cast("long").alias("size"))
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [r.n for r in totals]
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    target = targets(sizes, weigh, repeats)
    blocks = [max(1, round(n / block_words)) if n else 0 for n in sizes]
    wanted = np.array([t * k / n if n else 0.0 for t, k, n in zip(target, blocks, sizes)])
    quota = apportion(wanted, np.array([repeats * k for k in blocks]), round(float(wanted.sum())))
    sources = spark.createDataFrame(
        [(i, r.source, sizes[i], target[i], max(1, -(-sizes[i] // shard_words)), int(quota[i])) for i, r in enumerate(totals)],
        "sid int, name string, source_size long, target double, n_shards long, quota long",
    )
    dealt = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "own"), "n_shards")  # by the text too: an id may be null or repeated
    )

    def shard_quotas(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard", ignore_index=True)
        size = own.shard_size.to_numpy(np.int64)
        k = np.where(size > 0, np.maximum(1, np.rint(size / block_words)), 0).astype(np.int64)
        share = k * (own.target.to_numpy() / max(1, own.source_size.iloc[0]))
        out = own[["sid", "shard", "shard_size"]].assign(blocks=k, shard_quota=apportion(share, repeats * k, int(own.quota.iloc[0])))
        steps = [_step(max(1, n), zlib.crc32(f"{seed},{a},{b}".encode())) for a, b, n in zip(out.sid, out.shard, k.tolist())]
        return out.assign(step=[a for a, _ in steps], start=[b for _, b in steps])

    shards = (
        dealt.groupBy("sid", "shard")
        .agg(F.sum("size").alias("shard_size"), *(F.first(c).alias(c) for c in ("source_size", "target", "quota")))
        .groupBy("sid")
        .applyInPandas(shard_quotas, "sid int, shard long, shard_size long, blocks long, shard_quota long, step long, start long")
    )
    line = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "own"), "own", "doc_id", "size")
    placed = dealt.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(shards, ["sid", "shard"])
    # Block j of K over S words is [j*S div K, (j+1)*S div K); a word w lies in block ((w+1)*K - 1) div S.
    extra = F.expr("""
        aggregate(
            sequence(((upto - size + 1) * blocks - 1) div shard_size, (upto * blocks - 1) div shard_size), 0L,
            (n, j) -> n + if((j * step + start) % blocks < shard_quota % blocks,
                least(upto, (j + 1) * shard_size div blocks) - greatest(upto - size, j * shard_size div blocks), 0L))""")
    taken = F.when(F.col("size") > 0, F.expr("size * (shard_quota div blocks)") + extra).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", "shard_quota")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
