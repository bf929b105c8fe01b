"""Operator 10: SimHash near-duplicates, found with pivot distance tables.

Fingerprints that may be close meet in a table of their Hamming distances to many reference
fingerprints (pivots), sorted by the first. Two fingerprints within `radius` bits differ by at most `radius` in each
coordinate, so a fingerprint is paired only with those that follow it within `radius` in the first coordinate;
a pair with a larger difference in any other is discarded, and survivors are verified on all 64 bits.

One table over all fingerprints would grow with the square of their number: distances to a random pivot spread too
little over 64 bits (it keeps 57 % of random pairs). Tables are therefore laid out for
buckets that share two of six bit blocks: four differing bits leave at least two blocks alike, so no pair is lost.
A bucket above `bucket_rows` is split again by the same argument over its other bits, so no task gathers
an unbounded group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.operators.components import components

from . import common

RADIUS = 4
N_PIVOTS = 16
_CHUNK = 1 << 16
_U = np.uint64


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles (XXH64, seed 42); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(first), _CHUNK):
        h = b"".join([digest(joined[a:b], 42) for a, b in zip(first[i : i + _CHUNK], last[i : i + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = common.array_of(batch.column(1))
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of about equal length over these bits."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, dtype=object), n)]


def _first_masks(radius: int) -> list[int]:
    parts = _blocks(list(range(64)), radius + 2)
    return [a | b for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pivots(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=_U) * _U(2) + np.arange(n, dtype=_U) % _U(2)


def pivot_table(fp: np.ndarray, n_pivots: int, seed: int) -> np.ndarray:
    """Distances of each fingerprint to the pivots."""
    return np.bitwise_count(fp[:, None] ^ _pivots(n_pivots, seed)[None, :]).astype(np.int8)


def _link_runs(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal (mask, key); runs are in order of their first pivot distance."""
    n = len(fp)
    fresh = np.ones(n, bool)
    fresh[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    end = np.append(np.flatnonzero(fresh)[1:], n)[np.cumsum(fresh) - 1]
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    us, vs, offset, left = [], [], 0, np.arange(n)
    while True:
        offset += 1
        left = left[left + offset < end[left]]
        left = left[far[left + offset, 0] - far[left, 0] <= radius]  # what follows is farther still
        if not len(left):
            return fp[us], fp[vs]
        i = left[parent[left] != parent[left + offset]]
        for c in range(1, far.shape[1]):  # the pivot table discards most pairs, coordinate by coordinate
            i = i[np.abs(far[i, c] - far[i + offset, c]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + offset]) <= radius]
        for a in i.tolist():
            ra, rb = root(a), root(a + offset)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                us.append(a)
                vs.append(a + offset)
        if len(i):
            while (up := parent[parent])[0:].tobytes() != parent.tobytes():
                parent = up


def links(fps: DataFrame, radius: int = RADIUS, n_pivots: int = N_PIVOTS, bucket_rows: int = 2048, seed: int = 7) -> DataFrame:
    """u, v: links between distinct fingerprints of fps(fp), enough to connect all that lie within `radius` bits.

    Links inside a bucket that others already imply are left out; every class of linked
    fingerprints stays connected.
    """
    own = common.checkpointed(fps.select("fp").distinct())
    keyed = own.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in _first_masks(radius)))).alias("mask"))
    found = None

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            mask, key, fp = (t.column(c).to_numpy() for c in ("mask", "key", "fp"))
            far = pivot_table(fp.view(_U), n_pivots, seed)
            order = np.lexsort((fp, far[:, 0], key, mask))
            u, v = _link_runs(mask[order], key[order], fp[order].view(_U), far[order], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:  # sorted; the last run of a batch may go on in the next
            held.append(batch)
            t = pa.Table.from_batches(held)
            mask, key = t.column("mask").to_numpy(), t.column("key").to_numpy()
            cut = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1]) + 1 if ((mask != mask[-1]) | (key != key[-1])).any() else 0
            if cut:
                yield flush(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    for _ in range(16):
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        # Below one row a bucket there is nothing to link; above bucket_rows it is split again.
        counted = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        small, large = counted.where(F.col("n") <= bucket_rows), common.checkpointed(counted.where(F.col("n") > bucket_rows))
        part = (
            keyed.join(small.select("mask", "key"), ["mask", "key"])
            .repartition("mask", "key")
            .sortWithinPartitions("mask", "key")
            .select("mask", "key", "fp")
            .mapInArrow(run, "u long, v long")
        )
        found = part if found is None else found.unionByName(part)
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # not keys: five times as many masks a level at most
        if not masks:
            return found
        finer = []
        for m in masks:
            taken = m & ((1 << 64) - 1)
            parts = _blocks([b for b in range(64) if not taken >> b & 1], radius + 1)
            finer += [(m, _signed(taken | p)) for p in parts]
        finer = fps.sparkSession.createDataFrame(finer, "mask long, finer long")
        keyed = keyed.join(large.select("mask", "key"), ["mask", "key"]).join(F.broadcast(finer), "mask")
        keyed = common.checkpointed(keyed.select("fp", F.col("finer").alias("mask")))
    raise RuntimeError("buckets did not get smaller")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text): the smallest doc_id that it reaches by links.

    Texts without words have fingerprint 0 and link like any other; rows without a doc_id
    belong to a component but never name it (it is null if none of its rows has one).
    """
    marked = common.checkpointed(fingerprints(docs, shingle))
    least = common.checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = common.checkpointed(components(links(least, radius)).withColumnRenamed("node", "fp").join(least, "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = common.spread_join(rooted.select("fp", "root"), named, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    ids = least.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return common.spread_join(marked, ids, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
