"""Operator 9: cropped and edited copies among images, by local descriptors.

Corners (Harris) are taken at full and half size. The patch around each is turned by its
intensity centroid, and 128 fixed comparisons of smoothed pixels give two binary words: a
descriptor from its middle, and a check word from the whole patch. Two keypoints match if their descriptors differ in at most
`radius` bits and their check words in at most `slack`; descriptors are cut into `radius + 2` blocks and meet in Hamming tables of
two blocks each: as many differing bits leave two blocks alike, so no match is missed. A match votes for a rotation,
scale step and shift, and two images are linked if at least `agree` keypoints of one vote into
one cell of `shift` pixels, in any of four grids half a cell apart. Classes of copies are the connected
components of links.

Identical images are one class before any of that. A group of m copies has m * m / 2 links, which
are never all made: first, in tables that share no bits, every keypoint is paired, for each of a few random orders of images, only with the first
image that it matches there, so that most copies of a group meet the same few images; then all matches between images
that are still in different components are voted on. A pair
left out lies in one component already, so components are those of all links. Buckets of a table are compared in memory, a
bucket of more than `bucket_points` points piece by piece; in the second round every two pieces of such a bucket meet in a task.

Media are binary PGM (P5) or PPM (P6) files of 8 bits. Defined results: null, empty or unreadable media and
images too small for a patch have no keypoints and no links; identical media still share a class,
null media never do; repeated rows are returned as often as they stand; an id may have any type that can be
ordered, and rows of one id with different media count as one image, the one with the smallest digest.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.operators.components import components

from . import common

MARGIN = 11
TURNS = 16
_HEADER = re.compile(rb"(P[56])\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM file, or None."""
    m = _HEADER.match(media or b"")
    if not m:
        return None
    w, h, depth = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    if m[4] != b"255" or len(media) - m.end() < w * h * depth or not w * h:
        return None
    pixels = np.frombuffer(media, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
    return pixels[:, :, 0].astype(np.float32) if depth == 1 else (pixels @ np.array([0.299, 0.587, 0.114])).astype(np.float32)


def encode(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def _pattern() -> np.ndarray:
    """Offsets (turn, test, end, yx) of the comparisons, for each turn of the patch."""
    points = np.clip(np.random.Generator(np.random.PCG64(99)).normal(0, 4.0, (64, 2, 2)), -7, 7)
    wide = np.random.Generator(np.random.PCG64(102)).normal(0, 6.0, (64, 2, 2))
    points = np.concatenate([points, wide * np.minimum(1, 10 / np.linalg.norm(wide, axis=2, keepdims=True))])
    out = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        out.append(np.rint(points @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])))
    return np.array(out, np.int64)


_TESTS = _pattern()
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49], np.int64)
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2r + 1, along the last two axes; edges repeat."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = sum(np.take(p, range(i, i + n), axis) for i in range(2 * r + 1)) / (2 * r + 1)
    return a


def keypoints(images: np.ndarray, most: int, tile: int) -> tuple[np.ndarray, ...]:
    """(image, y, x, turn, descriptor, check word) of the `most` strongest corners in each tile of each image of one size (n, h, w)."""
    n, h, w = images.shape
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if min(h, w) <= 2 * MARGIN:
        return none
    smooth = _box(images, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
    r = a * c - b * b - 0.05 * (a + c) ** 2
    top = r.copy()
    for axis in (1, 2):
        top = np.maximum.reduce([np.roll(top, s, axis) for s in range(-2, 3)])
    inner = np.zeros((h, w), bool)
    inner[MARGIN:-MARGIN, MARGIN:-MARGIN] = True
    i, y, x = np.nonzero((r == top) & (r > 1.0) & inner)
    if not len(i):
        return none
    own = (i * (h // tile + 1) + y // tile) * (w // tile + 1) + x // tile
    order = np.lexsort((x, y, -r[i, y, x], own))
    i, y, x, own = i[order], y[order], x[order], own[order]
    place = np.arange(len(i)) - np.searchsorted(own, own)
    i, y, x = (v[place < most] for v in (i, y, x))
    disc = images[i[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
    angle = np.arctan2(disc @ _DISC[:, 0].astype(np.float32), disc @ _DISC[:, 1].astype(np.float32))
    turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
    t = _TESTS[turn]
    p = smooth[i[:, None, None], y[:, None, None] + t[..., 0], x[:, None, None] + t[..., 1]]
    less = p[..., 0] < p[..., 1]
    bits, check = ((less[:, k : k + 64] * _WEIGHT).sum(1, dtype=np.uint64).view(np.int64) for k in (0, 64))
    return i, y, x, turn, bits, check


POINTS = "array<struct<descriptor:bigint,check:bigint,place:bigint>>"
#: A place packs octave, turn, y and x into 4, 4, 24 and 24 bits.
_SIDE = 1 << 24
_SHIFTS = 24, 48, 52


def describe(images: DataFrame, most: tuple[int, int] = (40, 12), tile: int = 64) -> DataFrame:
    """id, digest, points of images(id, media), in one row an image.

    points: at most `most` keypoints, at full and half size, for each square of `tile` pixels a side.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                media = part.column(1).to_pylist()
                by_size: dict[tuple, list] = {}
                for at, m in enumerate(media):
                    if (p := decode(m)) is not None:
                        by_size.setdefault(p.shape, []).append((at, p))
                found = [(np.zeros(0, np.int64),) * 4]
                for rows in by_size.values():
                    own, pixels = np.array([a for a, _ in rows]), np.stack([p for _, p in rows])
                    for octave in (0, 1):
                        if octave:
                            h, w = pixels.shape[1] // 2 * 2, pixels.shape[2] // 2 * 2
                            pixels = (pixels[:, :h:2, :w:2] + pixels[:, 1:h:2, :w:2] + pixels[:, :h:2, 1:w:2] + pixels[:, 1:h:2, 1:w:2]) / 4
                        i, y, x, turn, bits, check = keypoints(pixels, most[octave], tile >> octave)
                        place = (octave << _SHIFTS[2]) + (turn << _SHIFTS[1]) + ((y << octave) << _SHIFTS[0]) + (x << octave)
                        found.append((own[i], bits, check, place))
                image, *fields = (np.concatenate(c) for c in zip(*found))
                order = np.argsort(image, kind="stable")
                limits = np.searchsorted(image[order], np.arange(part.num_rows + 1))
                flat = pa.StructArray.from_arrays([pa.array(f[order]) for f in fields], names=["descriptor", "check", "place"])
                points = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), flat)
                digests = pa.array([None if m is None else hashlib.sha256(m).digest() for m in media], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, points], names=["id", "digest", "points"])

    return images.select("id", "media").mapInArrow(run, f"id {dict(images.dtypes)['id']}, digest binary, points {POINTS}")


def _agreeing(pairs: DataFrame, agree: int, shift: int) -> DataFrame:
    """u, v, n from matches (u, v, a, b: their places): the most keypoints of u that vote into one cell, if `agree` or more.

    The shuffle carries ids and places; what follows from them is computed behind it.
    """
    pairs = pairs.repartition("u", "v")
    of = lambda c: (F.col(c).bitwiseAND(_SIDE - 1), F.shiftright(c, _SHIFTS[0]).bitwiseAND(_SIDE - 1), F.shiftright(c, _SHIFTS[1]).bitwiseAND(15), F.shiftright(c, _SHIFTS[2]))
    (ax, ay, a_turn, a_octave), (x, y, b_turn, b_octave) = of("a"), of("b")
    turn, step = F.pmod(b_turn - a_turn, F.lit(TURNS)), b_octave - a_octave
    angle, scale = turn * (2 * np.pi / TURNS), F.pow(F.lit(2.0), step)
    dx = F.round(x - scale * (F.cos(angle) * ax - F.sin(angle) * ay))
    dy = F.round(y - scale * (F.sin(angle) * ax + F.cos(angle) * ay))
    votes = pairs.select("u", "v", turn.alias("turn"), step.alias("step"), F.col("a").alias("kp"), dx.alias("dx"), dy.alias("dy"))
    cell = lambda c, grid: F.floor((F.col(c) + grid * (shift // 2)) / shift)
    grids = F.array(*(F.struct(F.lit(2 * gy + gx).alias("grid"), cell("dx", gx).alias("cx"), cell("dy", gy).alias("cy")) for gy in (0, 1) for gx in (0, 1)))
    cells = votes.select("u", "v", "turn", "step", "kp", F.explode(grids).alias("c")).distinct()
    return cells.groupBy("u", "v", "turn", "step", "c").agg(F.count("*").alias("n")).where(F.col("n") >= agree).groupBy("u", "v").agg(F.max("n").alias("n"))


def _tables(radius: int, apart: bool = False) -> list[int]:
    """Masks of the Hamming tables: two of radius + 2 runs of bits; `apart`: only as many as share no bits."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), radius + 2)]
    masks = [a | b for a, b in (zip(parts[::2], parts[1::2]) if apart else combinations(parts, 2))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(points: DataFrame, masks: list[int]) -> DataFrame:
    """points, once for each table t, with their key there."""
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("descriptor").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks))))
    return points.withColumn("k", keys).select("k.*", *points.columns)


def _buckets(batches, limit: int | None = None):
    """(rows, whole) for runs of whole buckets of sorted batches; with `limit` a bucket that is larger, and than a batch, comes in pieces that aren't whole."""
    held: list[pa.RecordBatch] = []
    pieces = False  # the first bucket of what is held has been cut before
    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        own, key = t.column("t").to_numpy(), t.column("key").to_numpy()
        last = (own == own[-1]) & (key == key[-1]) if len(own) else np.zeros(0, bool)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if len(own) and not last.all() else 0
        if cut and pieces:
            end = int(np.flatnonzero((own != own[0]) | (key != key[0]))[0])
            yield t.slice(0, end), False
            if cut > end:
                yield t.slice(end, cut - end), True
            pieces = False
        elif cut:
            yield t.slice(0, cut), True
        t = t.slice(cut)
        while limit and t.num_rows > limit:
            yield t.slice(0, limit), False
            t, pieces = t.slice(limit), True
        held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held), not pieces


def _matches(t: pa.Table, radius: int, slack: int):
    """(i, j) of matching rows of different images in one bucket, a distance between them in the table at a time."""
    own, key = t.column("t").to_numpy(), t.column("key").to_numpy()
    d, check = (t.column(c).to_numpy().view(np.uint64) for c in ("descriptor", "check"))
    image = _codes(t.column("id"))
    n = len(own)
    fresh = np.ones(n, bool)
    fresh[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    end = np.append(np.flatnonzero(fresh)[1:], n)[np.cumsum(fresh) - 1]
    left, offset = np.arange(n), 0
    while True:
        offset += 1
        left = left[left + offset < end[left]]
        if not len(left):
            return
        i = left[image[left] != image[left + offset]]
        i = i[np.bitwise_count(d[i] ^ d[i + offset]) <= radius]
        i = i[np.bitwise_count(check[i] ^ check[i + offset]) <= slack]
        if len(i):
            yield i, i + offset


def _codes(ids: pa.ChunkedArray) -> np.ndarray:
    """A number for each id: the same for the same id, whatever else is there."""
    if pa.types.is_integer(ids.type):
        return common.mix(ids.to_numpy().astype(np.int64).view(np.uint64))
    return common.hash_words([str(x).encode() for x in ids.to_pylist()])


def _pairs(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """u, v, a, b: pairs of rows with the smaller id first."""
    ids = t.column("id").combine_chunks()
    first = pc.less(ids.take(pa.array(i)), ids.take(pa.array(j))).to_numpy(zero_copy_only=False)
    i, j = pa.array(np.where(first, i, j)), pa.array(np.where(first, j, i))
    place = t.column("place").combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(i), ids.take(j), place.take(i), place.take(j)], names=["u", "v", "a", "b"])


def _first_matches(points: DataFrame, radius: int, slack: int, bucket_points: int, orders: int = 4) -> DataFrame:
    """u, v, a, b: of each keypoint the match whose image comes first, for each of a few random orders of images, inside buckets or pieces of them."""
    kind = points.schema["id"].dataType

    def run(batches):
        for t, _ in _buckets(batches, bucket_points):
            n, image = t.num_rows, _codes(t.column("id"))
            found = [np.zeros((0, 2), np.int64)]
            rank = [common.mix(image ^ common.mix(np.array([s + 1], np.uint64))) for s in range(orders)]
            best = [np.full(n, np.iinfo(np.uint64).max) for _ in rank]
            lead = [np.full(n, -1) for _ in rank]
            for i, j in _matches(t, radius, slack):
                for r, least, to in zip(rank, best, lead):
                    for x, y in ((i, j), (j, i)):
                        better = r[y] < least[x]
                        least[x[better]], to[x[better]] = r[y[better]], y[better]
            for to in lead:
                x = np.flatnonzero(to >= 0)
                found.append(np.stack([np.minimum(x, to[x]), np.maximum(x, to[x])], 1))
            i, j = np.unique(np.concatenate(found), axis=0).T
            yield _pairs(t, i, j)

    sorted_ = _keyed(points, _tables(radius, apart=True)).repartition("t", "key").sortWithinPartitions("t", "key")
    return sorted_.mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}, a long, b long")


def _cross_matches(points: DataFrame, roots: DataFrame, radius: int, slack: int, bucket_points: int) -> DataFrame:
    """u, v, a, b: all matches between images of different roots(id, root), an image without one being its own.

    A match that several tables show comes once for each.
    """
    kind = points.schema["id"].dataType.simpleString()
    rows = points.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = _keyed(rows, _tables(radius))

    def run(batches):
        for t, whole in _buckets(batches, bucket_points):
            if not whole:  # a piece of a large bucket leaves the bucket's table and key
                none = pa.nulls(1, t.column("id").type)
                yield pa.RecordBatch.from_arrays([none, none, pa.array([t.column("t")[0].as_py()]), t.column("key").slice(0, 1).combine_chunks()], names=["u", "v", "a", "b"])
                continue
            root = _codes(t.column("root"))
            for i, j in _matches(t, radius, slack):
                apart = root[i] != root[j]
                if apart.any():
                    yield _pairs(t, i[apart], j[apart])

    schema = f"u {kind}, v {kind}, a long, b long"
    found = common.checkpointed(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, schema))
    large = found.where("u is null").groupBy(F.col("a").cast("int").alias("t"), F.col("b").alias("key")).agg((F.count("*") + 1).cast("int").alias("n_blocks"))
    large = common.checkpointed(large)
    found = found.where("u is not null")
    if large.isEmpty():
        return found
    rows = rows.join(large, ["t", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "place"), "n_blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def meet(t: pa.Table) -> pa.Table:
        root, block = _codes(t.column("root")), t.column("block").to_numpy()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        out = [_pairs(t, *(np.zeros(0, np.int64),) * 2)]
        for i, j in _matches(t, radius, slack):
            own = (root[i] != root[j]) & (same | (block[i] != block[j]))  # pairs inside a block are left to that block
            out.append(_pairs(t, i[own], j[own]))
        return pa.Table.from_batches(out)

    return found.unionByName(rows.groupBy("t", "key", "i", "j").applyInArrow(meet, schema))


def roots_of(described: DataFrame, radius: int = 2, slack: int = 8, agree: int = 4, shift: int = 12, bucket_points: int = 1024) -> DataFrame:
    """id, root: of every linked image of described(id, points), ids distinct, the smallest id in its component of links."""
    points = described.select("id", F.inline("points"))
    found = _first_matches(points, radius, slack, bucket_points)
    first = common.checkpointed(_agreeing(found, agree, shift).select("u", "v"))
    roots = common.checkpointed(components(first).select(F.col("node").alias("id"), "root"))
    cross = _cross_matches(points, roots, radius, slack, bucket_points)
    cross = common.checkpointed(_agreeing(cross, agree, shift).select("u", "v"))
    return components(first.unionByName(cross)).select(F.col("node").alias("id"), "root")


def copies(images: DataFrame, **how) -> DataFrame:
    """id, class_id, component_id, n_keypoints for every row of images(id, media); `how` goes to roots_of.

    class_id is the smallest id of identical media, component_id the smallest id among all its linked copies.
    """
    described = common.checkpointed(describe(images))
    digests = described.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"))
    ids = described.select("id", "digest", F.size("points").cast("long").alias("n_keypoints")).join(digests, "digest", "left")
    ids = common.checkpointed(ids.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_keypoints"))
    classes = ids.select(F.col("class_id").alias("id")).distinct()
    first = described.where("size(points) > 0").join(classes, "id", "left_semi").groupBy("id").agg(F.min_by("points", "digest").alias("points"))
    roots = roots_of(common.checkpointed(first), **how).select(F.col("id").alias("class_id"), F.col("root").alias("component_id"))
    return ids.join(roots, "class_id", "left").select("id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_keypoints")


def rendered(vectors: DataFrame, size: int = 64, seed: int = 12) -> DataFrame:
    """id, media: a grey texture for each row of vectors(id, vector), the same for the same direction and close for close ones.

    The tables at hand hold no images; a fixed set of smooth random patterns, weighted by the vector, stands in.
    """

    def run(batches):
        patterns: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.nan_to_num(np.array([x or 0.0 for x in v or ()], np.float32))
                norm = float(np.sqrt((v * v).sum()))
                if not norm:
                    out.append(None)
                    continue
                if len(v) not in patterns:
                    noise = np.random.Generator(np.random.PCG64(seed)).normal(0, 1, (len(v), size, size)).astype(np.float32)
                    noise = _box(_box(noise, 2), 1)
                    patterns[len(v)] = (noise / noise.std()).reshape(len(v), -1)
                out.append(encode((128 + 45 * (v / norm) @ patterns[len(v)]).reshape(size, size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "media"])

    return vectors.select("id", "vector").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, media binary")


def op9_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return copies(rendered(vectors)).withColumnRenamed("id", "vec_id")
