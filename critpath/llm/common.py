"""Helpers that the operators of this subpackage share.

Text work is done on Arrow batches with numpy: the bytes of many documents lie in one
array, and every step (lower-casing, word limits, hashes) is a pass over that array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.runtime import checkpointed, ship  # noqa: F401

#: Bytes of text that a pass over one array takes at once; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20

#: Bytes that end a word of the white-space kind: [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word of the alphanumeric kind, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SPACED_WORD = ~_SPACE
ALNUM_WORD = _ALNUM
SPACED_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once; whole texts may be long.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def array_of(column) -> pa.Array:
    """One string or binary array with 64-bit offsets; nulls stay nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows with about `size` bytes; a null text has no bytes."""
    column = array_of(column).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word as byte positions, and the limits of each row's words among them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 2)
        tables = []
        for base in (_P, _PINV):
            t = np.full(m, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        if n > SLICE_BYTES + 2:  # a very long text: not kept
            return tables
        _powers[:] = tables
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: the same bytes get the same hash wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hash_words(texts: list[bytes]) -> np.ndarray:
    """span_hashes of whole byte strings."""
    lengths = np.array([0, *map(len, texts)], np.int64).cumsum()
    return span_hashes(np.frombuffer(b"".join(texts), np.uint8), lengths[:-1], lengths[1:])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; its length is len(h) - k + 1 (0 at least)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def n_parts(spark: SparkSession, size: int, each: int) -> int:
    """Parts of about `each` bytes, but no fewer than the cluster has cores."""
    return max(int(size // each) + 1, spark.sparkContext.defaultParallelism)


def spread_join(left: DataFrame, right: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key, without sending the rows of a frequent key to one task.

    Keys that hold more than one in `parts` of left's rows are fewer than `parts` whatever the input, and
    their rows of right are broadcast; the others are shuffled. Neither side has null keys.
    """
    total = left.count()
    hot = left.groupBy(key).count().where(F.col("count") * parts > total).select(key)
    hot = F.broadcast(checkpointed(hot))
    often = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return often.unionByName(left.join(hot, key, "left_anti").join(right, key))
