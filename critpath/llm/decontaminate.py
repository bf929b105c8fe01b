"""Operator 8: benchmark decontamination by winnowing.

Of every `window - k + 1` consecutive k-word hashes the smallest is kept as a fingerprint
(the rightmost of equal ones), so texts that share `window` words share a fingerprint. The
fingerprints of documents and items are joined, and each hit is extended to all windows of the document that hold it: those that
are windows of the item too count, whichever place they have there, so a run of repeated words costs no more than any other.
An item with fewer words has no such fingerprint: it is one window, found by the hash of all its words.

Words are compared by 64-bit hashes, and windows by 64-bit hashes of those.

The benchmark goes to the executors in parts of at most `part_words` words. Beyond one part the documents pass
by each in a stage of its own, which leaves only what it found; a task never holds two parts.

Defined results: a null or empty text has no words and no hits; an item without words never
occurs; a null item_id counts as the id ''; repeated items count once; repeated documents are
judged one by one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
K = 5


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of the fingerprints: the smallest of each `width` grams, where the window starting there is valid."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for s in range(1, width):
        g = grams[s : s + n]
        better = g <= least
        least[better] = g[better]
        at[better] = np.flatnonzero(better) + s
    chosen = np.zeros(len(grams), bool)
    chosen[at[valid[:n]]] = True
    return np.flatnonzero(chosen)


#: Fingerprints looked up at once.
_STEP = 1 << 12


def _of_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of windows as those of one item."""
    return common.mix(h ^ (np.atleast_1d(item).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Index:
    """One part of the benchmark: fingerprints of long items, whole hashes of short ones."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int, k: int):
        self.window, self.k, self.ids = window, k, ids
        data = common.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.array([0, *map(len, texts)], np.int64).cumsum()
        starts, ends, self.limits = common.words(data, offsets, common.ALNUM_WORD)
        self.words = common.span_hashes(data, starts, ends)
        hashes, owners = [], []
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (a, b) in enumerate(zip(self.limits[:-1].tolist(), self.limits[1:].tolist())):
            own = self.words[a:b]
            if b - a >= window:
                grams = common.gram_hashes(own, k)
                at = winnow(grams, np.ones(len(grams), bool), window - k + 1)
                hashes.append(grams[at])
                owners.append(np.full(len(at), i))
            elif b > a:
                short[b - a][int(common.gram_hashes(own, b - a)[0])].append(i)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        hashes, owners = cat(hashes, np.uint64), cat(owners, np.int64)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        once = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))[: len(hashes)]
        self.hashes, self.owners = hashes[once], owners[once]  # a fingerprint's items, each once
        own = [(common.gram_hashes(self.words[a:b], window), i) for i, (a, b) in enumerate(zip(self.limits[:-1].tolist(), self.limits[1:].tolist())) if b - a >= window]
        self.windows = np.unique(cat([_of_item(h, np.int64(i)) for h, i in own], np.uint64))
        self.short = {n: (np.array(sorted(d), np.uint64), [d[h] for h in sorted(d)]) for n, d in short.items()}

    def match(self, words: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a run of documents are hit, and the items found in each document that has any."""
        hit = np.zeros(len(words) + 1, np.int32)
        found: dict[int, set[str]] = defaultdict(set)
        doc_of = lambda p: np.searchsorted(limits, p, "right") - 1
        last = np.repeat(limits[1:], np.diff(limits))  # the end of the document of each word
        place = np.arange(len(words))
        grams = common.gram_hashes(words, self.k)
        whole = common.gram_hashes(words, self.window)
        valid = (place + self.window <= last)[: len(whole)]
        if len(self.hashes) and len(whole):
            at = winnow(grams, np.append(valid, np.zeros(len(grams) - len(valid), bool)), self.window - self.k + 1)
            low, high = (np.searchsorted(self.hashes, grams[at], side) for side in ("left", "right"))
            for i in range(0, len(at), _STEP):
                first, n = low[i : i + _STEP], (high - low)[i : i + _STEP]
                p = np.repeat(at[i : i + _STEP], n)
                item = self.owners[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                # All windows that hold the fingerprint, with the item it was found for, each once.
                many = len(self.ids)
                start = (p[:, None] - np.arange(self.window - self.k + 1)).ravel()
                item = np.repeat(item, self.window - self.k + 1)
                inside = (start >= 0) & (start < len(whole))
                pair = np.unique(start[inside] * many + item[inside])
                start, item = pair // many, pair % many
                key = _of_item(whole[start], item)
                slot = np.minimum(np.searchsorted(self.windows, key), len(self.windows) - 1)
                same = (self.windows[slot] == key) & valid[start]
                start, item = start[same], item[same]
                here = np.unique(start)
                hit[here] += 1
                hit[here + self.window] -= 1
                for x in np.unique(doc_of(start) * many + item).tolist():
                    found[x // many].add(self.ids[x % many])
        for n, (hashes, items) in self.short.items():
            grams = common.gram_hashes(words, n)
            if not len(grams):
                continue
            slot = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            at = np.flatnonzero((hashes[slot] == grams) & ((place + n <= last)[: len(grams)]))
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            for d, s in {*zip(doc_of(at).tolist(), slot[at].tolist())}:
                found[d].update(self.ids[i] for i in items[s])
        return np.cumsum(hit)[:-1] > 0, found


def matches(
    docs: DataFrame,
    items: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    k: int = K,
    part_words: int = 2_000_000,
) -> DataFrame:
    """The `keep` columns of docs(text, ...) with n_words, n_hit, spans (array of word ranges) and items (ids found, sorted)."""
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to the window")
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0  # a word has a byte at least and mostly a blank
    n_parts = int(total // (2 * part_words)) + 1

    def index(part: DataFrame):
        rows = part.orderBy("id", "text").collect()  # about part_words words
        return spark.sparkContext.broadcast(Index([r.id for r in rows], [r.text.encode() for r in rows], window, k))

    frame = docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("text").alias("_text_"))
    if n_parts == 1:
        frame = _matched(frame, index(items))
    else:
        # What a text holds depends on the text alone.
        key, parts = F.sha2(F.col("_text_").cast("binary"), 256).alias("_key_"), None
        for part in range(n_parts):
            shared = index(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_parts)) == part))
            own = common.checkpointed(_matched(frame.select(key, "_text_"), shared).where("size(items) > 0").select("_key_", "spans", "items").dropDuplicates(["_key_"]))
            shared.destroy()
            parts = own if parts is None else parts.unionByName(own)
        found = parts.groupBy("_key_").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        frame = _merged(_matched(frame.withColumn("_key_", key), index(items.limit(0))).drop("spans", "items").join(found, "_key_", "left"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return frame.select(*(F.col(f"_{c}").alias(c) for c in keep), "n_words", n_hit.alias("n_hit"), "spans", "items")


_FOUND = "n_words int, spans array<struct<start:int,end:int>>, items array<string>"


def _matched(frame: DataFrame, index) -> DataFrame:
    """frame(_text_, ...) with n_words, and the spans and items of the index that its texts hold."""
    names = frame.columns

    def run(batches):
        own = index.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for i, j, data, offsets in common.slices(batch.column(names.index("_text_"))):
                data = common.LOWER[data]
                starts, ends, limits = common.words(data, offsets, common.ALNUM_WORD)
                hit, found = own.match(common.span_hashes(data, starts, ends), limits)
                n_words += np.diff(limits).tolist()
                for d in range(j - i):
                    spans.append(_ranges(hit[limits[d] : limits[d + 1]]) if d in found else [])
                    items.append(sorted(found[d]) if d in found else [])
            kinds = pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (n_words, spans, items), kinds)], names=[*names, "n_words", "spans", "items"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{types}, {_FOUND}")


def _merged(frame: DataFrame) -> DataFrame:
    """Spans of several parts put together, items in order; null where nothing was found becomes empty."""
    spans = F.sort_array(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    grown = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]), F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(out, F.array(s))),
    )
    return frame.withColumns({"spans": grown, "items": F.array_sort(F.coalesce("items", F.array().cast("array<string>")))})


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
