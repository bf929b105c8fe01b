"""Operator 3: language-model scores by prediction by partial matching (PPM).

A text is scored as its lower-cased words, joined by single blanks, and one end symbol. The
model is a trie of byte contexts up to five symbols long, from all training texts. A symbol is
looked for in the longest context seen; where it never followed, the model escapes (method D:
half a count of every distinct follower) to the next shorter one, leaving out symbols that
the longer one would have given, down to a uniform choice of the symbols never seen.

The trie is kept as counts of 6-grams of symbols, whose prefixes and suffixes give all shorter
contexts. Grams are resolved together if they share the three symbols before the
last, so a group holds at most the 257^3 grams of one such triple; it is joined with the counts of its own
shorter contexts, and only those of single symbols go to every task (257^2 counts at most, whatever the corpus). Resolved grams go to the
scoring tasks by a broadcast as long as they are at most `broadcast_grams`; beyond, every block of
documents gets those it needs by a join. Both ways carry the same 32-bit logarithms.

Word counts for the base score always reach the blocks by a join. Words are counted by 64-bit
hashes.

Defined results: a null or empty text is its end symbol alone; a row without doc_id is learnt
from; repeated rows count as often as they stand; without any training text the base score is
that of an empty vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
BITS = 9
SYMBOLS = 257  # the end symbol is 0, a byte b is b + 1
_LOW = (1 << BITS) - 1
#: The hash that stands for the end of a text among the words.
END_WORD = np.int64(-1)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each with its end; their limits; the words' hashes with the ends among them; their limits."""
    data = common.LOWER[data]
    starts, ends, limits = common.words(data, offsets, common.SPACED_WORD)
    keep = common.SPACED_WORD[data]
    first = np.zeros(len(starts) + 1, bool)
    first[limits[:-1][np.diff(limits) > 0]] = True
    keep[starts[~first[: len(starts)]] - 1] = True
    n_before = np.concatenate([[0], np.cumsum(keep)])[offsets]
    n_docs = len(offsets) - 1
    out = np.zeros(int(n_before[-1]) + n_docs, np.int64)
    place = np.flatnonzero(keep)
    kept = np.where(common.SPACED_WORD[data[place]], data[place], 0x20).astype(np.int64) + 1
    at = np.arange(len(kept)) + np.repeat(np.arange(n_docs), np.diff(n_before))
    out[at] = kept
    words = np.full(len(starts) + n_docs, END_WORD)
    h = common.span_hashes(data, starts, ends).view(np.int64)
    words[np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(limits))] = h
    return out, n_before + np.arange(n_docs + 1), words, limits + np.arange(n_docs + 1)


def grams(s: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Each symbol with the ORDER before it in its text (ends, before its start), the nearest in the lowest bits but one."""
    out = s.copy()
    for j in range(1, ORDER + 1):
        before = np.zeros(len(s), np.int64)
        before[j:] = s[:-j]
        for i in range(j):  # not from the text before
            at = limits[:-1] + i
            before[at[at < limits[1:]]] = 0
        out |= before << (BITS * j)
    return out


class Lookup:
    """Values of sorted keys by a hash table of slots; a key that lost its slot is searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if not (keys[1:] > keys[:-1]).all():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        self.keys, self.values = keys, values
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, q: np.ndarray) -> np.ndarray:
        return (q.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, q: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(q), missing)
        at = self.slots[self._slot(q)]
        lost = np.flatnonzero(self.keys[at] != q)
        if len(lost):
            at[lost] = np.minimum(np.searchsorted(self.keys, q[lost]), len(self.keys) - 1)
        out = self.values[at]
        if len(lost):
            absent = lost[self.keys[at[lost]] != q[lost]]
            if len(absent):
                out = out.astype(np.float64)
                out[absent] = missing
        return out


class Low:
    """Counts of contexts of up to two symbols: of three symbols in a row (packed, sorted) those that are asked for, of two all."""

    def __init__(self, triples: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.triples, self.counts, self.pairs = triples, counts, pairs
        prev, sym = (triples >> BITS) & _LOW, triples & _LOW
        self.single = self.pairs.sum(0)
        self.contexts, of = np.unique(triples >> BITS, return_inverse=True)
        self.total = np.bincount(of, counts, len(self.contexts)).astype(np.int64)
        self.followers = np.bincount(of, counts > 0, len(self.contexts)).astype(np.int64)
        #: What one symbol's context counts for the followers of two.
        self.given = np.bincount(of, np.where(counts > 0, self.pairs[prev, sym], 0), len(self.contexts)).astype(np.int64)
        self.given_by_one = (self.pairs > 0) @ self.single


def resolve(g: np.ndarray, n: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of the last symbol of each gram after the others.

    g holds all grams whose three symbols before the last are those of any of them; n their training counts (0: only
    asked for); low the shorter contexts, with all of g's.
    """
    sym, prev = g & _LOW, (g >> BITS) & _LOW
    triple = np.searchsorted(low.triples, g & ((1 << 3 * BITS) - 1))
    double = np.searchsorted(low.contexts, (g >> BITS) & ((1 << 2 * BITS) - 1))
    # For orders 0, 1, 2, ...: count, the context's total and followers, and its total of what the next longer one gives.
    levels = [
        [low.single[sym], np.full(len(g), low.single.sum()), np.full(len(g), (low.single > 0).sum()), low.given_by_one[prev]],
        [low.pairs[prev, sym], low.pairs.sum(1)[prev], (low.pairs > 0).sum(1)[prev], low.given[double]],
        [low.counts[triple], low.total[double], low.followers[double], None],
    ]
    shorter = low.triples, low.counts
    for k in range(3, ORDER + 1):
        nodes, at = np.unique(g & ((1 << (BITS * (k + 1))) - 1), return_inverse=True)
        count = np.bincount(at, n, len(nodes)).astype(np.int64)
        contexts, of_node = np.unique(nodes >> BITS, return_inverse=True)
        total = np.bincount(of_node, count, len(contexts)).astype(np.int64)
        followers = np.bincount(of_node, count > 0, len(contexts)).astype(np.int64)
        below = shorter[1][np.searchsorted(shorter[0], nodes & ((1 << (BITS * k)) - 1))]
        given = np.bincount(of_node, np.where(count > 0, below, 0), len(contexts)).astype(np.int64)
        levels[-1][3] = given[of_node[at]]
        levels.append([count[at], total[of_node[at]], followers[of_node[at]], None])
        shorter = nodes, count
    log_p = np.zeros(len(g))
    open_ = np.ones(len(g), bool)
    longer = np.zeros(len(g), np.int64)  # followers of the longer context, 0 if it was never seen
    for count, total, followers, given in levels[::-1]:
        t = total - np.where(longer > 0, given, 0) if given is not None else total
        hit = open_ & (count > 0)
        log_p[hit] += np.log10((2 * count[hit] - 1) / (2 * t[hit]))
        out = open_ & ~hit & (followers > longer)
        log_p[out] += np.log10((followers - longer)[out] / (2 * t[out]))
        open_ &= ~hit
        longer = np.where(followers > 0, followers, longer)
    log_p[open_] -= np.log10(SYMBOLS - longer[open_])
    return log_p


def _streams(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in common.slices(texts):
        yield i, j, *symbols(data, offsets)


def _counted(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    k, w = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(weights or [np.zeros(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, w = k[order], w[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(w, first) if len(k) else w


def count_block(streams, held: np.ndarray, kinds: tuple[str, ...] = ("grams", "words")) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block's texts, with their counts in those that are learnt from (0: only elsewhere)."""
    parts: dict[str, tuple[list, list]] = {k: ([], []) for k in kinds}
    for i, j, s, limits, words, word_limits in streams:
        for kind, (keys, counts) in parts.items():
            values, lim = (grams(s, limits), limits) if kind == "grams" else (words, word_limits)
            learn = np.repeat(~held[i:j], np.diff(lim))
            k, n = np.unique(values[learn], return_counts=True)
            other = np.unique(values[~learn])
            keys += [k, other]
            counts += [n.astype(np.int64), np.zeros(len(other), np.int64)]
    return [_counted(*p) for p in parts.values()]


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as their differences, and counts, compressed."""
    return zlib.compress(np.diff(keys, prepend=np.int64(0)).tobytes() + counts.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _rows_of(packed: DataFrame, keys: str) -> DataFrame:
    """block, key, n: one row for each packed key."""

    def run(batches):
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, n = _unpack(x.as_buffer())
                for i in range(0, len(k), 100_000):
                    own = k[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b, np.int32)), pa.array(own), pa.array(n[i : i + 100_000])], names=["block", "key", "n"])

    return packed.select("block", keys).mapInArrow(run, "block int, key long, n long")


def score(docs: DataFrame, held_out: Column, block_bytes: int = 10 << 20, broadcast_grams: int = 5_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_symbols for every row of docs(doc_id, text).

    Rows where held_out is true aren't learnt from. Texts are dealt into blocks of about
    `block_bytes`, and each distinct gram and word of a block is looked up once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(common.n_bytes(F.col("text")))).first()[0] or 0
    n_blocks = common.n_parts(spark, size, block_bytes)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def collect(t: pa.Table) -> pa.Table:
        own = count_block(_streams(t.column("text")), t.column("held_out").to_numpy())
        return pa.table({"block": t.column("block").slice(0, 1), **{c: pa.array([_pack(*x)], pa.binary()) for c, x in zip(("grams", "words"), own)}})

    packed = common.checkpointed(blocks.groupBy("block").applyInArrow(collect, "block int, grams binary, words binary"))
    gram_rows, word_rows = _rows_of(packed, "grams"), _rows_of(packed, "words")

    totals = common.checkpointed(gram_rows.groupBy("key").agg(F.sum("n").alias("n")))
    low_bits = lambda c, n: F.col(c).bitwiseAND((1 << n * BITS) - 1)
    triples = common.checkpointed(totals.groupBy(low_bits("key", 3).alias("t")).agg(F.sum("n").alias("n")))
    rows = triples.groupBy(low_bits("t", 2).alias("p")).agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS^2 rows
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    pairs[rows.column("p").to_numpy() >> BITS, rows.column("p").to_numpy() & _LOW] = rows.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(pairs)
    n_grams = totals.count()

    def resolved(t: pa.Table, own: pa.Table) -> pa.Table:
        g, order = t.column("key").to_numpy(), np.argsort(own.column("t").to_numpy())
        low = Low(own.column("t").to_numpy()[order], own.column("c").to_numpy()[order], shared.value)
        return pa.table({"key": pa.array(g), "x": pa.array(resolve(g, t.column("n").to_numpy(), low).astype(np.float32))})

    context = F.shiftright("key", BITS).bitwiseAND((1 << 3 * BITS) - 1)
    keyed = totals.select("key", "n", context.alias("context"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(n_grams // 200_000 + spark.sparkContext.defaultParallelism))
    # The counts of three symbols whose first two end one of a group's contexts, once for each group.
    ends = keyed.select("context").distinct().select(group("context").alias("g"), low_bits("context", 2).alias("two")).distinct()
    low = triples.select(F.shiftright("t", BITS).alias("two"), "t", F.col("n").alias("c")).join(ends, "two").select("g", "t", "c")
    grams_of_group = keyed.select("key", "n", group("context").alias("g")).groupBy("g")
    model = grams_of_group.cogroup(low.groupBy("g")).applyInArrow(resolved, "key long, x float")

    known = common.checkpointed(word_rows.groupBy("key").agg(F.sum("n").alias("x")).where("x > 0"))
    n_train, n_words = known.agg(F.sum("x"), F.count("*")).first()
    n_train = int(n_train or 0)
    # A block knows its own counts; only words that other blocks have too need to be told.
    told = word_rows.join(known, "key").where("x <> n").select("block", "key", F.col("x").cast("double").alias("x"), F.lit(True).alias("word"))
    table = None
    if n_grams <= broadcast_grams:
        rows = model.orderBy("key").toArrow()
        table = spark.sparkContext.broadcast((rows.column("key").to_numpy(), rows.column("x").to_numpy()))
    else:
        told = told.unionByName(gram_rows.select("block", "key").join(model, "key").select("block", "key", F.col("x").cast("double").alias("x"), F.lit(False).alias("word")))
    base = float(np.log10(n_train + n_words + 1))

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        n = t.num_rows
        held = t.column("held_out").to_numpy()
        key, x, word = (told.column(c).to_numpy() for c in ("key", "x", "word"))
        streams = [(i, j, s.astype(np.int16), *rest) for i, j, s, *rest in _streams(t.column("text"))]
        ((own_words, own_counts),) = count_block(streams, held, ("words",))
        counts = own_counts.astype(np.float64)
        counts[np.searchsorted(own_words, key[word])] = x[word]
        words_of = Lookup(own_words, counts)
        grams_of = _once(table, Lookup) if table is not None else Lookup(key[~word], x[~word])
        out = np.zeros((4, n))
        n_symbols = np.zeros(n, np.int64)
        for i, j, s, limits, words, word_limits in streams:
            s = s.astype(np.int64)
            c = words_of.get(words, 0.0)
            for row, values, lim in ((1, c > 0, word_limits), (2, np.log10(c + 1) - base, word_limits), (3, grams_of.get(grams(s, limits), np.nan), limits)):
                out[row, i:j] = np.add.reduceat(values, lim[:-1], dtype=np.float64)
            out[0, i:j] = np.diff(word_limits)
            n_symbols[i:j] = np.diff(limits)
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "held_out": t.column("held_out"),
                "n_tokens": pa.array(out[0].astype(np.int64)),
                "n_known": pa.array(out[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                "base_score": pa.array(out[2]),
                "score": pa.array(out[3]),
                "n_symbols": pa.array(n_symbols),
            }
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


_last: dict = {}


def _once(shared, build):
    """One object a worker from what a broadcast holds."""
    value = shared.value
    if _last.get(build, (None,))[0] is not value:
        _last[build] = value, build(*value)
    return _last[build][1]


def held_out() -> Column:
    """The fold that is never learnt from; a row without doc_id isn't in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), held_out())
