"""Operator 6: toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows forms the index. Its terms are all words and word beginnings that two
examples have. A term's weight is tf-idf, with document frequencies over all documents, times its relevance: how surely
it stands out in label 1 among the examples, and never less than LEAST_RELEVANCE, so that every term counts but
common prose doesn't drown what the labels are about.

Postings of each term are cut into blocks of examples, each with the largest weight in it. For a text the block with the
largest bound is opened first; of the others only those whose bound reaches the k-th best cosine found there: the
nearest examples are exact. They vote by squared cosine, each weighted by how many labelled rows it stands
for, against the rate of label 1, which gives calibrated scores; the nearest ids are the evidence.

Defined results: texts without a term of the index (null and empty ones too) get the rate of label 1 among
labelled rows; without any labelled row the score is 0; repeated rows are scored one by one; ties
between examples go to the smaller id; a doc_id that labels hold twice has the larger label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lm_score import Lookup
from .simhash import fingerprint

BLOCK = 128
PREFIXES = (4,)
#: Examples whose SimHash differs in no more bits are copies; unrelated ones differ in 32 or so.
COPY_BITS = 8
#: Relevance grows with the likelihood ratio g as g / (g + HALF_G), and with the lift up to FULL_LIFT.
HALF_G = 100.0
FULL_LIFT = 10.0
LEAST_RELEVANCE = 0.03
#: Terms in more than one of so many examples are kept as a matrix.
OFTEN = 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Terms of each kind as (hash, number of the word), and the limits of each text's words.

    Terms are whole words and the first PREFIXES bytes of longer ones, since many languages inflect.
    """
    data = common.LOWER[data]
    starts, ends, limits = common.words(data, offsets, common.ALNUM_WORD)
    out = [(common.span_hashes(data, starts, ends), np.arange(len(starts)))]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        out.append((common.span_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(n), longer))
    return out, limits


def relevance(with_term: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How surely terms stand out in label 1, from LEAST_RELEVANCE to 1; with_term: examples of labels 0 and 1 that hold each."""
    a, b = with_term.astype(float)
    both = (a + b) / max(1, n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(x > 0, 2 * x * np.log(x / (m * q)), 0.0) for x, m, q in ((a, n0, both), (b, n1, both), (n0 - a, n0, 1 - both), (n1 - b, n1, 1 - both)))
    lift = (b + 0.5) / (n1 + 1) / ((a + 0.5) / (n0 + 1))
    sure = np.where(lift > 1, np.maximum(g, 0) / (np.maximum(g, 0) + HALF_G) * np.minimum(1, lift / FULL_LIFT), 0)
    return LEAST_RELEVANCE + (1 - LEAST_RELEVANCE) * sure


def _arrays(bag) -> tuple[np.ndarray, np.ndarray]:
    """Sorted terms and their counts of a mapping, or as they are."""
    if isinstance(bag, dict):
        keys = sorted(bag)
        return np.array(keys, np.uint64), np.array([bag[x] for x in keys], np.int64)
    return bag


def _unit(rows: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weights of n vectors (their rows in order), scaled to length 1."""
    return w / np.maximum(1e-300, np.sqrt(np.bincount(rows, w * w, n)))[rows]


class BlockMax:
    """Inverted index with block maxima over examples' unit vectors."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, bags: list, k: int, prior: float):
        order = np.argsort(terms)
        self.terms, self.weight = terms[order], weight[order]
        self.ids, self.labels, self.weights, self.k, self.prior = ids, labels, weights, k, prior
        self.n, self.n_blocks = len(ids), -(-max(1, len(ids)) // BLOCK)
        found = [self.vector(bag) for bag in bags]
        none = np.zeros(0, np.int64)
        t = np.concatenate([none, *(a for a, _ in found)])
        x = np.concatenate([none.astype(float), *(w for _, w in found)])
        e = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
        # Terms of many examples are rows of a matrix, the others lists of postings.
        df = np.bincount(t, minlength=len(self.terms))
        often = np.flatnonzero(df * OFTEN > self.n)
        self.row = np.full(len(self.terms), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n_blocks * BLOCK))
        dense = self.row[t] >= 0
        self.matrix[self.row[t[dense]], e[dense]] = x[dense]
        best = np.zeros((len(self.terms), self.n_blocks))
        np.maximum.at(best, (t, e // BLOCK), x)
        self.best = np.nextafter(best.astype(np.float32), np.float32(np.inf))  # block maxima; not less than the exact ones
        t, x, e = t[~dense], x[~dense], e[~dense]
        order = np.lexsort((e, t))
        self.example, self.value = e[order].astype(np.int32), x[order]
        cell = t[order] * self.n_blocks + self.example // BLOCK
        self.limits = np.searchsorted(cell, np.arange(len(self.terms) * self.n_blocks + 1)).astype(np.int32)  # postings of each term in each block

    def vector(self, bag) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms (as rows of the index) and their weights; of length 1 unless it has none."""
        keys, n = _arrays(bag)
        at = np.minimum(np.searchsorted(self.terms, keys), max(0, len(self.terms) - 1))
        own = self.terms[at] == keys if len(self.terms) else np.zeros(len(keys), bool)
        at = at[own]
        w = (1 + np.log(n[own])) * self.weight[at]
        return at, _unit(np.zeros(len(w), np.int64), w, 1)

    def _add(self, out: np.ndarray, rows: np.ndarray, low: np.ndarray, end: np.ndarray, w: np.ndarray, first: int) -> None:
        """Adds the postings low..end of each (row, weight) to out, whose columns are the examples from `first` on."""
        count = (end - low).astype(np.int64)
        place = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        cell = np.repeat(rows * out.shape[1] - first, count) + self.example[place]
        out += np.bincount(cell, np.repeat(w, count) * self.value[place], out.size).reshape(out.shape)

    def _open(self, cosine: np.ndarray, wanted: np.ndarray, matrix: np.ndarray, rows: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        """Cosines of the texts with the examples of the blocks wanted(text, block)."""
        most = wanted.sum(1) * 4 > self.n_blocks
        if most.any():  # these texts read whole lists of postings at once
            texts = np.flatnonzero(most)
            part = matrix[texts] @ self.matrix
            use = most[rows]
            own = at[use] * self.n_blocks
            self._add(part, (np.cumsum(most) - 1)[rows[use]], self.limits[own], self.limits[own + self.n_blocks], w[use], 0)
            cosine[texts] = part
            wanted = wanted & ~most[:, None]
        for b in np.flatnonzero(wanted.any(0)).tolist():
            texts = np.flatnonzero(wanted[:, b])
            part = matrix[texts] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
            use = np.flatnonzero(wanted[rows, b])
            cell = at[use] * self.n_blocks + b
            self._add(part, (np.cumsum(wanted[:, b]) - 1)[rows[use]], self.limits[cell], self.limits[cell + 1], w[use], b * BLOCK)
            cosine[texts, b * BLOCK : (b + 1) * BLOCK] = part

    def nearest(self, rows: np.ndarray, at: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k nearest with a cosine above 0 of n texts, best first; (rows, at, w): unit vectors."""
        row = self.row[at]
        matrix = np.zeros((n, len(self.matrix)))
        matrix[rows[row >= 0], row[row >= 0]] = w[row >= 0]
        bound = np.zeros((n, self.n_blocks))
        for i in range(0, len(at), 1 << 14):
            own = rows[i : i + (1 << 14)]
            if len(own):
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                bound[own[first]] += np.add.reduceat(w[i : i + (1 << 14), None] * self.best[at[i : i + (1 << 14)]], first, axis=0)
        rare = row < 0
        rows, at, w = rows[rare], at[rare], w[rare]
        cosine = np.zeros((n, self.n_blocks * BLOCK))
        opened = np.arange(self.n_blocks) == bound.argmax(1)[:, None]
        self._open(cosine, opened, matrix, rows, at, w)
        k = min(self.k, cosine.shape[1])
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        self._open(cosine, ~opened & (bound > 0) & (bound >= least[:, None] - 1e-9), matrix, rows, at, w)
        cosine = np.round(cosine, 12)
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        text, example = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
        found = cosine[text, example]
        order = np.lexsort((example, -found, text))
        text, example, found = text[order], example[order], found[order]
        first = np.arange(len(text)) - np.searchsorted(text, text) < self.k
        return text[first], example[first], found[first]

    def score(self, rows: np.ndarray, at: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of n texts, and their nearest examples.

        Examples vote by squared cosine; the rate of label 1 counts as a tenth of a mean example's vote as near as the nearest.
        """
        text, example, cosine = self.nearest(rows, at, w, n)
        vote = cosine**2 * self.weights[example]
        first = np.searchsorted(text, np.arange(n + 1))
        top = np.where(first[1:] > first[:-1], cosine[np.minimum(first[:-1], max(0, len(cosine) - 1))], 1.0) if len(cosine) else np.ones(n)
        base = 0.1 * (float(self.weights.mean()) if self.n else 1.0) * top**2
        ones, all_ = np.bincount(text, vote * self.labels[example], n), np.bincount(text, vote, n)
        return (ones + base * self.prior) / (all_ + base), np.split(example, first[1:-1])


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: tuple[int, int], seed: int = 5) -> tuple[list, dict[int, int], DataFrame]:
    """About `per_label` rows (doc_id, text, toxic) of labels 0 and 1 by a hash of the id, how many rows have the label, and all of them."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    part = F.lit(False)
    for y, n in counts.items():
        part = part | ((F.col("toxic") == y) & (share < int((1 << 30) * min(1.0, per_label[y] / n))))
    chosen = F.broadcast(marked.where(part).orderBy("doc_id").limit(2 * sum(per_label)))  # bounded by the limit
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id").orderBy("doc_id", "text").limit(4 * sum(per_label)).collect()
    return rows, counts, marked


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: tuple[int, int] = (3000, 1000), k: int = 15) -> BlockMax:
    """The index over about `per_label` rows of labels 0 and 1; its document frequencies are counted over all docs."""
    rows, counts, marked = sample(docs, labels, usable, per_label)
    bags, ids, y = [], [], []
    known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for r in rows:
        own = np.uint64(fingerprint(r.text.encode()))
        if (np.bitwise_count(known[r.toxic] ^ own) <= COPY_BITS).any():
            continue  # copies, exact or near, would make all of their words stand out
        known[r.toxic] = np.append(known[r.toxic], own)
        raw = np.frombuffer(r.text.encode(), np.uint8)
        keys, n = np.unique(np.concatenate([h for h, _ in tokens(raw, np.array([0, len(raw)]))[0]]), return_counts=True)
        bags.append((keys, n.astype(np.int32)))
        ids.append(r.doc_id)
        y.append(r.toxic)
    del rows
    labels01 = np.array(y, int)
    weights = np.array([counts.get(c, 0) / max(1, y.count(c)) for c in (0, 1)])[labels01]
    prior = float((weights * labels01).sum() / max(1e-300, weights.sum()))
    terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in bags)]), return_counts=True)
    terms = terms[df >= 2]
    holds = np.zeros((2, len(terms)))
    for (keys, _), c in zip(bags, y):
        holds[c, np.searchsorted(terms, keys[np.isin(keys, terms, assume_unique=True)])] += 1
    n_docs, df = document_frequencies(docs, terms)
    weight = (np.log((1 + n_docs) / (1 + df)) + 1) * relevance(holds, y.count(0), y.count(1))
    return BlockMax(terms, weight, np.array(ids), labels01, weights, bags, k, prior)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of rows, and how many of them hold each of the sorted terms: counted over all rows, once a task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own = shared.value
        lookup, n, n_rows = Lookup(own.view(np.int64), np.arange(len(own))), np.zeros(len(own), np.int64), 0
        for batch in batches:
            n_rows += batch.num_rows
            for _, _, data, offsets in common.slices(batch.column(0)):
                rows, t = occurrences(lookup, data, offsets)
                n += np.bincount(np.unique(rows * np.int64(len(own) + 1) + t) % (len(own) + 1), minlength=len(own))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(n[held], n_rows))], names=["t", "n"])

    counted = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a term at most
    t, n = counted.column("t").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(terms))
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def occurrences(lookup: Lookup, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for each place of one of the terms, whose numbers `lookup` has."""
    kinds, limits = tokens(data, offsets)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, word in kinds if len(lookup.keys) else ():
        at = lookup.get(h.view(np.int64), -1).astype(np.int64)
        own = np.flatnonzero(at >= 0)
        rows.append(np.searchsorted(limits, word[own], "right") - 1)
        found.append(at[own])
    return np.concatenate(rows), np.concatenate(found)


def score(docs: DataFrame, index: BlockMax, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of docs(text, ...) with score and evidence (ids of the nearest examples, at most 3)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    frame = docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("text").alias("_text_"))
    kind = "long" if index.ids.dtype.kind != "U" else "string"

    def run(batches):
        own = shared.value
        lookup = Lookup(own.terms.view(np.int64), np.arange(len(own.terms)))
        many = np.int64(len(own.terms) + 1)
        for batch in batches:
            scores, evidence = np.full(batch.num_rows, own.prior), []
            for first, end, data, offsets in common.slices(batch.column(len(keep)), 1 << 19):
                rows, at = occurrences(lookup, data, offsets)
                pairs, count = np.unique(rows * many + at, return_counts=True)
                rows, at = pairs // many, pairs % many
                w = _unit(rows, (1 + np.log(count)) * own.weight[at], end - first)
                for i in range(first, end, 256):
                    j = min(i + 256, end)
                    a, b = np.searchsorted(rows, (i - first, j - first))
                    scores[i:j], examples = own.score(rows[a:b] - (i - first), at[a:b], w[a:b], j - i)
                    evidence += [own.ids[e[:3]].tolist() for e in examples]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(np.clip(scores, 0, 1)), pa.array(evidence, pa.list_(pa.int64() if kind == "long" else pa.string()))],
                names=[*(f"_{c}" for c in keep), "score", "evidence"],
            )

    types = ", ".join(f"`_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = frame.mapInArrow(run, f"{types}, score double, evidence array<{kind}>")
    return out.select(*(F.col(f"_{c}").alias(c) for c in keep), "score", "evidence")


def held_out() -> Column:
    """The fold whose labels are never learnt from; a row without doc_id isn't in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


THRESHOLD = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, common.table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
