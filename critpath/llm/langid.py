"""Operator 7: language identification with averaged hashed subword embeddings.

Byte 3- and 4-grams of the letters of a text (anything else counts as a blank) are hashed to
rows of an embedding; their mean goes through a linear softmax. Both are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows. A temperature,
fitted on a fifth of the sample that training does not see, calibrates the probabilities, and a
threshold on them rejects texts like no training text.

Since the mean and the softmax's matrix commute, embedding and matrix are multiplied once
and a text is scored by summing one row a gram; whole texts are read.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; rows
without text or language are not learnt from; without anything to learn from all are `und`. Of equally likely languages the first in order is
taken; repeated rows are predicted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UND = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, all else blanks, with a blank before and after each text; offsets of the texts with their blanks."""
    n = np.diff(offsets)
    out = np.full(len(data) + 2 * len(n), 0x20, np.uint8)
    moved = offsets + 2 * np.arange(len(offsets))
    at = np.arange(len(data)) + np.repeat(moved[:-1] + 1 - offsets[:-1], n)
    out[at] = _FOLD[data]
    return out, moved


def gram_rows(data: np.ndarray, bits: int):
    """Hashed rows of the 3-grams and 4-grams at each position, and which of them count."""
    x = data.astype(np.uint32)
    blank = data == 0x20
    for k in (3, 4):
        n = len(x) - k + 1
        if n <= 0:
            continue
        key = x[:n].copy()
        for j in range(1, k):
            key = (key << np.uint32(8)) | x[j : j + n]
        yield k, (key * np.uint32(2654435761 if k == 3 else 2246822519)) >> np.uint32(32 - bits), ~blank[1 : 1 + n]


class Model:
    """Rows of summed scores for each language; langs in code-point order."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, bits: int, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.bits = langs, table, bias, bits
        self.temperature, self.threshold = temperature, threshold

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        own, moved = folded(data, offsets)
        n, sums, count = len(moved) - 1, np.zeros((len(moved) - 1, len(self.langs))), np.zeros(len(moved) - 1)
        for k, rows, counts in gram_rows(own, self.bits):
            low = np.minimum(moved[:-1], len(rows))
            high = np.maximum(np.minimum(moved[1:] - k + 1, len(rows)), low)
            run = np.zeros(len(rows) + 1)
            np.cumsum(counts, out=run[1:])
            count += run[high] - run[low]
            for c in range(len(self.langs)):
                np.cumsum(np.where(counts, self.table[c][rows], np.float32(0)), dtype=np.float64, out=run[1:])
                sums[:, c] += run[high] - run[low]
        logits = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], bits: int = 15, dim: int = 16, epochs: int = 6, batch: int = 64, rate: float = 4.0, seed: int = 1, reject: float = 0.001) -> Model:
    """Fits embedding and softmax on four fifths of the texts, temperature and threshold on the rest."""
    langs = sorted(set(labels))
    target = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        own, _ = folded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        rows = np.concatenate([r[c] for _, r, c in gram_rows(own, bits)] or [np.zeros(0, np.uint32)])
        at, n = np.unique(rows, return_counts=True)
        bags.append((at.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    order = rng.permutation(len(texts))
    cut = max(1, len(order) // 5) if len(order) > 5 else 0
    held, used = order[:cut], order[cut:]
    emb = rng.normal(0, 0.3, (1 << bits, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)

    def dense(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows in use, and the texts' shares of them."""
        rows = np.unique(np.concatenate([bags[i][0] for i in part]))
        x = np.zeros((len(part), len(rows)), np.float32)
        for j, i in enumerate(part):
            x[j, np.searchsorted(rows, bags[i][0])] = bags[i][1]
        return rows, x

    for epoch in range(epochs):
        used, step = rng.permutation(used), rate * (1 - epoch / epochs)
        for i in range(0, len(used), batch):
            part = used[i : i + batch]
            rows, x = dense(part)
            mean = x @ emb[rows]
            logits = mean @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            p /= len(part)
            grad = p @ w.T
            w -= step * mean.T @ p
            b -= step * 0.1 * p.sum(0)
            emb[rows] -= step * 8 * (x.T @ grad)
    model = Model(langs, np.ascontiguousarray((emb @ w).T.astype(np.float32)), b.astype(np.float64), bits, 1.0, 0.0)
    if cut:
        logits = []
        for i in range(0, len(held), batch):
            rows, x = dense(held[i : i + batch])
            logits.append(x @ (emb[rows] @ w) + b)
        logits = np.concatenate(logits).astype(np.float64)

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float(-(z[np.arange(len(held)), target[held]] - np.log(np.exp(z).sum(1))).mean())

        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        z = logits / model.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        best = (e / e.sum(1, keepdims=True)).max(1)
        # A threshold that so small a share of known texts falls under, and never one that rejects a clear majority.
        model.threshold = float(min(np.quantile(best, reject), 0.5))
    return model


def sample(docs: DataFrame, usable: Column, per_lang: int, most_chars: int, max_langs: int, seed: int = 3) -> list:
    """(text, lang) of about `per_lang` labelled rows of each language; more than `max_langs` languages are an error.

    Of a text longer than `most_chars` three pieces are taken, one from a seeded place in each third of it.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    counts = rows.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    part = F.lit(False)
    for r in counts:
        part = part | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, per_lang / r["count"]))))
    third, piece = F.floor(F.length("text") / 3), most_chars // 3
    start = lambda i: F.lit(1) + third * i + F.pmod(F.xxhash64(F.lit(seed + 1 + i), "doc_id", F.length("text")), F.greatest(third - piece, F.lit(1)))
    pieces = F.concat_ws(" ", *(F.col("text").substr(start(i).cast("int"), F.lit(piece)) for i in range(3)))
    kept = rows.where(part).select("doc_id", F.when(F.length("text") <= most_chars, F.col("text")).otherwise(pieces).alias("text"), "lang")
    return kept.orderBy("doc_id", "text", "lang").limit(2 * per_lang * max(1, len(counts))).collect()


def fit(docs: DataFrame, usable: Column, per_lang: int = 800, most_chars: int = 3000, max_langs: int = 400) -> Model | None:
    """A model from a bounded sample: `per_lang` rows a language, about `most_chars` of each from all over it; None if there is none to learn from."""
    rows = sample(docs, usable, per_lang, most_chars, max_langs)
    # Half of the rows are learnt from as short pieces too, so that short texts get honest scores.
    texts, langs = [r.text.encode() for r in rows], [r.lang for r in rows]
    for r in rows[::2]:
        texts.append(" ".join(r.text.split()[:4]).encode())
        langs.append(r.lang)
    return train(texts, langs) if rows else None


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of docs(text, ...) with lang_pred, score and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    frame = docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("text").alias("_text_"))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = common.array_of(batch.column(len(keep)))
            pred, score, rejected = [], [], []
            for i, j, data, offsets in common.slices(texts):
                letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]) > 0
                p = own.scores(data, offsets) if own else None
                for d in range(j - i):
                    has = letters[d] or (offsets[d + 1] > offsets[d] and any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))))
                    if not has or p is None:
                        pred.append(UND)
                        score.append(0.0)
                        rejected.append(True)
                        continue
                    best = int(p[d].argmax())
                    pred.append(own.langs[best])
                    score.append(float(p[d, best]))
                    rejected.append(bool(p[d, best] < own.threshold))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*(f"_{c}" for c in keep), "lang_pred", "score", "rejected"],
            )

    types = ", ".join(f"`_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = frame.mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean")
    return out.select(*(F.col(f"_{c}").alias(c) for c in keep), "lang_pred", "score", "rejected")


def held_out() -> Column:
    """The fold that is never learnt from; a row without doc_id isn't in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
