"""Operator 2: URL filters with segmented host words and naive Bayes.

Rules decide first: the longest that fits. All other urls are judged by a multinomial naive
Bayes over the words of host and path, learnt from the urls that rules decide. Host labels
are names run together; they are split by a unigram Viterbi search whose word counts come from
the visible text of all pages. Counts of a label's substrings reach it by a join, so the
vocabulary is never gathered. The classes' token counts are hashed to a fixed number of
buckets, which bounds the model.

Defined results: a null url, or one without `://`, has empty host and path and no words, and
gets the more common class (allow if there is none); repeated rows are judged one by one. Of splits that are
equally likely the one with the longer last word is taken, and of equal odds allow. An empty table gives no rows. A label of any length is split
whole, in time that grows with its length. Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.runtime import give_back

from . import common

#: (verdict, rule): host, then path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
LONGEST_WORD = 24
BUCKETS = 1 << 18
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_WORD = re.compile(r"[a-z]+")
_PATH_WORD = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: runs of a-z, lower-cased, in the visible text of all pages."""

    def run(batches):
        for batch in batches:
            own: Counter[str] = Counter()
            for page in batch.column(0).to_pylist():
                if page:
                    own.update(w for w in _WORD.findall(_TAG.sub(" ", page).lower()) if len(w) <= LONGEST_WORD)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name; an unknown word of length L has chance 10 / (total * 10^L)."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    log_total = math.log(max(1, total))
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            w = name[start:end]
            p = (math.log(counts[w]) if w in counts else (1 - len(w)) * math.log(10)) - log_total
            if best[start][0] + p > best[end][0]:
                best[end] = best[start][0] + p, start
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segment(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """label, words for every distinct label of labels(label); only runs of a-z are split."""
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    labels = labels.select("label").distinct()
    parts = labels.select(
        "label",
        F.explode(
            F.expr(f"""flatten(transform(sequence(1, greatest(1, length(label))), i ->
                transform(sequence(1, greatest(1, least({LONGEST_WORD}, length(label) - i + 1))), n -> substring(label, i, n))))""")
        ).alias("word"),
    ).distinct()
    # A label has a bounded number of substrings; single letters stand in very many labels.
    found = common.spread_join(common.checkpointed(parts), vocabulary, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches):
        for batch in batches:
            out = []
            for label, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = {x["word"]: x["n"] for x in known or ()}
                words: list[str] = []
                for run in re.findall(r"[a-z]+|[^a-z]+", label):
                    words += viterbi(run, counts, total) if run[0].isascii() and run[0].isalpha() else [run]
                out.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return labels.join(found, "label", "left").mapInArrow(split, "label string, words array<string>")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def tokens(words: Sequence[str] | None, path: str) -> list[str]:
    """Features: host words and path words, apart; numbers by their length only."""
    plain = lambda w: f"#{len(w)}" if w.isdigit() else w.lower()
    return [f"h:{plain(w)}" for w in words or ()] + [f"p:{plain(w)}" for w in _PATH_WORD.findall(path)]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_hosts: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block, host_words for every row of pages(page_id, url, html)."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    verdict = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v))) if rules else None
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    seen = seen.withColumn("ruled", verdict[F.col("rule")] if rules else F.lit(None).cast("string"))
    hosts = seen.select("host").where("host <> ''").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("at", "label"))
    words = segment(labels, common.checkpointed(word_counts(pages)))
    by_host = labels.join(words, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("own"))  # a host has few labels
    by_host = common.checkpointed(by_host.select("host", F.flatten(F.col("own.words")).alias("host_words")))
    if by_host.count() <= most_hosts:
        by_host = F.broadcast(by_host)
    marked = seen.join(by_host, "host", "left").select("page_id", "host", "path", "rule", "ruled", "host_words")

    def count(batches):
        n = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for words_of, p, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = n[int(v == "block")]
                own[BUCKETS] += 1
                for t in tokens(words_of, p):
                    own[bucket(t)] += 1
        y, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(b), pa.array(n[y, b])], names=["y", "b", "n"])

    learnt = marked.where("ruled is not null").select("host_words", "path", "ruled").mapInArrow(count, "y long, b long, n long")
    n = np.zeros((2, BUCKETS + 1))
    for r in learnt.groupBy("y", "b").agg(F.sum("n").alias("n")).collect():  # at most 2 * (BUCKETS + 1) rows
        n[r.y, r.b] = r.n
    per_class, counts = n[:, BUCKETS], n[:, :BUCKETS]
    used = max(1, int((counts.sum(0) > 0).sum()))
    log_p = np.log(counts + 1) - np.log(counts.sum(1, keepdims=True) + used)
    shared = spark.sparkContext.broadcast((log_p[1] - log_p[0], math.log((per_class[1] + 0.5) / (per_class[0] + 1))))

    def score(batches):
        odds, prior = shared.value
        for batch in batches:
            z = np.array([prior + sum(odds[bucket(t)] for t in tokens(w, p)) for w, p in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist())], float)
            p_block = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            verdicts = [r or ("block" if x > 0 else "allow") for r, x in zip(batch.column(4).to_pylist(), z)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(p_block), batch.column(5)],
                names=["page_id", "host", "path", "rule", "verdict", "p_block", "host_words"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return marked.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, p_block double, host_words array<string>")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    give_back(spark)  # what earlier queries of the session left in the executors' heaps counts as this one's memory
    return judge(common.table(spark, sf_dir, "pages"))
