"""A corpus from raw documents: the stages, in order, each working on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.llm import common, decontaminate, langid, mixing, simhash, toxicity
from critpath.runtime import checkpointed, give_back

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is rejected go; lang becomes the predicted one.

    A null or empty text, or one without a letter, is rejected. A null lang is predicted like any other. Rows are judged one by one, so
    repeated rows stay or go together; of equally likely languages the first in order is taken. An empty table stays empty; so does
    one without any lang to learn from.
    """
    give_back(spark)
    kept = langid.predict(docs, langid.fit(docs, ~langid.held_out()), keep=tuple(COLUMNS)).where("not rejected")
    give_back(spark)  # the training texts
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a toxicity score at the threshold or above go.

    Without labels every score is 0 and all stay. A null or empty text has the labels' mean score and a null doc_id is scored like
    any other; repeated rows stay or go together. A score just at the threshold goes.
    """
    give_back(spark)
    index = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, index, keep=tuple(COLUMNS))
    del index
    give_back(spark)  # the examples and the index, of which tasks have copies
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the document with the smallest doc_id stays.

    Rows are told apart by a 64-bit hash of the text, not by doc_id, which may be null or repeated. A null
    doc_id comes after all others; ties go to the smaller hash, then lang, source and n_chars. Texts without words, null ones
    too, are one group. An empty table stays empty.
    """
    give_back(spark)
    keyed = docs.withColumn("key", F.xxhash64("text"))
    groups = simhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    give_back(spark)  # plans and figures of the rounds
    rule = [F.col("doc_id").isNull().alias("unnamed"), *(F.col(c) for c in ("doc_id", "key", "lang", "source", "n_chars"))]
    # One row a text before any join, so that a text of very many copies is one row there.
    texts = keyed.select("key", F.struct(*rule).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    best = texts.join(groups, "key").groupBy("component_id").agg(F.min("row").alias("row"))
    best = best.select(*(F.col(f"row.{c}").alias(f"b_{c}") for c in ("doc_id", "key", "lang", "source", "n_chars")))
    same = F.col("key") == F.col("b_key")
    for c in ("doc_id", "lang", "source", "n_chars"):
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return keyed.join(best, same, "left_semi").dropDuplicates(["key"]).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a window of the benchmark go.

    A null or empty text holds none and stays, as does everything if the benchmark is empty; rows are judged one by one, whatever
    their ids.
    """
    give_back(spark)
    found = decontaminate.matches(docs, common.table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return found.where("n_hit = 0").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: how many words of each document the mix takes; documents of which it takes none go.

    A text without words has none to take. The null source is one of its own; repeated rows count as often as they stand. An
    empty table gives no rows.
    """
    give_back(spark)
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("non_toxic", non_toxic),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("mix_sources", mix_sources),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
