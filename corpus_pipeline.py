"""Corpus pipeline: from documents to token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravet.llm import bpe, decontaminate, near_dup, quality, secrets
from terravet.llm.common import read, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return near_dup.without_near_duplicates(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret that was found."""
    length = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))
    return secrets.cleaned(docs, secrets.train(docs)).withColumn("n_chars", length)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, bpe.default_vocabulary(), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("quality", keep_good), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_leaks),
          ("secrets", redact_secrets), ("bpe", tokenize)]

#: Models, edit distances and merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
