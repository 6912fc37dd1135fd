"""Corpus cleaning: quality rules, near-dedup, exact substring dedup, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.packing import pack
from graphloom.llm.quality import keep_good
from graphloom.llm.secrets import redact_secrets
from graphloom.llm.simhash import drop_near_copies
from graphloom.llm.suffix import dedup
from graphloom.session import discard, materialize, scratch, ship_package, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows text where a stage changes it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and length rules keep."""
    ship_package(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return drop_near_copies(docs, size=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 100 bytes that start earlier in the corpus."""
    ship_package(spark)
    return _counted(dedup(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the name of the kind."""
    ship_package(spark)
    return _counted(redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    ship_package(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, suffix matches and packing aren't expressible in SQL; tests hold the first three stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet and read again by the next.

    A stage's scratch tables go when its rows are written, and those when the next stage's are.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as scope:
            docs = scope.keep(materialize(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
