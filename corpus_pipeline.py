"""A corpus pipeline: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import exact_dedup, language_id, minhash_dedup, packing, pii
from loomframe.llm.common import durable, table

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told by a known word or n-gram at least, so texts without letters or in a
    script that no learnt language has go; the model learns from `docs`. Without labelled rows nothing can be told."""
    mark = "_language"
    while mark in docs.columns:
        mark += "_"
    judged = language_id.with_language(docs, language_id.fit(docs), mark)
    return judged.filter(F.col(f"{mark}.n_known") > 0).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens of the 50k byte-level BPE."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: No stage but the second can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what the one before it kept, written as Parquet in between."""
    return reduce(lambda docs, stage: durable(stage[1](spark, docs, sf_dir)), STAGES, table(spark, sf_dir, "documents"))
