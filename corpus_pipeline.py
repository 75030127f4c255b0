"""A corpus pipeline: language ID, exact deduplication, near-deduplication, packing.

Each stage takes the rows that the one before left, reread from Parquet, and all but the last return
the columns of ``documents``. No SQL can express the first stage (a fitted classifier), so there is no
SQL for the whole; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from langshift.llm import common, exact_dedup, langid, packing, shingles

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    common.small_batches(spark)
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the smallest id: SimHash fingerprints that meet in covering tables, links
    checked by five-word shingles and similarity 0.8; what differs in more bits is found by prefix filtering."""
    common.small_batches(spark)
    return shingles.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 1024 tokens."""
    common.small_batches(spark)
    return packing.pack(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
