"""From raw documents to packed training sequences: five stages, each written and read again.

Quality rules, near-duplicates and decontamination drop documents; the PII
stage rewrites texts; packing returns the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from polyprobe.llm import decontamination, neardup, packing, pii, quality_rules
from polyprobe.llm.common import stored

#: Key of the pseudonyms; a real corpus passes its own.
PII_KEY = "corpus-pipeline"


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    own = docs.alias("own")
    chosen = ids.select("doc_id").distinct().alias("chosen")
    return own.join(chosen, F.col("own.doc_id").eqNullSafe(F.col("chosen.doc_id")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie far outside their language and source."""
    return _only(docs, quality_rules.judge(docs).where("kept"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each near-duplicate group (five-word shingles, 0.8)."""
    return _only(docs, neardup.near_duplicates(docs, size=5, percent=80).where("kept"), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item, also with other numbers, names or units."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _only(docs, decontamination.leaks(docs, benchmark), "left_anti")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets inside the texts; n_chars follows the text."""
    masked = pii.mask(docs, PII_KEY, count_col=None)
    return masked.withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all documents in sequences of 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("pii", pseudonymise), ("packing", pack)]

#: Robust estimates, pseudonyms and tokens are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
