"""One registered query per operator, on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyprobe.llm import decontamination, extraction, lm_scoring, neardup, packing, piece_coding, pii, quality_classifier, quality_rules, spelling, suffix_dedup, token_alignment, toxicity
from polyprobe.llm.common import table


def op9_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(table(spark, sf_dir, "documents"), order=3)
    return found.withColumn("log_score", F.round("log_score", 3))


#: Key of the pseudonyms; a real corpus passes its own.
PII_KEY = "registered-query"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = suffix_dedup.repeated_bytes(docs).select(
        "digest", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", suffix_dedup.text_digest().alias("digest")).join(found, "digest").drop("digest")


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out(F.col("doc_id")))
    return toxicity.score_texts(docs, model).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # The written groups are as long as the texts; only their digest is kept.
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = token_alignment.with_link_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_groups(table(spark, sf_dir, "documents"), min_length=5, min_count=3, ratio=2, slip_every=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_template_extraction": op5_template_extraction,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_cotrained_quality": op9_cotrained_quality,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_piece_coding": op13_piece_coding,
}

ORACLE_SQL: dict[str, str] = {"op1_lm_scoring": lm_scoring.ORACLE_SQL}
