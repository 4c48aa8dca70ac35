"""Layer-wise readout analysis: which answers each layer leans to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from polyprobe.operators.candidates import candidate_ids
from polyprobe.operators.scoring import score_summary

MASSES = ("latent_mass", "out_mass", "any_latent_mass", "any_out_mass")
_IDS = ("latent_ids", "out_ids", "any_latent_ids", "any_out_ids")


def lens_sets(answer_words: DataFrame, vocab: DataFrame, load_tokenizer: Callable | None = None) -> DataFrame:
    """Id sets per (task, lang, word) of the native label mode.

    ``out`` is the word itself, ``latent`` the English word of the same class,
    ``any_*`` the union over all classes of the language or of English.
    """
    native = answer_words.filter(F.col("label_mode") == "native").select("task", "lang", "class", "word")
    own = candidate_ids(native, vocab, native.columns, "word", load_tokenizer).withColumnRenamed(
        "token_ids", "out_ids")
    union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("out_ids"))))
    any_out = own.groupBy("task", "lang").agg(union.alias("any_out_ids"))
    english = own.filter(F.col("lang") == "en").select(
        "task", "class", F.col("word").alias("latent_word"), F.col("out_ids").alias("latent_ids"))
    any_latent = any_out.filter(F.col("lang") == "en").select("task", F.col("any_out_ids").alias("any_latent_ids"))
    return (
        own.join(any_out, ["task", "lang"]).join(english, ["task", "class"]).join(any_latent, "task")
        .withColumn("overlap_ids", F.array_intersect("out_ids", "latent_ids"))
    )


def usable_sets(sets: DataFrame) -> DataFrame:
    """Words the analysis can tell apart from English: both id sets are
    non-empty and, outside English, disjoint."""
    return sets.filter(
        (F.size("out_ids") > 0) & (F.size("latent_ids") > 0)
        & ((F.col("lang") == "en") | (F.size("overlap_ids") == 0))
    )


def lens_filter(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Items whose gold word is usable, with their id sets.

    The condition depends on the word alone, so it is applied to the small
    side before the join.
    """
    return items.join(usable_sets(sets).withColumnRenamed("word", "answer"), ["task", "lang", "answer"])


def layer_metrics(
    scored: DataFrame, logits: str = "logits", width: int | None = None, backend: str = "auto"
) -> DataFrame:
    """Four masses, entropy and argmax of every (item, layer) row of logits."""
    summed = score_summary(scored, F.array(*_IDS), logits, "_summary", width, backend)
    return summed.select(
        *[c for c in scored.columns if c not in (logits, *_IDS)],
        *[F.get(F.col("_summary.masses"), i).alias(m) for i, m in enumerate(MASSES)],
        F.col("_summary.entropy").alias("entropy"), F.col("_summary.argmax_id").alias("argmax_id"),
    )


def entropy_profile(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("entropy").alias("entropy"))
