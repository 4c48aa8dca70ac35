"""Comparing predictions with gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def match_native(output: Column, answer: Column) -> Column:
    """The output starts with the gold word; an empty gold word always matches."""
    return F.coalesce(F.startswith(output, answer), F.lit(False))


def match_mapped(pred_gold_word: Column, answer: Column) -> Column:
    """The predicted class, named in the item's language, is the gold word."""
    return F.coalesce(pred_gold_word == answer, F.lit(False))


def is_correct(label_mode: Column, pred_word: Column, pred_gold_word: Column, answer: Column) -> Column:
    return F.when(label_mode == "native", match_native(pred_word, answer)).otherwise(
        match_mapped(pred_gold_word, answer))


def wrong_format(output: Column, words: Column) -> Column:
    """No class word begins the output."""
    return ~F.exists(words, lambda w: F.startswith(output, w))


def matched_class(output: Column, classes: Column) -> Column:
    """First class whose word begins a free-form output, null if none."""
    return F.get(F.filter(classes, lambda c: F.startswith(output, c["word"])), 0)


def gold_to_class(items: DataFrame, answer_words: DataFrame) -> DataFrame:
    """Add gold_class and latent_word, the English word of that class.

    Unknown gold words keep nulls.
    """
    native = answer_words.filter(F.col("label_mode") == "native")
    english = native.filter(F.col("lang") == "en").select("task", "class", F.col("word").alias("latent_word"))
    lookup = native.join(english, ["task", "class"]).select(
        "task", "lang", F.col("word").alias("answer"), F.col("class").alias("gold_class"), "latent_word")
    return items.join(lookup, ["task", "lang", "answer"], "left")
