"""Few-shot prompts by joining items to their locale pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_KEYS = ["task", "lang"]


def _ask(*lines: Column) -> Column:
    """Demonstrations, item lines and an open answer field."""
    opening = F.concat(F.col("answer_field"), F.lit(': "'))
    return F.concat_ws("\n", F.col("demo_block"), *lines, opening)


def _field(label: str, text: str) -> Column:
    return F.concat(F.col(label), F.lit(": "), F.col(text))


_LINES = {
    "sentiment": lambda: [F.col("input")],
    "nli": lambda: [_field("field1", "premise"), _field("field2", "hypothesis")],
    "pair": lambda: [_field("field1", "sentence1"), _field("field2", "sentence2")],
}


def with_prompt(items: DataFrame, locales: DataFrame, task: str) -> DataFrame:
    """Add label_mode, n_shots and prompt; one row per item and label mode."""
    packs = locales.filter(F.col("task") == task)
    return (
        items.join(packs, _KEYS)
        .withColumn("prompt", _ask(*_LINES[task]()))
        .drop("demo_block", "field1", "field2", "answer_field")
    )


def representation_prompts(items: DataFrame, locales: DataFrame, langs) -> DataFrame:
    """Native-label prompts for the languages of the representation analysis."""
    return with_prompt(
        items.filter(F.col("lang").isin(list(langs))),
        locales.filter((F.col("label_mode") == "native") & F.col("lang").isin(list(langs))),
        "sentiment",
    )
