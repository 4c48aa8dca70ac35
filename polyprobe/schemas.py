"""Explicit schemas; nothing in the engine infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _item(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in (*fields, "answer")])


# Element schema of an evaluation file, by task.
EVAL_ITEM = {
    "sentiment": _item("input"),
    "nli": _item("premise", "hypothesis"),
    "pair": _item("sentence1", "sentence2"),
}


def eval_table(task: str) -> T.StructType:
    """Flat table of evaluation items of one task, language kept as a column."""
    head = [
        T.StructField("task", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("item_no", T.LongType()),
    ]
    return T.StructType(head + EVAL_ITEM[task].fields)


# Analysis set as written to CSV: the id lists are JSON text.
GAP_TABLE = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("item_no", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("out_token_id", T.StringType()),
    T.StructField("out_token_str", T.StringType()),
    T.StructField("latent_token_id", T.StringType()),
    T.StructField("latent_token_str", T.StringType()),
])


# The given tables.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
