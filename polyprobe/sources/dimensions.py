"""Small configuration tables as DataFrames.

They are local relations, so the planner knows their exact size and picks a
broadcast join on its own.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from polyprobe import locales

_LOCALES = pa.schema([
    ("task", pa.string()), ("label_mode", pa.string()), ("lang", pa.string()),
    ("n_shots", pa.int32()), ("demo_block", pa.string()), ("field1", pa.string()),
    ("field2", pa.string()), ("answer_field", pa.string()),
])
_ANSWER_WORDS = pa.schema([
    ("task", pa.string()), ("label_mode", pa.string()), ("lang", pa.string()),
    ("class", pa.string()), ("word", pa.string()), ("gold_word", pa.string()),
])
_VOCAB = pa.schema([("token_id", pa.int32()), ("piece", pa.string())])
_RUNS = pa.schema([("run_id", pa.string()), ("model_uri", pa.string()), ("family", pa.string())])


def _frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def locale_table(spark: SparkSession, task_modes=locales.TASK_MODES) -> DataFrame:
    return _frame(spark, locales.locale_rows(task_modes), _LOCALES)


def answer_words(spark: SparkSession, task_modes=locales.TASK_MODES) -> DataFrame:
    return _frame(spark, locales.answer_word_rows(task_modes), _ANSWER_WORDS)


def vocab_table(spark: SparkSession, pieces: list[str]) -> DataFrame:
    return _frame(spark, [{"token_id": i, "piece": p} for i, p in enumerate(pieces)], _VOCAB)


def run_table(spark: SparkSession, runs: list[locales.Run]) -> DataFrame:
    return _frame(spark, [vars(r) for r in runs], _RUNS)


MAX_LOCAL_ROWS = 10_000
_derived: dict[str, pa.Table] = {}


def localize(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from configuration alone, computed once per process.

    It becomes a local relation of checked size; anything that could grow with
    the data is refused.
    """
    if name not in _derived:
        rows = build().limit(MAX_LOCAL_ROWS + 1).toArrow()
        if rows.num_rows > MAX_LOCAL_ROWS:
            raise ValueError(f"{name} has more than {MAX_LOCAL_ROWS} rows; join it as a table")
        _derived[name] = rows
    return spark.createDataFrame(_derived[name])
