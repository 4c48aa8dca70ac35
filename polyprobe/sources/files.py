"""Readers and writers for evaluation sets and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from polyprobe import schemas
from polyprobe.sources import json_arrays

def read_eval_arrays(
    spark: SparkSession, path: str, task: str, langs: list[str] | None = None, range_bytes: int = json_arrays.RANGE_BYTES
) -> DataFrame:
    """Evaluation sets kept as JSON arrays, one file per language, position kept as item_no.

    Large files are read by many tasks; the files of other tasks and
    languages are not planned.
    """
    found = json_arrays.read_json_arrays(spark, path, [task], langs, range_bytes)
    return found.select("task", "lang", "item_no", F.from_json("value", schemas.EVAL_ITEM[task]).alias("item")).select(
        "task", "lang", "item_no", "item.*")


def write_eval_arrays(items: DataFrame, path: str, task: str) -> DataFrame:
    """One JSON array per language, named as ``read_eval_arrays`` expects, in the order of item_no."""
    fields = schemas.EVAL_ITEM[task].names
    named = items.select(F.format_string(f"{task}_%s_test.json", "lang").alias("document"), "item_no", *fields)
    return json_arrays.write_json_documents(named, path, "document", ["item_no"], fields)


def write_eval_table(items: DataFrame, path: str) -> None:
    """Parquet partitioned by task and language."""
    items.write.partitionBy("task", "lang").parquet(path)


def read_eval_table(spark: SparkSession, path: str, task: str, langs: list[str] | None = None) -> DataFrame:
    """Read back one task; a language choice prunes partitions."""
    items = spark.read.schema(schemas.eval_table(task)).parquet(path).filter(F.col("task") == task)
    return items if langs is None else items.filter(F.col("lang").isin(list(langs)))


def id_list_json(ids: Column) -> Column:
    return F.to_json(ids)


# Text cells may hold quotes, line breaks and outer blanks; keep all of them.
_CSV = {
    "header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_gap_csv(gap: DataFrame, path: str) -> None:
    """Analysis set as CSV files, one folder per model family and language."""
    gap.select(
        "family", "lang", "item_no", "prompt",
        id_list_json(F.col("out_token_id")).alias("out_token_id"), "out_token_str",
        id_list_json(F.col("latent_token_id")).alias("latent_token_id"), "latent_token_str",
    ).write.partitionBy("family", "lang").options(**_CSV).csv(path)


def read_gap_csv(spark: SparkSession, path: str) -> DataFrame:
    folders = [schemas.GAP_TABLE[c] for c in ("family", "lang")]
    body = [f for f in schemas.GAP_TABLE.fields if f not in folders]
    return (
        spark.read.schema(T.StructType([*body, *folders]))
        .options(**_CSV, multiLine="true").csv(path)
        .select(*schemas.GAP_TABLE.names)
    )


def write_json(result: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One JSON object per line, UTF-8 left unescaped."""
    result.write.partitionBy(*partition_by).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON lines, or whole-file JSON documents with ``multi_line``."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)
