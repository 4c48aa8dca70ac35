"""Pooled hidden states to components, scatter tables and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyprobe import locales
from polyprobe.operators import representation as rep
from polyprobe.operators.layout import materialize
from polyprobe.sources import driver_tables as src

ITEM_KEYS = ["layer", "lang", "item_no"]
BLOCK = 500
BUCKET_WIDTH = 100


def pooled(spark: SparkSession, sf_dir: str, layer: int | None = None) -> DataFrame:
    hidden = src.hidden(spark, sf_dir)
    return rep.mean_pool(hidden if layer is None else hidden.filter(F.col("layer") == layer), ITEM_KEYS)


def projected(spark: SparkSession, sf_dir: str, k: int, layer: int | None = None) -> DataFrame:
    """Pooled vectors along the first k components of their layer, all layers or one."""
    # Read by the means, the sums and the projection.
    vectors = materialize(pooled(spark, sf_dir, layer), "pooled")
    components = rep.principal_components(vectors, ["layer"], k)
    return rep.project(vectors, components, ["layer"]).drop("vec")


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = projected(spark, sf_dir, 2)
    return xy.select(*ITEM_KEYS, F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


def pearson(spark: SparkSession, sf_dir: str, layer: int | None = None) -> DataFrame:
    first = projected(spark, sf_dir, 1, layer).select(*ITEM_KEYS, F.get("coords", F.lit(0)).alias("x"))
    return rep.pearson_pairs(first, ["layer"], locales.PEARSON_PAIRS, "x")
