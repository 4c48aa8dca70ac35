"""Layer-wise readout analysis from stored scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyprobe.operators import lens, stats
from polyprobe.operators.scoring import score_summary
from polyprobe.sources import driver_tables as src

LAYER_KEYS = ["run_id", "lang", "layer"]
ITEM_KEYS = ["run_id", "lang", "item_no", "layer"]


def metrics(spark: SparkSession, sf_dir: str, run_ids=("m1", "m2")) -> DataFrame:
    """Four masses, entropy and argmax per run, usable item and layer."""
    families = sorted({r.family for r in src.RUNS if r.run_id in run_ids})
    usable = lens.usable_sets(src.sets(spark, families)).withColumnRenamed("word", "answer")
    # Items no family can use are dropped before their scores are fetched.
    items = src.lens_items(spark, sf_dir).drop("quality", "toxic")
    wanted = items.join(usable.select("task", "lang", "answer").distinct(), ["task", "lang", "answer"], "left_semi")
    scored = src.scores(spark, sf_dir, wanted, run_ids=run_ids)
    return lens.layer_metrics(scored.join(usable, ["family", "task", "lang", "answer"]), width=src.WIDTH)


def all_item_entropy(spark: SparkSession, sf_dir: str, run_ids=("m1", "m2")) -> DataFrame:
    """Entropy per run, item and layer over all items, numbered without gaps."""
    items = src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no")
    scored = src.scores(spark, sf_dir, items, run_ids=run_ids)
    none = F.array().cast("array<array<int>>")
    return score_summary(scored, none, width=src.WIDTH).select(
        *ITEM_KEYS, F.col("summary.entropy").alias("entropy"), F.col("summary.argmax_id").alias("argmax_id"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and interval of the four masses and of entropy, per run, language and layer."""
    return stats.ci_gaussian(metrics(spark, sf_dir), LAYER_KEYS, [*lens.MASSES, "entropy"])
