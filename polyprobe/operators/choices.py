"""Choosing a class by probability mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polyprobe.functions import vectors as V
from polyprobe.functions.draws import draw_int


def choose(df: DataFrame, seed: int, id_cols: list[str], classes: str = "classes") -> DataFrame:
    """Add pred_class, pred_word, pred_gold_word, is_tie and is_invalid.

    The heaviest class wins.  Exact ties are drawn uniformly from the tied
    classes, keyed by seed and item, so the draw survives any repartitioning.
    A missing or NaN mass gives no prediction.
    """
    def leaders(c: Column) -> Column:
        return V.let(F.transform(c, lambda x: x["mass"]), lambda masses: F.when(
            (F.size(masses) > 0) & ~F.exists(masses, lambda m: m.isNull() | F.isnan(m)),
            V.let(F.array_max(masses), lambda top: F.filter(c, lambda x: x["mass"] == top))))

    draw = draw_int(seed, *[F.col(c) for c in id_cols])
    # (winner, number of leaders), both null without a valid set of masses.
    verdict = V.let(leaders(F.col(classes)), lambda tied: F.struct(
        F.get(tied, (draw % F.nullif(F.size(tied), F.lit(0))).cast("int")).alias("winner"),
        F.when(tied.isNotNull(), F.size(tied)).alias("n")))
    winner = F.col("_verdict.winner")
    return df.withColumn("_verdict", verdict).withColumns({
        "is_invalid": F.col("_verdict.n").isNull(),
        "is_tie": F.coalesce(F.col("_verdict.n") > 1, F.lit(False)),
        "pred_class": winner["class"], "pred_word": winner["word"], "pred_gold_word": winner["gold_word"],
    }).drop("_verdict")


def class_mass(cls: str, classes: str = "classes") -> Column:
    """Mass of one class out of the classes array."""
    return F.get(F.filter(classes, lambda c: c["class"] == cls), 0)["mass"]
