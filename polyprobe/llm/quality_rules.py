"""Quality rules: robust multivariate outliers among text statistics, per language and source.

Each language and source gets a minimum-covariance-determinant estimate of the
centre and spread of four transformed statistics; a document far from its
group's centre in Mahalanobis distance is rejected.  Concentration steps run on
all documents of all groups at once: distances are cut into fine logarithmic
classes, moments are summed per (group, class), and the next subset is the run
of smallest classes that holds ``SUBSET`` of the group.  A step shuffles at most
a few hundred class rows per group and task, so a group may hold any share of
the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from polyprobe.llm.common import stored
from polyprobe.llm.textstats import with_counts

#: Log of the mean word length; square roots of the shares of symbols per word character, of repeated lines, and of
#: words in repeated three-word windows.
VECTOR = ("x1", "x2", "x3", "x4")
#: Spread below which a difference in a statistic says nothing about quality.  It is added to the estimated spread, so
#: a group in which a statistic never varies (its covariance is singular) still measures distances.
RESOLUTION = (0.06, 0.04, 0.05, 0.05)
#: Sampling noise of x3 and x4 in a text: the root of a share among n has variance 1 / 4n, and words repeat by threes.
#: It is added for each document by its own lines and words.
NOISE = (("v3", "n_lines", 0.25), ("v4", "n_words", 0.75))
#: Share of a group in the subset of smallest determinant, and chance that a regular document is rejected.
SUBSET = 0.75
TAIL = 1e-4
#: A group with fewer documents borrows the estimate of its language, a small language that of the whole table.
MIN_GROUP = 50
STEPS = 8
_CLASSES_PER_DOUBLING = 16
_MEDIAN_GRID = 1024


def _chi2_tail(x: float, half: int) -> float:
    """Upper tail of chi-squared with ``2 * half`` degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _chi2_point(tail: float, half: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_tail(mid, half) > tail else (low, mid)
    return high


_HALF = len(VECTOR) // 2
_CUT = _chi2_point(1 - SUBSET, _HALF)
#: Makes the spread of the central subset consistent for regular data.
CONSISTENCY = SUBSET / (1 - _chi2_tail(_CUT, _HALF + 1))
LIMIT = _chi2_point(TAIL, _HALF)
_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
_ESTIMATE = "g string, n double, centre array<double>, precision array<double>"


def transformed(counts: DataFrame) -> DataFrame:
    """Add the statistic vector; a text without words has the zero vector."""
    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return counts.withColumns({
        "x1": F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0))),
        "x2": share("n_symbols", "word_chars"), "x3": share("n_dup_lines", "n_lines"),
        "x4": share("n_repeat_words", "n_words"),
        **{v: F.lit(scale) / F.greatest(F.col(n), F.lit(1)) for v, n, scale in NOISE}})


def _median_start(rows: DataFrame) -> DataFrame:
    """First estimate: medians of each statistic on a fine grid, and the resolution as spread."""
    cells = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(x) * _MEDIAN_GRID) for x in VECTOR]))
                        .alias("dim", "cell")).groupBy("g", "dim", "cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("g", "dim")
    cells = cells.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    medians = cells.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "dim") \
        .agg(((F.min("cell") + 0.5) / _MEDIAN_GRID).alias("m"))
    centre = medians.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col("m"))).alias(f"m{i}")
                                        for i in range(len(VECTOR))])
    start = [0.0] * len(VECTOR) ** 2
    for i, r in enumerate(RESOLUTION):
        start[i * len(VECTOR) + i] = 1 / r ** 2
    return centre.select("g", F.lit(0.0).alias("n"), F.array(*[f"m{i}" for i in range(len(VECTOR))]).alias("centre"),
                         F.array(*[F.lit(v) for v in start]).alias("precision"))


def distance(centre: Column, precision: Column, noise: bool = True) -> Column:
    """Squared Mahalanobis distance of the row's statistic vector; ``noise`` adds the row's v3 and v4 to the spread."""
    d = [F.col(x) - centre[i] for i, x in enumerate(VECTOR)]
    k = len(VECTOR)
    plain = sum((d[i] * d[j] * precision[i * k + j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))
    if not noise:
        return plain
    # The inverse of the spread with more on two diagonal places (Woodbury).
    u, v = (sum((precision[i * k + j] * d[j] for j in range(k)), F.lit(0.0)) for i in (2, 3))
    a, b = 1 / F.col("v3") + precision[2 * k + 2], 1 / F.col("v4") + precision[3 * k + 3]
    c = precision[2 * k + 3]
    return plain - (u * u * b - 2 * u * v * c + v * v * a) / (a * b - c * c)


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse spread from summed moments, one row per group."""
    k = len(VECTOR)

    def run(frames):
        for frame in frames:
            n = frame["n"].to_numpy()[:, None]
            first = np.stack([frame[f"s{i}"].to_numpy() for i in range(k)], 1) / n
            spread = np.zeros((len(frame), k, k))
            for i, j in _PAIRS:
                spread[:, i, j] = spread[:, j, i] = (
                    frame[f"p{i}{j}"].to_numpy() / n[:, 0] - first[:, i] * first[:, j]) * factor
            spread += np.diag(np.square(RESOLUTION))
            inverse = np.linalg.inv(spread) if len(frame) else spread
            yield pd.DataFrame({"g": frame["g"], "n": n[:, 0], "centre": list(first),
                                "precision": list(inverse.reshape(len(frame), k * k))})

    return sums.mapInPandas(run, _ESTIMATE)


def _step(rows: DataFrame, estimate: DataFrame, within: float | None) -> DataFrame:
    """Next estimate: from the central ``SUBSET`` of each group, or from all rows within a distance."""
    away = rows.join(estimate.drop("n"), "g").withColumn(
        "d", distance(F.col("centre"), F.col("precision"), "v3" in rows.columns))
    moments = [F.sum(F.col(x)).alias(f"s{i}") for i, x in enumerate(VECTOR)] + \
        [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    if within is not None:
        return _estimates(away.where(F.col("d") <= within).groupBy("g")
                          .agg(F.count("*").cast("double").alias("n"), *moments), 1.0)
    # Classes start at distance 2**-10; anything nearer is central in any case.
    away = away.withColumn("c", F.floor(F.log2(F.greatest("d", F.lit(2.0 ** -10))) * _CLASSES_PER_DOUBLING))
    classes = away.groupBy("g", "c").agg(F.count("*").cast("double").alias("n"), *moments)
    by = Window.partitionBy("g")
    central = classes.withColumn("before", F.sum("n").over(by.orderBy("c")) - F.col("n")) \
        .withColumn("all", F.sum("n").over(by)).where(F.col("before") < SUBSET * F.col("all"))
    names = [f"s{i}" for i in range(len(VECTOR))] + [f"p{i}{j}" for i, j in _PAIRS]
    return _estimates(central.groupBy("g").agg(*[F.sum(c).alias(c) for c in ["n", *names]]), CONSISTENCY)


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of every group ``g``."""
    estimate = stored(_median_start(rows), "mcd")
    for _ in range(steps):
        estimate = stored(_step(rows, estimate, None), "mcd")
    return stored(_step(rows, estimate, _chi2_point(0.01, _HALF)), "mcd")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base verdict, distance and final verdict of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (null where the base already failed)
    and kept.  Estimates come from all rows that pass the base.  A null text
    counts nothing and fails the base; a null language or source is a group of
    its own; repeated rows are judged each by itself; other columns are
    ignored; an empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.to_json(F.struct(F.col(lang_col).alias("l"))).alias("lang"),
                        F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s"))).alias("own"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = stored(transformed(with_counts(named, "text", ["doc_id", "lang", "own"]))
                  .withColumn("base_failed", base), "textstats")
    sound = rows.where(~F.col("base_failed"))
    large = sound.groupBy("own").count().where(F.col("count") >= MIN_GROUP).select("own", F.lit(True).alias("big"))
    large_lang = sound.groupBy("lang").count().where(F.col("count") >= MIN_GROUP) \
        .select("lang", F.lit(True).alias("big_lang"))
    groups = sound.select("lang", "own").distinct().join(large, "own", "left").join(large_lang, "lang", "left") \
        .select("own", F.when(F.col("big"), F.col("own")).when(F.col("big_lang"), F.col("lang"))
                .otherwise(F.lit("all")).alias("g"))
    groups = stored(groups, "groups")
    # A borrowed estimate rests on all rows of the language or table, not only on the small groups.
    levels = sound.select(F.explode(F.array("own", "lang", F.lit("all"))).alias("g"), *VECTOR, "v3", "v4") \
        .join(groups.select("g").distinct(), "g", "left_semi")
    estimates = robust_estimates(stored(levels, "vectors"))
    judged = rows.join(groups, "own", "left").join(estimates.drop("n"), "g", "left") \
        .withColumn("distance", F.when(~F.col("base_failed"), distance(F.col("centre"), F.col("precision"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "distance", (F.coalesce(F.col("distance") <= LIMIT, F.lit(False))).alias("kept"))
