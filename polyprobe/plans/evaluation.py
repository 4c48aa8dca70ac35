"""Constrained-choice evaluation: scores to predictions to accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyprobe.functions.text import is_prompt_prefix, strip_prompt
from polyprobe.operators import matching
from polyprobe.operators.choices import choose
from polyprobe.operators.prompts import with_prompt
from polyprobe.operators.scoring import with_class_masses
from polyprobe.sources import dimensions as dim, driver_tables as src

SEED = 42
ITEM = ["run_id", "task", "label_mode", "lang", "item_no"]
GRID = (("sentiment", "native"), ("sentiment", "english"), ("sentiment", "unrelated"),
        ("nli", "english"), ("pair", "english"))
TASKS = ("sentiment", "nli", "pair")


def item_keys(spark: SparkSession, sf_dir: str, tasks) -> DataFrame:
    """Keys and gold words of the items of several tasks, without texts."""
    cols = ["task", "lang", "item_no", "doc_id", "answer"]
    single = [t for t in src.CLASS_OF if t in tasks]
    parts = [src.labelled_keys(spark, sf_dir, single).select(*cols, "quality", "toxic")] if single else []
    if "pair" in tasks:
        parts.append(src.pair_keys(spark, sf_dir).select(*cols, "quality", F.lit(None).cast("int").alias("toxic")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def massed(spark: SparkSession, sf_dir: str, grid, run_ids=("m1", "m2")) -> DataFrame:
    """Probability mass of every class, per run, item and label mode.

    ``grid`` lists (task, label mode) pairs.  All tasks meet the stored scores
    in one join and the class table in another.
    """
    families = sorted({r.family for r in src.RUNS if r.run_id in run_ids})
    keys = item_keys(spark, sf_dir, {task for task, _ in grid})
    scored = src.scores(spark, sf_dir, keys, [src.LAST_LAYER], run_ids)
    classes = src.classes(spark, grid, families)
    return with_class_masses(scored.join(classes, ["family", "task", "lang"]), width=src.WIDTH)


def predict(with_masses: DataFrame, seed: int = SEED) -> DataFrame:
    picked = choose(with_masses, seed, ITEM)
    return picked.withColumn("correct", matching.is_correct(
        F.col("label_mode"), F.col("pred_word"), F.col("pred_gold_word"), F.col("answer")))


def predictions(spark: SparkSession, sf_dir: str, grid=GRID, run_ids=("m1", "m2")) -> DataFrame:
    return predict(massed(spark, sf_dir, grid, run_ids))


def accuracy(predicted: DataFrame, locales: DataFrame) -> DataFrame:
    """Set size, shots, correct answers and accuracy per run, task, mode and language."""
    keys = ["run_id", "task", "label_mode", "lang"]
    counted = predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("correct").alias("n_correct"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"))
    shots = locales.select("task", "label_mode", "lang", "n_shots")
    return counted.join(shots, ["task", "label_mode", "lang"])


def with_outputs(spark: SparkSession, sf_dir: str, predicted: DataFrame) -> DataFrame:
    """Sentiment predictions as full model outputs, prompt included.

    Toxic items stand for models that do not follow the format: good ones
    continue with free text, bad ones do not repeat the prompt.  Without a
    prediction the model says nothing.
    """
    texts = src.with_text(spark, sf_dir, src.table(spark, sf_dir, "labels").select("doc_id"), out="input")
    asked = with_prompt(
        predicted.join(texts, "doc_id"),
        dim.locale_table(spark, [("sentiment", "native")]).drop("label_mode"), "sentiment")
    proper = F.concat("prompt", F.coalesce("pred_word", F.lit("")))
    output = (
        F.when(F.col("toxic") == 0, proper)
        .when(F.col("quality") == 1, F.concat("prompt", "input"))
        .otherwise(F.concat(F.lit("# "), proper))
    )
    out = asked.withColumn("output", output)
    return out.withColumn("is_prefix", is_prompt_prefix(F.col("output"), F.col("prompt"))).withColumn(
        "answer_text", strip_prompt(F.col("output"), F.col("prompt")))


def diagnostics(outputs: DataFrame, shared_ids: DataFrame) -> DataFrame:
    """Counts of everything that is not a clean prediction."""
    words = F.transform("classes", lambda c: c["word"])
    counted = outputs.groupBy("run_id", "family", "task", "label_mode", "lang").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("is_tie").alias("n_ties"),
        F.count_if("is_invalid").alias("n_invalid"),
        F.count_if(matching.wrong_format(F.col("answer_text"), words)).alias("n_wrong_format"),
        F.count_if(~F.col("is_prefix")).alias("n_prefix_errors"),
        F.count_if(F.col("answer") == "").alias("n_gold_empty"),
    )
    return counted.join(shared_ids, ["family", "task", "label_mode", "lang"]).drop("family")


def shared_id_counts(classes: DataFrame) -> DataFrame:
    """How many ids all classes of a language have in common."""
    ids = F.transform("classes", lambda c: c["token_ids"])
    common = F.reduce(ids, F.get(ids, 0), lambda a, b: F.array_intersect(a, b))
    return classes.select("family", "task", "label_mode", "lang", F.size(common).alias("n_shared_ids"))
