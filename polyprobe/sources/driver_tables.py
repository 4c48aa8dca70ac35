"""Evaluation sets, scores and hidden states derived from the given tables.

Texts stay whole and every row of a table takes part.  Keys are worked out on
ids alone; texts join last, once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyprobe import locales, schemas
from polyprobe.functions import vectors as V
from polyprobe.operators.candidates import FirstTokenizer, class_table
from polyprobe.operators.layout import shipped_if_small, spread
from polyprobe.operators.lens import lens_sets
from polyprobe.operators.positions import with_item_no
from polyprobe.sources import dimensions as dim

RUNS = [locales.Run("m1", "models/m1", "base"), locales.Run("m2", "models/m2", "extra")]
LOGIT_SCALE = {"m1": 20.0, "m2": 10.0}
N_LAYERS = 8
LAST_LAYER = N_LAYERS - 1
WIDTH = 64
HIDDEN_LAYERS = 2
TOKENS_PER_ITEM = 5
# Layer analysis sees the four languages of the documents as these.
LENS_LANG = {"en": "en", "de": "zh", "es": "ru", "fr": "is"}
# Stem handling needs a language whose answers share one.
STEM_LANG = {"en": "en", "de": "th", "es": "es", "fr": "fr"}

# ---- fixed values: vocabulary, token_id = position --------------------------
PIECES = (
    "<0xC3> <0xD0> <0xE0> <0xE3> <0xE6> <0xE7> p po pos posit positiv positive positivo positif ▁p ▁pos "
    "▁positive n ne neg negativ negative negativo né négatif ▁n ▁neg ▁negative 积 极 积极 消 消极 п по поз "
    "о от отри j já ▁j e ent entail ▁ent c con contra ▁con neutral ▁neutral s same ▁same d diff different "
    "▁diff o ox h horse ▁horse"
).split(" ")
# Letters the tokenizer of the "extra" family folds, after lower-casing.
FOLD_FROM = "áéíóúàèìòùâêîôûäëïöüñç"
FOLD_TO = "aeiouaeiouaeiouaeiounc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def relabel(lang: Column, mapping: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), lang)


# ---- dimensions -------------------------------------------------------------

def vocab(spark: SparkSession) -> DataFrame:
    return dim.vocab_table(spark, PIECES)


def load_folding_tokenizer() -> FirstTokenizer:
    """First token of a text for a tokenizer that folds it and takes the longest piece."""
    ids = {p: i for i, p in enumerate(PIECES)}
    longest = max(map(len, ids))
    table = str.maketrans(FOLD_FROM, FOLD_TO)

    def first(text: str) -> int | None:
        folded = text.lower().translate(table)
        return next((ids[folded[:n]] for n in range(min(longest, len(folded)), 0, -1) if folded[:n] in ids), None)

    # Folding never makes a text shorter, so no character beyond the longest piece matters.
    return FirstTokenizer(lambda texts: [first(t) for t in texts], longest)


FAMILIES = {"base": None, "extra": load_folding_tokenizer}


def classes(spark: SparkSession, task_modes, families=tuple(FAMILIES)) -> DataFrame:
    """Class table for some tasks and label modes; locale packs bound its size."""
    def build() -> DataFrame:
        return class_table(dim.answer_words(spark), vocab(spark), FAMILIES)

    wanted = [f"{task}/{mode}" for task, mode in task_modes]
    return dim.localize(spark, "classes", build).filter(
        F.concat_ws("/", "task", "label_mode").isin(wanted) & F.col("family").isin(list(families)))


def sets(spark: SparkSession, families=tuple(FAMILIES)) -> DataFrame:
    """Lens id sets per family and sentiment word."""
    def build() -> DataFrame:
        words = dim.answer_words(spark, [("sentiment", "native")])
        parts = [
            lens_sets(words, vocab(spark), load).withColumn("family", F.lit(family))
            for family, load in FAMILIES.items()
        ]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        return every

    return dim.localize(spark, "lens_sets", build).filter(F.col("family").isin(list(families)))


# ---- evaluation items -------------------------------------------------------

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, item_no, quality, toxic) of documents with a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return with_item_no(docs.join(labels, "doc_id"), ["lang"], "doc_id")


def sentiment_class() -> Column:
    return F.when(F.col("quality") == 1, "positive").otherwise("negative")


def nli_class() -> Column:
    return F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 1, "entailment").otherwise("neutral")


def with_answer(spark: SparkSession, keys: DataFrame, task: str, cls: Column) -> DataFrame:
    """Add task and the gold word of the item's class and language."""
    gold = dim.answer_words(spark, [(task, "english" if task == "pair" else "native")]).select(
        "task", "lang", F.col("class").alias("gold_class"), F.col("gold_word").alias("answer"))
    return keys.withColumn("task", F.lit(task)).withColumn("gold_class", cls).join(gold, ["task", "lang", "gold_class"])


def with_text(spark: SparkSession, sf_dir: str, keys: DataFrame, key: str = "doc_id", out: str = "text") -> DataFrame:
    """Add the whole text of the document ``key`` names; ``keys`` are narrow rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(key), F.col("text").alias(out))
    return docs.join(shipped_if_small(keys), key)


CLASS_OF = {"sentiment": sentiment_class, "nli": nli_class}


def labelled_keys(spark: SparkSession, sf_dir: str, tasks) -> DataFrame:
    """Keys and gold words of the tasks asked about single labelled documents."""
    asked = F.array(*[F.struct(F.lit(t).alias("task"), CLASS_OF[t]().alias("gold_class")) for t in tasks])
    gold = dim.answer_words(spark, [(t, "native") for t in tasks]).select(
        "task", "lang", F.col("class").alias("gold_class"), F.col("gold_word").alias("answer"))
    return labelled(spark, sf_dir).select("*", F.inline(asked)).join(gold, ["task", "lang", "gold_class"])


def sentiment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_keys(spark, sf_dir, ["sentiment"])


def eval_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(spark, sf_dir, sentiment_keys(spark, sf_dir), out="input")


def eval_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of a text are premise and hypothesis."""
    items = with_text(spark, sf_dir, labelled_keys(spark, sf_dir, ["nli"]))
    half = F.ceil(F.length("text") / 2).cast("int")
    return items.withColumn("premise", F.col("text").substr(F.lit(1), half)).withColumn(
        "hypothesis", F.col("text").substr(half + 1, F.length("text"))).drop("text")


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of a language, both labelled."""
    docs = with_item_no(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "pos")
    rated = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    following = rated.select(
        "lang", (F.col("pos") - 1).alias("pos"), F.col("doc_id").alias("next_id"),
        F.col("quality").alias("next_quality"))
    pairs = rated.join(following, ["lang", "pos"]).drop("pos")
    cls = F.when(F.col("quality") == F.col("next_quality"), "same").otherwise("different")
    return with_answer(spark, with_item_no(pairs, ["lang"], "doc_id"), "pair", cls)


def eval_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts are chosen by narrow keys; only chosen texts move to meet each other."""
    keys = pair_keys(spark, sf_dir)
    first = with_text(spark, sf_dir, keys, "doc_id", "sentence1")
    second = with_text(spark, sf_dir, keys.select(F.col("doc_id").alias("first_id"), "next_id"), "next_id", "sentence2")
    return first.join(second.select(F.col("first_id").alias("doc_id"), "sentence2"), "doc_id")


def lens_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = labelled(spark, sf_dir).withColumn("lang", relabel(F.col("lang"), LENS_LANG))
    return with_answer(spark, keys, "sentiment", sentiment_class())


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (lang, word) of all documents."""
    tokens = F.explode(F.split("text", r"[ \n\t\r]+"))
    return (
        table(spark, sf_dir, "documents").select("lang", tokens.alias("word"))
        .filter(F.length("word") > 0).distinct()
    )


# ---- scores, latents, hidden states -----------------------------------------

def latents(spark: SparkSession, sf_dir: str, items: DataFrame, layers: list[int] | None = None) -> DataFrame:
    """One stored vector per item and layer, as ``vec``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = vectors.agg(F.count(F.lit(1))).scalar()
    layer = F.explode(F.lit(list(range(N_LAYERS)) if layers is None else layers))
    slots = spread(items, ["doc_id"]).withColumn("layer", layer).withColumn(
        "vec_id", (F.col("doc_id") * N_LAYERS + F.col("layer")) % n)
    return slots.join(vectors, "vec_id").drop("vec_id")


def scores(
    spark: SparkSession, sf_dir: str, items: DataFrame, layers: list[int] | None = None, run_ids=("m1", "m2")
) -> DataFrame:
    """Logits of every item, layer and run."""
    runs = F.array(*[
        F.struct(F.lit(r.run_id).alias("run_id"), F.lit(r.family).alias("family"),
                 F.lit(LOGIT_SCALE[r.run_id]).alias("_scale"))
        for r in RUNS if r.run_id in run_ids
    ])
    stored = latents(spark, sf_dir, items, layers)
    return (
        stored.select("*", F.inline(runs))
        .withColumn("logits", V.scale(V.as_double(F.col("vec")), F.col("_scale")))
        .drop("vec", "_scale")
    )


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors (lang, item_no, layer, pos, vec) from the embedding rows."""
    span = TOKENS_PER_ITEM * HIDDEN_LAYERS
    item = F.floor(F.col("vec_id") / span)
    n_langs = len(locales.STACK_LANGUAGES)
    return table(spark, sf_dir, "embeddings").select(
        F.get(F.lit(list(locales.STACK_LANGUAGES)), (item % n_langs).cast("int")).alias("lang"),
        F.floor(F.col("vec_id") / (span * n_langs)).alias("item_no"),
        (F.floor(F.col("vec_id") / TOKENS_PER_ITEM) % HIDDEN_LAYERS).cast("int").alias("layer"),
        (F.col("vec_id") % TOKENS_PER_ITEM).cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def unembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding row as the readout row of one token."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("u"))


NORM_WEIGHT = [1.0 + i / WIDTH for i in range(WIDTH)]


# ---- a stand-in model -------------------------------------------------------

def _letter_waves(prompt: str, shift: float) -> np.ndarray:
    codes, counts = np.unique([ord(c) for c in prompt], return_counts=True)
    waves = np.cos(np.outer(codes, np.arange(1, WIDTH + 1) / WIDTH) + shift)
    return 10.0 * (counts @ waves) / counts.sum()


def load_scorer():
    """No language model is installed here, so prompts are scored by their letters."""
    return lambda prompts: np.stack([_letter_waves(p, 0.0) for p in prompts])
