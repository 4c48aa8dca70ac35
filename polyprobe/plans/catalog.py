"""Every query by name, over the tables in a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from polyprobe import locales
from polyprobe.functions import text as X, words as W
from polyprobe.functions.draws import draw_int
from polyprobe.operators import (
    batch, candidates as cand, choices, layout, lens, matching, positions, prompts, readout, representation as rep,
    sampling, scoring, stats, training,
)
from polyprobe.plans import evaluation as ev, lens as lp, representation as rp
from polyprobe.session import scratch_path
from polyprobe.sources import dimensions as dim, driver_tables as src, files, json_arrays

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BOOTSTRAP_RESAMPLES = 9999
BOOTSTRAP_SEED = 7
TIE_SEED = 7
SAMPLE_SEED = 11
TEMPERATURE = 0.7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def listed(col: Column | str, sep: str = "|") -> Column:
    return F.array_join(F.col(col) if isinstance(col, str) else col, sep)


# ---- sources and sinks ------------------------------------------------------

@query
def scan_eval_single(spark, sf_dir):
    return src.eval_single(spark, sf_dir).select("task", "lang", "item_no", "input", "answer")


@query
def scan_eval_nli(spark, sf_dir):
    return src.eval_nli(spark, sf_dir).select("task", "lang", "item_no", "premise", "hypothesis", "answer")


@query
def scan_eval_pair(spark, sf_dir):
    return src.eval_pair(spark, sf_dir).select("task", "lang", "item_no", "sentence1", "sentence2", "answer")


@query
def scan_lang_subset(spark, sf_dir):
    return scan_eval_single(spark, sf_dir).filter(F.col("lang").isin("en", "fr"))


@query
def run_grid(spark, sf_dir):
    """Registry x languages of the data."""
    langs = src.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    runs = F.array(*[
        F.struct(F.lit(r.run_id).alias("run_id"), F.lit(r.model_uri).alias("model_uri"),
                 F.lit(r.family).alias("family")) for r in src.RUNS
    ])
    return langs.select(F.inline(runs), "lang", "n_docs")


def _gap(spark, sf_dir):
    items = lens.lens_filter(src.lens_items(spark, sf_dir), src.sets(spark))
    asked = prompts.with_prompt(
        src.with_text(spark, sf_dir, items, out="input"), dim.locale_table(spark, [("sentiment", "native")]), "sentiment")
    return asked.select(
        "family", "lang", "item_no", "prompt", F.col("out_ids").alias("out_token_id"), F.col("answer").alias("out_token_str"),
        F.col("latent_ids").alias("latent_token_id"), F.col("latent_word").alias("latent_token_str"))


@query
def sink_gap_csv(spark, sf_dir):
    path = scratch_path(spark, "gap-csv")
    files.write_gap_csv(_gap(spark, sf_dir), path)
    return files.read_gap_csv(spark, path)


@query
def sink_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "eval-json")
    items = scan_eval_single(spark, sf_dir)
    files.write_json(items, path, ("task", "lang"))
    return files.read_json(spark, path, T.StructType(items.schema.fields)).select(*items.columns)


ARRAY_RANGE_BYTES = 1 << 20


def _eval_arrays(spark, sf_dir, sets):
    """Evaluation sets written as JSON arrays, one file per task and language."""
    path = scratch_path(spark, "eval-arrays")
    for task, build in sets.items():
        files.write_eval_arrays(build(spark, sf_dir), path, task)
    return path


@query
def scan_eval_arrays(spark, sf_dir):
    """All three kinds of sets from JSON arrays, large files read by many tasks."""
    path = _eval_arrays(spark, sf_dir, {"sentiment": src.eval_single, "nli": src.eval_nli, "pair": src.eval_pair})
    every = json_arrays.read_json_arrays(spark, path, range_bytes=ARRAY_RANGE_BYTES)
    fields = {"input": "string", "premise": "string", "hypothesis": "string", "sentence1": "string",
              "sentence2": "string", "answer": "string"}
    item = F.from_json("value", ", ".join(f"{n} {t}" for n, t in fields.items()))
    return every.select("task", "lang", "item_no", item.alias("item")).select("task", "lang", "item_no", "item.*")


@query
def scan_lang_arrays(spark, sf_dir):
    """Two languages of the sentiment sets; the other files are never planned."""
    path = _eval_arrays(spark, sf_dir, {"sentiment": src.eval_single})
    every = files.read_eval_arrays(spark, path, "sentiment", range_bytes=ARRAY_RANGE_BYTES)
    return every.filter(F.col("lang").isin("en", "fr"))


@query
def sink_json_document(spark, sf_dir):
    """Outcomes of every run as one JSON document each, read back."""
    path = scratch_path(spark, "outcomes")
    columns = ["run_id", "lang", "item_no", "answer", "pred_word", "correct"]
    told = match_native(spark, sf_dir).withColumn("document", F.concat("run_id", F.lit(".json")))
    json_arrays.write_json_documents(told.select("document", *columns), path, "document", ["lang", "item_no"])
    back = json_arrays.read_json_arrays(spark, path, range_bytes=ARRAY_RANGE_BYTES)
    kinds = "run_id string, lang string, item_no bigint, answer string, pred_word string, correct boolean"
    return back.select(F.col("item_no").alias("place"), F.from_json("value", kinds).alias("r")).select("place", "r.*")


# ---- prompts ----------------------------------------------------------------

_PROMPT = ["task", "label_mode", "lang", "item_no", "n_shots", "prompt"]


@query
def prompt_single(spark, sf_dir):
    return prompts.with_prompt(src.eval_single(spark, sf_dir), dim.locale_table(spark), "sentiment").select(*_PROMPT)


@query
def prompt_nli(spark, sf_dir):
    packs = dim.locale_table(spark, [("nli", "english")])
    return prompts.with_prompt(src.eval_nli(spark, sf_dir), packs, "nli").select(*_PROMPT)


@query
def prompt_pair(spark, sf_dir):
    packs = dim.locale_table(spark, [("pair", "english")])
    return prompts.with_prompt(src.eval_pair(spark, sf_dir), packs, "pair").select(*_PROMPT)


@query
def prompt_repr(spark, sf_dir):
    return prompts.representation_prompts(
        src.eval_single(spark, sf_dir), dim.locale_table(spark), locales.REPRESENTATION_LANGUAGES).select(
        "lang", "item_no", "prompt")


# ---- candidate pieces -------------------------------------------------------

@query
def token_prefixes(spark, sf_dir):
    words = src.corpus_words(spark, sf_dir)
    return words.select("lang", "word", listed(W.token_prefixes(F.col("word"))).alias("prefixes"))


@query
def space_variants(spark, sf_dir):
    words = src.corpus_words(spark, sf_dir)
    return words.select(
        "lang", "word", listed(W.with_word_start(W.token_prefixes(F.col("word")))).alias("variants"))


@query
def byte_fallback(spark, sf_dir):
    return src.corpus_words(spark, sf_dir).select("lang", "word", W.byte_fallback_piece(F.col("word")).alias("piece"))


@query
def candidate_ids(spark, sf_dir):
    ids = cand.candidate_ids(src.corpus_words(spark, sf_dir), src.vocab(spark), ["lang", "word"])
    return ids.select("lang", "word", listed(F.col("token_ids").cast("array<string>"), ",").alias("token_ids"))


@query
def candidate_ids_family(spark, sf_dir):
    ids = cand.candidate_ids(
        src.corpus_words(spark, sf_dir), src.vocab(spark), ["lang", "word"], load_tokenizer=src.load_folding_tokenizer)
    return ids.select("lang", "word", listed(F.col("token_ids").cast("array<string>"), ",").alias("token_ids"))


@query
def ids_to_pieces(spark, sf_dir):
    ids = cand.candidate_ids(src.corpus_words(spark, sf_dir), src.vocab(spark), ["lang", "word"])
    return cand.ids_to_pieces(ids, src.vocab(spark), ["lang", "word"]).select(
        "lang", "word", listed("pieces").alias("pieces"))


@query
def forced_stem(spark, sf_dir):
    """Prompts that end in the stem shared by the answers, candidates from the rest."""
    keys = src.labelled(spark, sf_dir).withColumn("lang", src.relabel(F.col("lang"), src.STEM_LANG))
    items = src.with_text(spark, sf_dir, src.with_answer(spark, keys, "sentiment", src.sentiment_class()), out="input")
    asked = prompts.with_prompt(items, dim.locale_table(spark, [("sentiment", "native")]), "sentiment")
    table = src.classes(spark, [("sentiment", "native")])
    ids = F.transform("classes", lambda c: F.concat_ws(":", c["class"], F.array_join(c["token_ids"].cast("array<string>"), ",")))
    return asked.join(table, ["task", "label_mode", "lang"]).select(
        "family", "lang", "item_no", "stem", F.concat("prompt", "stem").alias("prompt"), listed(ids).alias("class_ids"))


@query
def candidate_overlap(spark, sf_dir):
    """Ids an item's gold word shares with its English counterpart."""
    items = src.lens_items(spark, sf_dir).withColumn("word", F.col("answer"))
    joined = items.join(src.sets(spark), ["task", "lang", "word"])
    return joined.select(
        "family", "lang", "item_no",
        listed(F.sort_array("overlap_ids").cast("array<string>"), ",").alias("overlap_ids"),
        F.size("overlap_ids").alias("n_overlap"))


# ---- outputs and matching ---------------------------------------------------

def _native_outputs(spark, sf_dir):
    return ev.with_outputs(spark, sf_dir, ev.predictions(spark, sf_dir, [("sentiment", "native")]))


@query
def strip_prompt(spark, sf_dir):
    return _native_outputs(spark, sf_dir).select("run_id", "lang", "item_no", "is_prefix", "answer_text")


@query
def wrong_format(spark, sf_dir):
    words = F.transform("classes", lambda c: c["word"])
    answer = F.col("answer_text")
    return _native_outputs(spark, sf_dir).select(
        "run_id", "lang", "item_no", matching.wrong_format(answer, words).alias("is_wrong"),
        matching.matched_class(answer, F.col("classes"))["class"].alias("said_class"))


@query
def extract_dictionary(spark, sf_dir):
    """Event properties as free text: some without braces, some nested."""
    quoted = F.replace(F.col("props"), F.lit('"'), F.lit("'"))
    body = (
        F.when(F.col("event_type") == "error", F.replace(quoted, F.lit("{"), F.lit("")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("{'a': "), quoted, F.lit("}")))
        .otherwise(F.concat(F.lit("\n"), quoted, F.lit("\n{}")))
    )
    free = src.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("noise "), body, F.lit(" tail")).alias("text"))
    found = free.withColumn("d", X.extract_dictionary(F.col("text")))
    return found.select(
        "event_id", F.col("d").isNotNull().alias("found"),
        listed(F.array_sort(F.map_keys("d"))).alias("names"), F.try_element_at("d", F.lit("k")).alias("k"))


@query
def match_native(spark, sf_dir):
    return ev.predictions(spark, sf_dir, [("sentiment", "native")]).select(
        "run_id", "lang", "item_no", "pred_word", "answer", "correct")


@query
def match_mapped(spark, sf_dir):
    return ev.predictions(spark, sf_dir, [(task, "english") for task in ev.TASKS]).select(
        "run_id", "task", "lang", "item_no", "pred_word", "answer", "correct")


@query
def match_unrelated(spark, sf_dir):
    return ev.predictions(spark, sf_dir, [("sentiment", "unrelated")]).select(
        "run_id", "lang", "item_no", "pred_word", "answer", "correct")


@query
def gold_to_latent(spark, sf_dir):
    """Gold words to English; toxic items carry a word no table knows."""
    items = src.lens_items(spark, sf_dir).drop("gold_class").withColumn(
        "answer", F.when(F.col("toxic") == 1, F.upper("answer")).otherwise(F.col("answer")))
    return matching.gold_to_class(items, dim.answer_words(spark, [("sentiment", "native")])).select(
        "lang", "item_no", "answer", "gold_class", "latent_word")


# ---- scoring ----------------------------------------------------------------

@query
def softmax_last(spark, sf_dir):
    items = src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no")
    scored = src.scores(spark, sf_dir, items, [src.LAST_LAYER])
    probs = F.posexplode(scoring.softmax(F.col("logits"))).alias("token_id", "prob")
    return scored.select("run_id", "lang", "item_no", probs).withColumn(
        "prob", r6("prob"))


@query
def class_mass(spark, sf_dir):
    return ev.massed(spark, sf_dir, [("sentiment", "native")]).select(
        "run_id", "lang", "item_no", F.inline("classes")).select(
        "run_id", "lang", "item_no", "class", r6("mass").alias("mass"))


@query
def choose_two_way(spark, sf_dir):
    return ev.predictions(spark, sf_dir, [("sentiment", "native")]).select(
        "run_id", "lang", "item_no", r6(choices.class_mass("positive")).alias("positive_mass"),
        r6(choices.class_mass("negative")).alias("negative_mass"), "pred_class", "is_tie")


@query
def choose_three_way(spark, sf_dir):
    return ev.predictions(spark, sf_dir, [("nli", "english")]).select(
        "run_id", "lang", "item_no", r6(choices.class_mass("entailment")).alias("entailment_mass"),
        r6(choices.class_mass("neutral")).alias("neutral_mass"),
        r6(choices.class_mass("contradiction")).alias("contradiction_mass"), "pred_class", "is_tie")


@query
def tie_break(spark, sf_dir):
    """Masses to one decimal tie often."""
    coarse = F.transform("classes", lambda c: c.withField("mass", F.round(c["mass"], 1)))
    rounded = ev.massed(spark, sf_dir, [("nli", "english")]).withColumn("classes", coarse)
    return choices.choose(rounded, TIE_SEED, ev.ITEM).select("run_id", "lang", "item_no", "is_tie", "pred_class")


@query
def accuracy_by_lang(spark, sf_dir):
    predicted = ev.predictions(spark, sf_dir, [("sentiment", "native")])
    return ev.accuracy(predicted, dim.locale_table(spark)).select(
        "run_id", "lang", "n_items", "n_shots", "n_correct", r6("accuracy").alias("accuracy"))


@query
def accuracy_grid(spark, sf_dir):
    return ev.accuracy(ev.predictions(spark, sf_dir), dim.locale_table(spark)).select(
        "run_id", "task", "label_mode", "lang", "n_items", "n_shots", "n_correct", r6("accuracy").alias("accuracy"))


@query
def eval_diagnostics(spark, sf_dir):
    """Counts of what goes wrong, with scores made NaN and gold words emptied in every tenth item each."""
    digit = F.col("item_no") % 10
    bad = F.transform("classes", lambda c: c.withField("mass", F.when(digit == 3, F.lit(float("nan"))).otherwise(c["mass"])))
    hurt = ev.massed(spark, sf_dir, [("sentiment", "native")]).withColumn("classes", bad).withColumn(
        "answer", F.when(digit == 7, "").otherwise(F.col("answer")))
    outputs = ev.with_outputs(spark, sf_dir, ev.predict(hurt))
    shared = ev.shared_id_counts(src.classes(spark, [("sentiment", "native")]))
    return ev.diagnostics(outputs, shared)


# ---- layer-wise readout -----------------------------------------------------

@query
def lens_filter(spark, sf_dir):
    kept = lens.lens_filter(src.lens_items(spark, sf_dir), src.sets(spark))
    ids = {c: listed(F.col(c).cast("array<string>"), ",").alias(c) for c in ("out_ids", "latent_ids")}
    return kept.select("family", "lang", "item_no", "answer", "latent_word", *ids.values())


@query
def layer_entropy(spark, sf_dir):
    return lp.all_item_entropy(spark, sf_dir).select(*lp.ITEM_KEYS, r6("entropy").alias("entropy"))


@query
def wide_entropy(spark, sf_dir):
    """All layers of an item side by side as one distribution over 512 tokens, with the mass of each layer's share."""
    items = src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no")
    vectors = src.latents(spark, sf_dir, items).groupBy("lang", "item_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", "vec"))), lambda s: s["vec"])).alias("logits"))
    shares = F.lit([list(range(k * src.WIDTH, (k + 1) * src.WIDTH)) for k in (0, src.LAST_LAYER)])
    scored = scoring.score_summary(vectors, shares, width=src.N_LAYERS * src.WIDTH)
    return scored.select("lang", "item_no", r6("summary.entropy").alias("entropy"), "summary.argmax_id",
                         r6(F.get("summary.masses", F.lit(0))).alias("first_mass"),
                         r6(F.get("summary.masses", F.lit(1))).alias("last_mass"))


@query
def layer_mass_gold(spark, sf_dir):
    return lp.metrics(spark, sf_dir).select(
        *lp.ITEM_KEYS, r6("latent_mass").alias("latent_mass"), r6("out_mass").alias("out_mass"))


@query
def layer_mass_any(spark, sf_dir):
    return lp.metrics(spark, sf_dir).select(
        *lp.ITEM_KEYS, r6("any_latent_mass").alias("any_latent_mass"), r6("any_out_mass").alias("any_out_mass"))


@query
def entropy_profile(spark, sf_dir):
    return lens.entropy_profile(lp.all_item_entropy(spark, sf_dir), lp.LAYER_KEYS).select(
        *lp.LAYER_KEYS, r6("entropy").alias("entropy"))


@query
def lens_profile(spark, sf_dir):
    return lp.profile(spark, sf_dir).select(
        *lp.LAYER_KEYS, "metric", "n", r6("mean").alias("mean"), r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def ci_gaussian(spark, sf_dir):
    ci = stats.ci_gaussian(lp.all_item_entropy(spark, sf_dir), lp.LAYER_KEYS, ["entropy"])
    return ci.select(*lp.LAYER_KEYS, "n", r6("mean").alias("y"), r6("lower").alias("y_lower"), r6("upper").alias("y_upper"))


@query
def ci_quantile(spark, sf_dir):
    ci = stats.ci_quantile(layout.materialize(lp.all_item_entropy(spark, sf_dir), "entropy"), lp.LAYER_KEYS, "entropy")
    return ci.select(*lp.LAYER_KEYS, *[r6(c).alias(c) for c in ("y", "y_lower", "y_upper")])


@query
def ci_bootstrap(spark, sf_dir):
    ci = stats.ci_bootstrap(
        layout.materialize(lp.all_item_entropy(spark, sf_dir), "entropy"), ["run_id", "lang"], "layer", "entropy",
        resamples=BOOTSTRAP_RESAMPLES, seed=BOOTSTRAP_SEED)
    return ci.select(*lp.LAYER_KEYS, *[r6(c).alias(c) for c in ("y", "y_lower", "y_upper")])


@query
def argmax_piece(spark, sf_dir):
    tops = lp.all_item_entropy(spark, sf_dir).withColumnRenamed("argmax_id", "token_id")
    return tops.join(src.vocab(spark), "token_id").select(*lp.ITEM_KEYS, "token_id", "piece")


def _all_scores(spark, sf_dir):
    items = src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no")
    return src.scores(spark, sf_dir, items).select(*lp.ITEM_KEYS, "logits")


@query
def topk_pieces(spark, sf_dir):
    return sampling.top_pieces(_all_scores(spark, sf_dir), src.vocab(spark)).select(
        *lp.ITEM_KEYS, "rank", "token_id", "piece", "percent")


@query
def sample_token(spark, sf_dir):
    seed = [F.lit(str(SAMPLE_SEED)), *[F.col(k) for k in lp.ITEM_KEYS]]
    scored = _all_scores(spark, sf_dir)
    return scored.select(
        *lp.ITEM_KEYS, sampling.sample_token(F.col("logits"), TEMPERATURE, *seed).alias("token_id"),
        sampling.sample_token(F.col("logits"), 0).alias("greedy_id"))


# ---- readout matrix ---------------------------------------------------------

def _latents(spark, sf_dir):
    return src.latents(spark, sf_dir, src.labelled(spark, sf_dir).select("doc_id", "lang", "item_no"))


def _readout(spark, sf_dir, **options):
    keys = ["lang", "item_no", "layer"]
    # Sized by bytes, the join leaves few tasks for work that grows with latents x tokens.
    latents = layout.spread(_latents(spark, sf_dir), keys)
    return readout.readout_logits(latents, keys, src.unembed(spark, sf_dir), src.NORM_WEIGHT, **options)


@query
def readout_logits(spark, sf_dir):
    """Logits over the whole readout matrix, summarised per item and layer."""
    return _readout(spark, sf_dir, entropy=False).select(
        "lang", "item_no", "layer", F.col("n_tokens").cast("int").alias("n_tokens"), r6("low").alias("low"),
        r6("high").alias("high"), r6("mean").alias("mean"), "top_id")


@query
def lens_from_latents(spark, sf_dir):
    """Latents through norm and readout matrix to entropy bands per language and layer."""
    ci = stats.ci_gaussian(_readout(spark, sf_dir), ["lang", "layer"], ["entropy"])
    return ci.select("lang", "layer", "n", r6("mean").alias("mean"), r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def unembed_normalized(spark, sf_dir):
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    return rows.select("token_id", F.posexplode("unit").alias("i", "u")).withColumn("u", r6("u"))


def _gram(spark, sf_dir):
    rows = readout.unembed_normalized(src.unembed(spark, sf_dir), src.NORM_WEIGHT)
    return rows, readout.gram_matrix(rows)


@query
def gram_matrix(spark, sf_dir):
    return _gram(spark, sf_dir)[1].select("i", "j", r6("g").alias("g"))


@query
def gram_scale(spark, sf_dir):
    rows, gram = _gram(spark, sf_dir)
    return readout.gram_scale(gram, rows).select("n_tokens", r6("scale").alias("scale"))


@query
def layer_energy(spark, sf_dir):
    keys = ["lang", "item_no", "layer"]
    return readout.layer_energy(_latents(spark, sf_dir), keys, _gram(spark, sf_dir)[0]).select(
        *keys, r6("energy").alias("energy"))


# ---- representation ---------------------------------------------------------

@query
def mean_pool(spark, sf_dir):
    return rp.pooled(spark, sf_dir).select(*rp.ITEM_KEYS, F.posexplode("vec").alias("i", "x")).withColumn("x", r6("x"))


@query
def covariance_matrix(spark, sf_dir):
    cov = rep.covariance_matrix(layout.materialize(rp.pooled(spark, sf_dir), "pooled"), ["layer"])
    return cov.select("layer", "i", "j", r6("cov").alias("cov"))


@query
def pca_project(spark, sf_dir):
    return rp.scatter(spark, sf_dir).select(*rp.ITEM_KEYS, r6("x").alias("x"), r6("y").alias("y"))


@query
def pearson_pairs(spark, sf_dir):
    """One layer, the last one stored."""
    return rp.pearson(spark, sf_dir, src.HIDDEN_LAYERS - 1).select(
        "lang_a", "lang_b", "n_items", r6("r").alias("r"))


@query
def pearson_by_layer(spark, sf_dir):
    return rp.pearson(spark, sf_dir).select("layer", "lang_a", "lang_b", "n_items", r6("r").alias("r"))


@query
def segment_by_lang(spark, sf_dir):
    stacked = rep.stack_languages(rp.scatter(spark, sf_dir), locales.STACK_LANGUAGES, ["layer"])
    return stacked.select("layer", "stacked_no", "segment", r6("x").alias("x"), r6("y").alias("y"))


@query
def segment_by_bucket(spark, sf_dir):
    """Index ranges pooled over all languages."""
    return rep.segment_by_bucket(rp.scatter(spark, sf_dir), rp.BUCKET_WIDTH).select(
        "layer", "segment", "lang", "item_no", r6("x").alias("x"), r6("y").alias("y"))


@query
def head_per_lang(spark, sf_dir):
    """First items of every language, in stacking order of the analysis."""
    return positions.head_per_group(src.sentiment_keys(spark, sf_dir), rp.BLOCK).select("lang", "item_no", "doc_id", "answer")


# ---- batch model jobs -------------------------------------------------------

def _asked(spark, sf_dir):
    asked = prompts.with_prompt(
        src.eval_single(spark, sf_dir), dim.locale_table(spark, [("sentiment", "native")]), "sentiment")
    return layout.spread(asked.select("lang", "item_no", "prompt"), ["lang", "item_no"])


@query
def batch_score(spark, sf_dir):
    scored = batch.score_prompts(_asked(spark, sf_dir), src.load_scorer)
    return scored.select("lang", "item_no", F.posexplode("logits").alias("token_id", "logit")).withColumn(
        "logit", r6("logit"))


@query
def batch_accuracy(spark, sf_dir):
    """The whole evaluation with scores computed on the spot and stored once, for every family's candidates."""
    items = src.eval_single(spark, sf_dir).drop("quality", "toxic")
    packs = dim.locale_table(spark, [("sentiment", "native")])
    asked = layout.spread(prompts.with_prompt(items, packs, "sentiment").select(
        "task", "label_mode", "lang", "item_no", "answer", "prompt"), ["lang", "item_no"])
    stored = layout.materialize(batch.score_prompts(asked, src.load_scorer).drop("prompt"), "scores")
    scored = stored.join(src.classes(spark, [("sentiment", "native")]), ["task", "label_mode", "lang"]).withColumn(
        "run_id", F.concat(F.lit("letters-"), "family"))
    predicted = ev.predict(scoring.with_class_masses(scored, width=src.WIDTH))
    return ev.accuracy(predicted, dim.locale_table(spark)).select(
        "run_id", "lang", "n_items", "n_shots", "n_correct", r6("accuracy").alias("accuracy"))


# ---- training sets ----------------------------------------------------------

TARGETS = ("de", "es", "fr")
SPLIT_SEED, SAMPLE_SIZE_SEED = "split", "sample"
HELD_OUT = 0.05
SAMPLES = 100
MAX_TOKENS = 2048


def _pairs(spark, sf_dir):
    return training.aligned_pairs(src.labelled(spark, sf_dir), "en", list(TARGETS))


@query
def translation_pairs(spark, sf_dir):
    """The English item as input, the same item in another language as output; a missing side stays null."""
    pairs = _pairs(spark, sf_dir)
    told = F.concat(F.lit("Say the same in the language "), "lang", F.lit("."))
    sides = pairs.select("lang", "item_no", told.alias("instruction"))
    for side, out in (("source", "input"), ("target", "output")):
        chosen = src.with_text(spark, sf_dir, pairs.select("lang", "item_no", side).where(F.col(side).isNotNull()), side, out)
        sides = sides.join(chosen.drop(side), ["lang", "item_no"], "left")
    return sides


@query
def val_split(spark, sf_dir):
    """5 % of the aligned items held out, each with all its languages."""
    return _pairs(spark, sf_dir).select(
        "lang", "item_no", F.when(
            training.held_out(HELD_OUT, F.lit(SPLIT_SEED), F.col("item_no")), "validation").otherwise("train").alias("part"))


@query
def cap_samples(spark, sf_dir):
    """Exactly 100 documents per language, or all of a smaller one: the cap is the feature."""
    docs = src.table(spark, sf_dir, "documents").select("lang", "doc_id")
    return training.sample_exactly(
        docs, ["lang"], SAMPLES, "doc_id", F.lit(SAMPLE_SIZE_SEED), F.col("doc_id")).select("lang", "doc_id")


@query
def cutoff_len(spark, sf_dir):
    """Texts up to 2,048 tokens between blanks: the cut is the feature."""
    kept = training.cut_off(F.col("text"), MAX_TOKENS)
    return src.table(spark, sf_dir, "documents").select(
        "doc_id", kept.alias("text"), (F.length(kept) < F.length("text")).alias("is_cut"))
