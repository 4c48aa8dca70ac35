"""Distributions, choices and matching on hand-made rows."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyprobe.functions import text as X
from polyprobe.operators import choices, matching, sampling, scoring
from polyprobe.sources import driver_tables as src

CLASSES = "array<struct<class string, word string, gold_word string, mass double>>"


def _choose(spark, rows, seed=1):
    df = spark.createDataFrame(rows, f"item_no int, classes {CLASSES}")
    return {r["item_no"]: r for r in choices.choose(df, seed, ["item_no"]).collect()}


def _two(a, b):
    return [("negative", "neg", "neg", a), ("positive", "pos", "pos", b)]


def _three(a, b, c):
    return [("contradiction", "c", "c", a), ("entailment", "e", "e", b), ("neutral", "n", "n", c)]


def test_heavier_class_wins(spark):
    got = _choose(spark, [(0, _two(0.2, 0.3)), (1, _two(0.3, 0.2)), (2, _three(0.1, 0.1, 0.2))])
    assert [got[i]["pred_class"] for i in range(3)] == ["positive", "negative", "neutral"]
    assert not any(got[i]["is_tie"] for i in range(3))


def test_ties_draw_only_from_the_tied_classes(spark):
    rows = [(i, _three(0.2, 0.1, 0.2)) for i in range(200)]
    got = _choose(spark, rows)
    drawn = [r["pred_class"] for r in got.values()]
    assert set(drawn) == {"contradiction", "neutral"}
    assert 60 < drawn.count("neutral") < 140
    assert all(r["is_tie"] for r in got.values())


def test_three_way_tie_can_pick_every_class(spark):
    got = _choose(spark, [(i, _three(0.2, 0.2, 0.2)) for i in range(100)])
    assert {r["pred_class"] for r in got.values()} == {"contradiction", "entailment", "neutral"}


def test_tie_draws_survive_repartitioning(spark):
    df = spark.createDataFrame([(i, _two(0.5, 0.5)) for i in range(50)], f"item_no int, classes {CLASSES}")
    one = {tuple(r) for r in choices.choose(df.coalesce(1), 3, ["item_no"]).select("item_no", "pred_class").collect()}
    many = {tuple(r) for r in choices.choose(df.repartition(7), 3, ["item_no"]).select("item_no", "pred_class").collect()}
    assert one == many


@pytest.mark.parametrize("bad", [float("nan"), None])
def test_invalid_mass_gives_no_prediction(spark, bad):
    row = _choose(spark, [(0, _two(bad, 0.4))])[0]
    assert row["pred_class"] is None and row["is_invalid"] and not row["is_tie"]


def test_no_classes_give_no_prediction(spark):
    row = _choose(spark, [(0, [])])[0]
    assert row["pred_class"] is None and row["is_invalid"]


def _summaries(spark, logits, sets):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "k int, logits array<double>")
    id_sets = F.array(*[F.lit(s).cast("array<int>") if s else F.array().cast("array<int>") for s in sets])
    out = {}
    for backend in ("jvm", "arrow"):
        rows = scoring.score_summary(df, id_sets, backend=backend).orderBy("k").collect()
        out[backend] = [r["summary"] for r in rows]
    return out


def test_back_ends_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 5, (20, 30))
    sets = [[0, 3, 7], [], [29]]
    got = _summaries(spark, logits.tolist(), sets)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for rows in got.values():
        for i, r in enumerate(rows):
            assert np.allclose(r["masses"], [p[i][s].sum() for s in sets], atol=1e-12)
            assert math.isclose(r["entropy"], -(p[i] * np.log2(p[i])).sum(), abs_tol=1e-9)
            assert r["argmax_id"] == p[i].argmax()
            assert 0 <= r["entropy"] <= math.log2(30) + 1e-9


def test_impossible_tokens_add_no_entropy(spark):
    got = _summaries(spark, [[0.0, 0.0, float("-inf")]], [[2], [0]])
    for rows in got.values():
        assert rows[0]["masses"] == [0.0, 0.5]
        assert math.isclose(rows[0]["entropy"], 1.0, abs_tol=1e-12)


def test_nan_logits_give_nan_masses(spark):
    got = _summaries(spark, [[0.0, float("nan"), 1.0]], [[0]])
    for rows in got.values():
        assert math.isnan(rows[0]["masses"][0])


def test_equal_maxima_take_the_lowest_id(spark):
    got = _summaries(spark, [[1.0, 5.0, 5.0]], [[0]])
    assert all(rows[0]["argmax_id"] == 1 for rows in got.values())


def test_rows_without_logits_and_unknown_ids(spark):
    """Rows of several widths in one batch."""
    got = _summaries(spark, [[1.0, 2.0], None, [], [0.0], [3.0, 2.0, 1.0]], [[0], [1], []])
    for rows in got.values():
        assert rows[1] is None and rows[2] is None
        assert rows[3]["masses"] == [1.0, None, 0.0] and rows[3]["entropy"] == 0.0
        assert math.isclose(sum(rows[0]["masses"]), 1.0) and rows[4]["argmax_id"] == 0


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1000.0, 999.0, -1000.0],)], "logits array<double>")
    probs = df.select(scoring.softmax(F.col("logits")).alias("p")).first()["p"]
    assert math.isclose(sum(probs), 1.0, abs_tol=1e-12) and probs[2] == 0.0


def test_top_pieces_truncate_to_whole_percent(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0] + [-50.0] * 61)], "k int, logits array<double>")
    rows = sampling.top_pieces(df, src.vocab(spark)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert [(r["token_id"], r["percent"]) for r in rows[:3]] == [(0, 33), (1, 33), (2, 33)]
    assert rows[0]["piece"] == src.PIECES[0]


def test_sampling_follows_the_distribution(spark):
    df = spark.range(4000).withColumn("logits", F.lit([math.log(0.7), math.log(0.2), math.log(0.1)]))
    counts = df.select(sampling.sample_token(F.col("logits"), 1.0, 5, F.col("id")).alias("t")).groupBy("t").count()
    share = {r["t"]: r["count"] / 4000 for r in counts.collect()}
    assert abs(share[0] - 0.7) < 0.03 and abs(share[1] - 0.2) < 0.03


def test_zero_temperature_is_greedy_and_negative_is_refused(spark):
    df = spark.createDataFrame([([0.0, 2.0, 1.0],)], "logits array<double>")
    assert df.select(sampling.sample_token(F.col("logits"), 0)).first()[0] == 1
    with pytest.raises(ValueError):
        sampling.sample_token(F.col("logits"), -0.5)


def test_matching(spark):
    df = spark.createDataFrame(
        [("positive", "positive"), ("positive", ""), ("negative", "positive"), (None, "positive")], "word string, answer string")
    native = [r[0] for r in df.select(matching.match_native(F.col("word"), F.col("answer"))).collect()]
    mapped = [r[0] for r in df.select(matching.match_mapped(F.col("word"), F.col("answer"))).collect()]
    assert native == [True, True, False, False]
    assert mapped == [True, False, False, False]


def test_unknown_gold_words_stay_null(spark):
    from polyprobe.sources import dimensions as dim

    items = spark.createDataFrame(
        [("sentiment", "fr", "négatif"), ("sentiment", "bg", "положителен"), ("sentiment", "en", "?")],
        "task string, lang string, answer string")
    got = matching.gold_to_class(items, dim.answer_words(spark, [("sentiment", "native")]))
    assert {r["lang"]: r["latent_word"] for r in got.collect()} == {"fr": "negative", "bg": "positive", "en": None}


@pytest.mark.parametrize("text, want", [
    ("say {'a': 1, 'b': 'x'} end", {"a": "1", "b": "x"}),
    ('over\n{"a":\n "y"}\nlines {"b": 2}', {"a": "y"}),
    ("nested {'a': {'b': 1}}", None),
    ("no braces", None),
    ("{broken}", None),
    ("{}", {}),
    (None, None),
])
def test_extract_dictionary(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.extract_dictionary(F.col("t"))).first()[0]
    assert got == want


def test_strip_prompt_drops_its_length_either_way(spark):
    df = spark.createDataFrame([("abcdef", "abc"), ("xxxdef", "abc")], "output string, prompt string")
    got = df.select(X.is_prompt_prefix(F.col("output"), F.col("prompt")), X.strip_prompt(F.col("output"), F.col("prompt")))
    assert [tuple(r) for r in got.collect()] == [(True, "def"), (False, "def")]


def test_a_wide_batch_is_summarised_in_little_memory():
    x = np.random.default_rng(0).normal(size=(4000, 1024))
    logits = pa.ListArray.from_arrays(pa.array(np.arange(4001) * 1024, pa.int32()), pa.array(x.ravel()))
    sets = pa.array([[[0, k % 1024], None if k % 3 else [5, 2000]] for k in range(4000)], pa.list_(pa.list_(pa.int32())))
    tracemalloc.start()
    got, = scoring._matrix_summary(iter([(logits, sets)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    assert np.allclose(got.field("entropy").to_numpy(), -(p * np.log2(p)).sum(axis=1))
    assert (got.field("argmax_id").to_numpy() == x.argmax(axis=1)).all()
    first, second = zip(*got.field("masses").to_pylist())
    assert np.allclose(first, p[:, 0] + p[np.arange(4000), np.arange(4000) % 1024])
    assert [m is None for m in second] == [k % 3 == 0 for k in range(4000)]
    empty, = scoring._matrix_summary(iter([(logits[:0], sets[:0])]))
    assert len(empty) == 0
