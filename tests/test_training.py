"""Aligned pairs, split, exact samples and length limit."""

import hashlib

import pytest
from pyspark.sql import functions as F

from polyprobe.operators import training
from polyprobe.plans import catalog


def test_pairs_keep_missing_sides(spark):
    items = spark.createDataFrame(
        [("en", 0, 10), ("en", 1, 11), ("de", 1, 21), ("de", 2, 22), ("xx", 0, 9)], "lang string, item_no bigint, doc_id bigint")
    got = training.aligned_pairs(items, "en", ["de", "fr"]).select("lang", "item_no", "source", "target")
    assert {tuple(r) for r in got.collect()} == {
        ("de", 0, 10, None), ("de", 1, 11, 21), ("de", 2, None, 22), ("fr", 0, 10, None), ("fr", 1, 11, None)}


def test_no_item_lies_on_both_sides(spark, sf_dir):
    parts = catalog.QUERIES["val_split"](spark, sf_dir).groupBy("item_no").agg(
        F.count_distinct("part").alias("n"), F.max("part").alias("part")).collect()
    assert {r["n"] for r in parts} == {1}
    many = spark.range(100_000).select(training.held_out(0.05, F.lit("s"), F.col("id")).cast("int").alias("h"))
    assert 4_700 < many.agg(F.sum("h")).first()[0] < 5_300


@pytest.mark.parametrize("n", [0, 1, 7, 50, 3000])
def test_samples_are_exact_and_the_smallest_draws(spark, n):
    rows = [("a", i) for i in range(900)] + [("b", i) for i in range(40)] + [(None, i) for i in range(3)] + [("c", 5)] * 20
    frame = spark.createDataFrame(rows, "g string, id int").fillna("", ["g"])
    got = sorted(tuple(r) for r in training.sample_exactly(frame, ["g"], n, "id", F.lit("s"), F.col("id")).collect())
    draw = lambda i: int(hashlib.md5(f"s|{i}".encode()).hexdigest()[:15], 16)
    want = []
    for g in ("a", "b", "", "c"):
        want += sorted([(g, i) for h, i in rows if (h or "") == g], key=lambda r: (draw(r[1]), r[1]))[:n]
    assert got == sorted(want)


def test_rows_whose_draws_agree_are_cut_by_their_key(spark, monkeypatch):
    monkeypatch.setattr(training, "draw_long", lambda *seed: F.lit(77 << 40))
    frame = spark.range(100).select(F.lit("g").alias("g"), "id")
    got = training.sample_exactly(frame, ["g"], 9, "id", F.lit("s"))
    assert sorted(r["id"] for r in got.collect()) == list(range(9))


def test_only_the_undecided_rows_are_ranked(spark):
    frame = spark.range(200_000).select((F.col("id") % 2).alias("g"), "id")
    sample = training.sample_exactly(frame, ["g"], 1000, "id", F.col("id"))
    assert sample.count() == 2000
    # 100,000 rows of a group lie in 2**24 bins: the window sees a row or two of it.
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") >= 1 and "CartesianProduct" not in plan


def test_texts_are_cut_at_the_limit(spark):
    frame = spark.createDataFrame([("a b c",), ("a b",), ("",), (None,), ("  a",)], "t string")
    assert [r[0] for r in frame.select(training.cut_off(F.col("t"), 2)).collect()] == ["a b", "a b", "", None, " "]
