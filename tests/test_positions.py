"""Positions for ids of any kind."""

import random

import pytest
from pyspark.sql import functions as F

from polyprobe.operators import positions


def _ids(kind, n):
    rng = random.Random(n)
    return {
        "dense": lambda: list(range(n)), "hashed": lambda: list({rng.randrange(-2**62, 2**62) for _ in range(n)}),
        "bunched": lambda: [*range(n - 20), *(2**55 + 2**40 * k for k in range(20))],
        "words": lambda: [f"id-{rng.random():.15f}" for _ in range(n)],
    }[kind]()


@pytest.fixture
def many_tasks(spark):
    """As many tasks as asked for, also for few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    yield 20
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("kind", ["dense", "hashed", "bunched", "words"])
def test_tasks_stay_small_and_ranks_are_right(spark, many_tasks, kind):
    """A group with four fifths of the rows, one small group, one group without a name."""
    rows = [("big", i) for i in _ids(kind, 8000)] + [("small", i) for i in _ids(kind, 50)] + [(None, i) for i in _ids(kind, 1900)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, f"g string, id {'string' if kind == 'words' else 'bigint'}").repartition(5)
    sizes = [r["count"] for r in positions.in_ranges(frame, ["g"], "id").groupBy("_part").count().collect()]
    assert len(sizes) >= many_tasks - 2 and max(sizes) <= 3 * len(rows) / many_tasks
    got = {(r["g"], r["id"]): r["item_no"] for r in positions.with_item_no(frame, ["g"], "id").collect()}
    assert len(got) == len(rows)
    for g in ("big", "small", None):
        for k, i in enumerate(sorted(i for h, i in rows if h == g)):
            assert got[g, i] == k


def test_the_only_window_runs_over_tasks(spark, many_tasks):
    numbered = positions.with_item_no(spark.range(5000).select(F.lit("g").alias("g"), "id"), ["g"], "id")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Window", 1)[1]
    assert plan.count("+- Window") == 1 and "Aggregate [g" in below and "row_number" not in plan


def test_nothing_to_number(spark):
    empty = spark.createDataFrame([], "g string, id bigint")
    assert positions.with_item_no(empty, ["g"], "id").count() == 0


def test_a_null_id_comes_first(spark):
    frame = spark.createDataFrame([("a", None), ("a", 5), ("a", 2)], "g string, id bigint")
    assert {r["id"]: r["item_no"] for r in positions.with_item_no(frame, ["g"], "id").collect()} == {None: 0, 2: 1, 5: 2}
