"""Dense positions within groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from polyprobe.operators.layout import materialize


def in_ranges(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The rows sorted by group and ``order`` over tasks of about equal size, stored, as (…, _at, _part).

    A sample of the rows themselves sets the borders, so it does not matter
    whether ids are dense, hashed, bunched or words, nor how the groups
    differ: a large group spans many tasks.  ``_part`` numbers the tasks and
    ``_at`` the rows, in order.  What is stored is what all readers see, also
    after an executor was lost.
    """
    by = [*group, order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed, "ranges").withColumn("_part", F.shiftright("_at", 33))


def with_item_no(df: DataFrame, group: list[str], order: str, out: str = "item_no") -> DataFrame:
    """Zero-based rank of a unique ``order`` column of any sortable type within ``group``.

    Rows are numbered where the sort left them, and shifted by the running
    count of the group's rows in the tasks before.  The only window runs over
    one row per task.  A null group is a group; a null id comes first.
    """
    placed = in_ranges(df, group, order)
    counted = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_part"]
    starts = counted.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return placed.join(starts, met).withColumn(out, F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_shift", *[f"_s_{k}" for k in keys])


def head_per_group(df: DataFrame, n: int, position: str = "item_no") -> DataFrame:
    """First ``n`` items of every group, by position."""
    return df.filter(F.col(position) < n)
