"""Training sets from evaluation items: aligned pairs, a leak-free split, exact samples, a length limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from polyprobe.functions.draws import draw_long, draw_uniform

#: Bits that one histogram looks at, of the 60 of a draw.
BIN_BITS, DRAW_BITS = 12, 60
_ROUNDS = 2


def aligned_pairs(items: DataFrame, source: str, targets: list[str], key: str = "item_no", value: str = "doc_id") -> DataFrame:
    """(lang, key, source, target) of every item of the source language or a target language.

    The same ``key`` means the same item.  A side without the item is null, so
    gaps in a translation show instead of vanishing.
    """
    langs = F.explode(F.lit(list(targets)))
    asked = items.where(F.col("lang") == source).select(langs.alias("lang"), key, F.col(value).alias("source"))
    told = items.where(F.col("lang").isin(list(targets))).select("lang", key, F.col(value).alias("target"))
    return asked.join(told, ["lang", key], "full")


def held_out(share: float, *seed: Column) -> Column:
    """Whether the group named by the seed columns is held out.

    Draw by the key of an aligned group, not of a row: all languages of an
    item then fall on the same side.
    """
    return draw_uniform(*seed) < share


def sample_exactly(df: DataFrame, groups: list[str], n: int, key: str, *seed: Column) -> DataFrame:
    """The ``n`` rows of smallest draw per group, or all rows of a smaller group; ties go by ``key``.

    No group is ranked.  A histogram over the leading bits of the draw finds
    the bin in which the n-th row lies; rows before it are in, rows after it
    are out, and the same is asked of the next bits of the rows inside.  After
    two histograms one row in 2**24 is left undecided, and only those are put
    in order.  ``df`` is read once per histogram.
    """
    drawn = df.withColumn("_draw", draw_long(*seed)).withColumn("_room", F.lit(n).cast("bigint"))
    taken = []
    for k in range(_ROUNDS):
        bits = F.shiftright("_draw", DRAW_BITS - BIN_BITS * (k + 1)).bitwiseAND(F.lit((1 << BIN_BITS) - 1))
        drawn = drawn.withColumn("_bin", bits)
        # At most 2**BIN_BITS rows per group.
        upto = Window.partitionBy(*groups).orderBy("_bin")
        counted = drawn.groupBy(*groups, "_room", "_bin").agg(F.count(F.lit(1)).alias("_n")) \
            .withColumn("_end", F.sum("_n").over(upto))
        border = counted.where(F.col("_end") > F.col("_room")).groupBy(*groups).agg(
            F.min(F.struct("_bin", (F.col("_room") - F.col("_end") + F.col("_n")).alias("left"))).alias("_cut"))
        placed = drawn.join(border, groups, "left")
        inside = F.col("_bin") == F.col("_cut._bin")
        taken.append(placed.where(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut._bin"))).select(*df.columns))
        drawn = placed.where(inside).withColumn("_room", F.col("_cut.left")).drop("_cut", "_bin")
    last = Window.partitionBy(*groups).orderBy("_draw", key)
    taken.append(drawn.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= F.col("_room")).select(*df.columns))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def cut_off(text: Column, limit: int, mark: str = " ") -> Column:
    """The text up to its ``limit``-th token, tokens being what lies between marks."""
    return F.substring_index(text, mark, limit)
