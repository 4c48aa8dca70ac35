"""Reproducible pseudo-random draws that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_RANGE = float(2**32)


def draw_int(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**32) from the md5 of the ``|``-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_uniform(*parts: Column | str | int) -> Column:
    """Double strictly inside (0, 1)."""
    return (draw_int(*parts).cast("double") + 0.5) / F.lit(_RANGE)


def draw_long(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**60) from the md5 of the ``|``-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
