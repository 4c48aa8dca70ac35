"""Arithmetic on ARRAY columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

LN2 = 0.6931471805599453


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A projected column used inside a lambda may be inlined by the optimizer
    and then be recomputed for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def scale(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def softmax_parts(logits: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``body(logits, peak, weights, total)`` with weights = exp(logits - peak)."""
    return let(logits, lambda x: let(F.array_max(x), lambda peak: let(
        F.transform(x, lambda v: F.exp(v - peak)), lambda w: let(total(w), lambda z: body(x, peak, w, z)))))


def unit(vec: Column) -> Column:
    """Vector divided by its length; null entries for a zero vector."""
    return let(vec, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))


def argmax_index(vec: Column) -> Column:
    """Zero-based position of the maximum, lowest on ties."""
    return let(vec, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))
