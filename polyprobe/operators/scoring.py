"""Next-token distributions summarised per row; nothing here shuffles.

A score row holds the dense logits of one position, ordered by token id.
Two back ends give the same numbers: ``jvm`` uses higher-order functions and
suits narrow arrays, ``arrow`` uses numpy on Arrow batches and suits real
vocabulary widths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from polyprobe.functions import vectors as V
from polyprobe.operators.sampling import matrices

# Measured: the back ends cross between 64 and 512 tokens.
ARROW_FROM_WIDTH = 512
#: Logits and ids looked at together; an Arrow batch of wide rows holds many times that.
BATCH_CELLS = 1 << 18
SUMMARY = "masses array<double>, entropy double, argmax_id int"


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of an array."""
    return V.softmax_parts(logits, lambda x, peak, w, z: F.transform(w, lambda v: v / z))


def score_summary(
    df: DataFrame, id_sets: Column, logits: str = "logits", out: str = "summary",
    width: int | None = None, backend: str = "auto",
) -> DataFrame:
    """Add struct(masses, entropy, argmax_id) of the softmax of ``logits``.

    ``id_sets`` is array<array<int>>; ``masses`` holds the probability of each
    set.  Entropy is in bits and counts impossible tokens as zero.  NaN logits
    give NaN masses and entropy; a row without logits has no summary; a set
    with an id beyond the logits has a null mass.  Both back ends agree.
    """
    if backend == "auto":
        backend = "arrow" if width is not None and width >= ARROW_FROM_WIDTH else "jvm"
    if backend == "arrow":
        return df.withColumn(out, F.arrow_udf(_matrix_summary, SUMMARY)(V.as_double(F.col(logits)), id_sets))
    return df.withColumn(out, F.when(F.size(F.col(logits)) > 0, V.softmax_parts(F.col(logits), lambda x, peak, w, z: F.struct(
        F.transform(id_sets, lambda ids: F.aggregate(
            ids, F.lit(0.0), lambda acc, i: acc + F.get(w, i)) / z).alias("masses"),
        ((F.ln(z) - V.total(F.zip_with(
            x, w, lambda v, p: F.when(p == 0, 0.0).otherwise(p * (v - peak)))) / z) / F.lit(V.LN2)).alias("entropy"),
        V.argmax_index(x).alias("argmax_id"),
    ))))


def _matrix_summary(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Masses, entropy and argmax of the rows of an Arrow batch, about ``BATCH_CELLS`` logits and ids at a time."""
    for logits, id_sets in batches:
        n, inner = len(logits), id_sets.flatten()
        cells = len(logits.flatten()) + len(inner.flatten())
        step = max(1, BATCH_CELLS * n // max(cells, 1))
        yield pa.concat_arrays([
            _summarised(logits.slice(at, step), id_sets.slice(at, step)) for at in range(0, max(n, 1), step)])


def _summarised(logits: pa.Array, id_sets: pa.Array) -> pa.StructArray:
    n = len(logits)
    # Rows of the innermost list: which set and which row an id belongs to.
    of_row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(id_sets), 0).to_numpy(zero_copy_only=False))
    inner = id_sets.flatten()
    of_set = np.repeat(np.arange(len(inner)), pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False))
    ids = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    mass, known = np.zeros(len(inner)), np.ones(len(inner), bool)
    entropy, top, seen = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, bool)
    for rows, x in matrices(logits):
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        peak = x.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            shifted = x - peak
        w = np.exp(shifted)
        z = w.sum(axis=1)
        shifted[w == 0] = 0  # impossible tokens add nothing
        entropy[rows] = (np.log(z) - np.einsum("nv,nv->n", w, shifted) / z) / V.LN2
        top[rows], seen[rows] = x.argmax(axis=1), True
        own = np.flatnonzero(place[of_row[of_set]] >= 0)
        row = place[of_row[of_set[own]]]
        inside = (ids[own] >= 0) & (ids[own] < x.shape[1])
        known[of_set[own[~inside]]] = False
        part = np.bincount(of_set[own[inside]], w[row[inside], ids[own[inside]]], minlength=len(inner))
        sets_here = place[of_row] >= 0
        mass[sets_here] = part[sets_here] / z[place[of_row[sets_here]]]
    upto = np.searchsorted(of_row, np.arange(n + 1))
    masses = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(mass, mask=~known))
    return pa.StructArray.from_arrays(
        [masses, pa.array(entropy), pa.array(top)], names=["masses", "entropy", "argmax_id"], mask=pa.array(~seen))


def with_class_masses(
    df: DataFrame, logits: str = "logits", width: int | None = None, backend: str = "auto"
) -> DataFrame:
    """Replace ``logits`` and ``classes`` by classes carrying their mass."""
    sets = F.transform("classes", lambda c: c["token_ids"])
    summed = score_summary(df, sets, logits, "_summary", width, backend)
    classes = V.let(F.col("_summary.masses"), lambda masses: F.transform("classes", lambda c, i: F.struct(
        c["class"].alias("class"), c["word"].alias("word"), c["gold_word"].alias("gold_word"),
        F.get(masses, i).alias("mass"),
    )))
    return summed.withColumn("classes", classes).drop("_summary", logits)
