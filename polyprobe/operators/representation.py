"""Pooling, covariance, principal components and cross-language correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from polyprobe.functions import vectors as V
from polyprobe.operators import tiles as tl
from polyprobe.operators.layout import materialize


def mean_pool(hidden: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector over token positions."""
    return hidden.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(vec))


def _means(df: DataFrame, group: list[str], vec: str) -> DataFrame:
    """(group..., n, mean) of the vectors that are not null."""
    known = df.where(F.col(vec).isNotNull())
    return known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("mean"))


def covariance_matrix(df: DataFrame, group: list[str], vec: str = "vec", block: int = tl.GRAM_BLOCK) -> DataFrame:
    """(group..., i, j, cov) over all stacked vectors of a group; NaN for a single vector.

    The vectors less their group's mean, so that products do not cancel where
    means are large, summed in tiles where they lie.
    """
    means = materialize(_means(df, group, vec), "means")
    centred = df.join(means, group).select(
        *group, F.zip_with(F.col(vec).cast("array<double>"), "mean", lambda x, m: x - m).alias("_centred"))
    cells = tl.tile_cells(tl.gram_tiles(centred, group, "_centred", block), group, "_sum", block)
    cov = F.when(F.col("n") > 1, F.col("_sum") / (F.col("n") - 1)).otherwise(F.lit(float("nan")))
    return cells.join(means.select(*group, "n"), group).select(*group, "i", "j", cov.alias("cov"))


#: Directions tried at once, directions kept before a restart, and rounds at most.
KRYLOV_BLOCK, KRYLOV_BASIS, KRYLOV_ROUNDS = 64, 512, 60
#: A component is found when what C moves it by, besides stretching it, is this small beside the largest variance.
KRYLOV_TOLERANCE = 1e-11


def _orthonormal(y: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What ``y`` adds to an orthonormal basis, as orthonormal columns; directions already there go."""
    size = np.linalg.norm(y, axis=0)
    y = y[:, size > 0] / size[size > 0]
    for _ in range(2):
        y = y - basis @ (basis.T @ y)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    return u[:, : min(int((s > 1e-10).sum()), len(basis) - basis.shape[1])]


def _vectors_of(flat: list[float], width: int) -> np.ndarray:
    return np.asarray(flat, np.float64).reshape(width, -1)


def _advanced(n: int, basis: np.ndarray, image: np.ndarray, tried: np.ndarray, sums: np.ndarray, k: int):
    """One round of block Krylov: basis and image grown by what was tried, and the best k directions in their span."""
    basis, image = np.hstack([basis, tried]), np.hstack([image, sums / max(n - 1, 1)])
    small = basis.T @ image
    values, mix = np.linalg.eigh((small + small.T) / 2)
    values, mix = values[::-1], mix[:, ::-1]
    k = min(k, len(values))
    top, moved = basis @ mix[:, :k], image @ mix[:, :k]
    miss = np.linalg.norm(moved - top * values[:k], axis=0).max(initial=0.0)
    done = basis.shape[1] >= len(basis) or miss <= KRYLOV_TOLERANCE * max(values[0], np.finfo(float).tiny)
    fresh = np.zeros((len(basis), 0)) if done else _orthonormal(image[:, -tried.shape[1]:], basis)
    if basis.shape[1] + fresh.shape[1] > KRYLOV_BASIS:
        keep = min(len(values), max(2 * k, KRYLOV_BLOCK))
        basis, image = basis @ mix[:, :keep], image @ mix[:, :keep]
    return basis, image, fresh, top, values[:k]


def principal_components(
    df: DataFrame, group: list[str], k: int, vec: str = "vec", block: int = KRYLOV_BLOCK, seed: int = 0
) -> DataFrame:
    """One row per group: mean, loadings (k x width) and variances.

    Block Krylov iteration from random directions.  In a round every task
    multiplies its own centred vectors by the directions on trial, twice and
    without forming a covariance matrix; width x block sums are added up per
    group, and a small problem in the span of all directions tried gives the
    components.  The rounds end when every group's components stand still,
    which is after one round for vectors no wider than ``block``.  Only the
    number of groups still open reaches the driver.  ``df`` is read once per
    round, so pass a table.  The sign of a loading is fixed so that its
    largest entry is positive; any basis spans a single vector.
    """
    rows = df.where(F.col(vec).isNotNull()).select(*group, V.as_double(F.col(vec)).alias("_vec"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_vec").schema)
    state_type = (kinds + "n bigint, mean array<double>, basis array<double>, image array<double>, tried array<double>, "
                  "loadings array<array<double>>, variances array<double>")

    def start(table: pd.DataFrame) -> pd.DataFrame:
        width = len(table["mean"].iloc[0])
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(block, width))))
        empty = [np.zeros(0)]
        return table.assign(basis=empty, image=empty, tried=[q.ravel()], loadings=[[]], variances=empty)

    state = materialize(_means(df, group, vec).groupBy(*group).applyInPandas(start, state_type), "components")
    for _ in range(KRYLOV_ROUNDS):
        files = state.inputFiles()
        ordered = rows.sortWithinPartitions(*group) if group else rows

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_groups = {}
            for path in files:
                for r in tl.read_tile(path).select([*group, "mean", "tried"]).to_pylist():
                    if r["tried"]:
                        mean = np.asarray(r["mean"])
                        open_groups[tuple(r[g] for g in group)] = (mean, _vectors_of(r["tried"], len(mean)))
            current, total, types = None, None, []

            def emit() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [*[pa.array([v], t) for v, t in zip(current, types)], pa.array([total.ravel()], pa.list_(pa.float64()))],
                    names=[*group, "sums"])

            for batch in batches:
                types = [batch.schema.field(g).type for g in group]
                for key, part in tl.runs(batch, group):
                    if total is not None and key != current:
                        yield emit()
                        total = None
                    if key not in open_groups:
                        continue
                    mean, tried = open_groups[key]
                    for at in range(0, part.num_rows, max(1, tl.BUFFER_BYTES // (8 * len(mean)))):
                        x = tl.matrix(part.column("_vec").slice(at, max(1, tl.BUFFER_BYTES // (8 * len(mean))))) - mean
                        own = x.T @ (x @ tried)
                        total = own if total is None else total + own
                    current = key
            if total is not None:
                yield emit()

        summed = ordered.mapInArrow(products, kinds + "sums array<double>").groupBy(*group).agg(
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))

        def step(table: pd.DataFrame) -> pd.DataFrame:
            r = table.iloc[0]
            if r["sums"] is None or not len(r["tried"]):
                return table[names]
            width = len(r["mean"])
            basis, image, fresh, top, values = _advanced(
                r["n"], *(_vectors_of(r[c], width) for c in ("basis", "image", "tried", "sums")), k)
            top = top.T
            peak = top[np.arange(len(top)), np.abs(top).argmax(axis=1)]
            top = top * np.where(peak < 0, -1.0, 1.0)[:, None]
            return table.assign(basis=[basis.ravel()], image=[image.ravel()], tried=[fresh.ravel()],
                                loadings=[[t.tolist() for t in top]], variances=[values])[names]

        names = [*group, "n", "mean", "basis", "image", "tried", "loadings", "variances"]
        met = F.lit(True)
        for g in group:
            met = met & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        renamed = summed.select(*[F.col(g).alias(f"_g_{g}") for g in group], "sums")
        state = materialize(state.join(renamed, met, "left").select(*names, "sums").groupBy(*group).applyInPandas(
            step, state_type), "components")
        if not state.where(F.size("tried") > 0).limit(1).count():
            break
    return state.select(*group, "mean", "loadings", "variances")


def project(df: DataFrame, components: DataFrame, group: list[str], vec: str = "vec") -> DataFrame:
    """Add ``coords``, the centred vector along each component."""
    def along(loading):
        centred = F.zip_with(F.col(vec), F.col("mean"), lambda x, m: x - m)
        return F.aggregate(F.zip_with(centred, loading, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return (
        df.join(components, group)
        .withColumn("coords", F.transform("loadings", along))
        .drop("mean", "loadings", "variances")
    )


def pearson_pairs(
    df: DataFrame, keys: list[str], pairs, value: str, lang: str = "lang", item: str = "item_no"
) -> DataFrame:
    """Pearson r between the same items of two languages, null if one is constant."""
    aligned = df.groupBy(*keys, item).agg(
        F.map_from_entries(F.collect_list(F.struct(lang, value))).alias("_by_lang"))
    wanted = F.array(*[
        F.struct(
            F.lit(a).alias("lang_a"), F.lit(b).alias("lang_b"),
            F.try_element_at("_by_lang", F.lit(a)).alias("_x"), F.try_element_at("_by_lang", F.lit(b)).alias("_y"),
        ) for a, b in pairs
    ])
    rows = aligned.select(*keys, F.inline(wanted)).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return rows.groupBy(*keys, "lang_a", "lang_b").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r"))


def stack_languages(
    df: DataFrame, order, keys: list[str], lang: str = "lang", item: str = "item_no"
) -> DataFrame:
    """Position in the matrix that stacks whole languages in ``order``, per ``keys``.

    A language starts where the one before it ends, whatever its size.
    """
    place = F.array_position(F.lit(list(order)), F.col(lang))
    placed = df.withColumn("_place", place).filter("_place > 0")
    earlier = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    # One row per language.
    starts = placed.groupBy(*keys, "_place").agg((F.max(item) + 1).alias("_n")).select(
        *keys, "_place", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, [*keys, "_place"]).withColumn(
        "stacked_no", F.col("_start") + F.col(item)).withColumn("segment", F.col(lang)).drop("_place", "_start")


def segment_by_bucket(df: DataFrame, width: int, item: str = "item_no") -> DataFrame:
    """Label items by index range, pooled over languages."""
    low = (F.floor(F.col(item) / width) * width).cast("bigint")
    return df.withColumn("segment", F.concat_ws("-", low.cast("string"), (low + width).cast("string")))
