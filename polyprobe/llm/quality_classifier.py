"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different things: one the content of a text (counts
and shares of kinds of characters), the other only what is known about the page
(language, source, length).  In each round both score all documents, and what
one is sure of becomes a pseudo-label for the other.  At the end each view is
calibrated on labels that no model was fitted on, and the calibrated views are
combined.  A fit is a few Newton steps whose gradient and curvature are summed
over all rows of a narrow table, so nothing but these sums leaves the tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import slices, stored, words
from polyprobe.llm.textstats import counts

ROUNDS = 3
SURE = 0.97
PSEUDO_WEIGHT = 0.25
STEPS = 6
RIDGE = 1.0
#: Hash buckets of a metadata value; the width of that view does not grow with the number of sources.
LANGS, SOURCES = 8, 24
#: One in this many labelled documents calibrates instead of being fitted.
CALIBRATION_FOLD = 5


def text_view(texts: pa.Array) -> np.ndarray:
    """Content features: root shares of symbols, digits, capitals, points, repeated words, repeated lines and distinct
    words, log word length, log number of words, and whether there are words at all."""
    base = counts(texts)
    kinds = []
    for part in slices(texts):
        data, found = part.data, words(part)
        flags = [(data >= 48) & (data <= 57), (data >= 65) & (data <= 90),
                 np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), data == ord("!")]
        sums = [np.diff(np.concatenate([[0], np.cumsum(f)])[part.offsets]) for f in flags]
        row = np.repeat(np.arange(part.last - part.first), np.diff(found.first))
        by = np.lexsort((found.hash, row))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (row[by][1:] != row[by][:-1]) | (found.hash[by][1:] != found.hash[by][:-1])
        kinds.append(np.stack([*sums, np.bincount(row[by][fresh], minlength=part.last - part.first)], 1))
    more = np.concatenate(kinds) if kinds else np.zeros((0, 5))
    n, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    return np.stack([
        np.sqrt(base["n_symbols"] / chars), np.sqrt(more[:, 0] / chars), np.sqrt(more[:, 1] / chars),
        np.sqrt(more[:, 2] / chars), np.sqrt(more[:, 3] / chars), np.sqrt(base["n_repeat_words"] / n),
        np.sqrt(base["n_dup_lines"] / np.maximum(base["n_lines"], 1)), np.sqrt(more[:, 4] / n),
        np.log(chars / n), np.log(n) / 10, (base["n_words"] > 0).astype(float)], 1)


def meta_view(lang: list, source: list, length: np.ndarray) -> np.ndarray:
    """Metadata features: hashed language and source (null is a value of its own) and log length."""
    def slot(value, n: int) -> int:
        return zlib.crc32(b"\x00" if value is None else str(value).encode()) % n

    out = np.zeros((len(length), LANGS + SOURCES + 1))
    rows = np.arange(len(length))
    out[rows, [slot(v, LANGS) for v in lang]] = 1
    out[rows, [LANGS + slot(v, SOURCES) for v in source]] = 1
    out[:, -1] = np.log1p(np.maximum(length, 0)) / 10
    return out


def views(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str,
          source_col: str, length_col: str) -> DataFrame:
    """Narrow table (doc_id, y, fold, text_x, meta_x); y is null without a label."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("id")) \
        .agg(F.max(label_col).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("length"))

    def run(batches):
        for batch in batches:
            text = text_view(batch.column(1))
            meta = meta_view(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                names=["doc_id", "text_x", "meta_x"])

    seen = rows.mapInArrow(run, "doc_id bigint, text_x array<double>, meta_x array<double>")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % CALIBRATION_FOLD
    return seen.join(known, F.col("doc_id") == F.col("id"), "left").select("doc_id", "y", fold.alias("fold"),
                                                                          "text_x", "meta_x")


def _logit(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(x @ weights[:-1] + weights[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit(rows: DataFrame, features, targets, width: int, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression by Newton steps.

    ``features`` and ``targets`` turn a pandas batch into a matrix and into
    (target, weight); rows of weight 0 are left out.  Tasks send sums of size
    ``width`` squared.
    """
    weights = np.zeros(width + 1)
    for _ in range(steps):
        now = weights.copy()

        def sums(frames):
            total = np.zeros((width + 1, width + 2))
            for frame in frames:
                y, w = targets(frame)
                used = w > 0
                if not used.any():
                    continue
                x = features(frame)[used]
                p = _sigmoid(_logit(x, now))
                x = np.hstack([x, np.ones((len(x), 1))])
                total[:, :-1] += (x * (w[used] * p * (1 - p))[:, None]).T @ x
                total[:, -1] += x.T @ (w[used] * (y[used] - p))
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        got = rows.mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros((width + 1) * (width + 2))
        total[got["at"].to_numpy()] = got["v"].to_numpy()
        total = total.reshape(width + 1, width + 2)
        step = np.linalg.solve(total[:, :-1] + ridge * np.eye(width + 1), total[:, -1] - ridge * weights)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return weights


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def cotrain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", lang_col: str = "lang", source_col: str = "source",
            length_col: str = "n_chars", rounds: int = ROUNDS) -> DataFrame:
    """Score of every document: doc_id, p_text, p_meta, score, kept (score of one half or more).

    Null and empty texts are scored by their (empty) content; a null language
    or source is a value of its own; a null length counts as 0; labels other
    than 0 and 1 are ignored and of repeated ones the larger counts; without
    labels all scores are one half; rows with a null or repeated id are scored
    like any other; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = stored(views(docs, labels, id_col, text_col, label_col, lang_col, source_col, length_col), "views")
    names, widths = ("text_x", "meta_x"), (11, LANGS + SOURCES + 1)
    models: list[np.ndarray | None] = [None, None]

    def label_of(frame: pd.DataFrame, fold_used) -> tuple[np.ndarray, np.ndarray]:
        y = frame["y"].to_numpy(dtype=float, na_value=np.nan)
        usable = ~np.isnan(y) & fold_used(frame["fold"].to_numpy())
        return np.where(usable, y, 0), usable.astype(float)

    for _ in range(rounds):
        fitted = []
        for k in (0, 1):
            other, model = names[1 - k], models[1 - k]

            def targets(frame, other=other, model=model):
                y, w = label_of(frame, lambda fold: fold != 0)
                if model is None:
                    return y, w
                p = _sigmoid(_logit(_matrix(frame[other]), model))
                # Calibration rows stay out of the exchange too.
                free = (w == 0) & (frame["fold"].to_numpy() != 0) & ((p >= SURE) | (p <= 1 - SURE))
                return np.where(free, p >= 0.5, y), np.where(free, PSEUDO_WEIGHT, w)

            fitted.append(fit(rows, lambda frame, name=names[k]: _matrix(frame[name]), targets, widths[k]))
        models = fitted

    def logits(frame: pd.DataFrame) -> np.ndarray:
        return np.stack([_logit(_matrix(frame[n]), m) for n, m in zip(names, models)], 1)

    def held(frame):
        return label_of(frame, lambda fold: fold == 0)

    single = [fit(rows, lambda frame, k=k: logits(frame)[:, k: k + 1], held, 1) for k in (0, 1)]

    def calibrated(frame: pd.DataFrame) -> np.ndarray:
        z = logits(frame)
        return np.stack([_logit(z[:, k: k + 1], single[k]) for k in (0, 1)], 1)

    both = fit(rows, calibrated, held, 2)

    def score(batches):
        for batch in batches:
            frame = batch.select(["text_x", "meta_x"]).to_pandas()
            if not len(frame):
                continue
            z = calibrated(frame)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(_sigmoid(v)) for v in (z[:, 0], z[:, 1], _logit(z, both))]],
                names=["doc_id", "p_text", "p_meta", "score"])

    return rows.select("doc_id", "text_x", "meta_x") \
        .mapInArrow(score, "doc_id bigint, p_text double, p_meta double, score double") \
        .withColumn("kept", F.col("score") >= 0.5)
