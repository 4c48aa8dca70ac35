"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram.  Its value is the log
ratio of its smoothed frequency in toxic and in other labelled texts, so
n-grams that say nothing weigh nothing before the linear model is fitted.  The
fit sees a bounded number of labelled texts; every text is scored whole, in one
pass without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from polyprobe.llm.common import batch_of, mixed, slices, stored

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
#: Most labelled texts of either class that the fit reads; their ids are chosen by hash.
FIT_ROWS = 3000
EPOCHS = 4
RATE = 0.1
DECAY = 1e-2
SMOOTHING = 2.0
_MULTIPLIERS = mixed(np.arange(1, max(SIZES) + 1, dtype=np.uint64)) | np.uint64(1)


class Model(NamedTuple):
    """Weight of each bucket (ratio times fitted weight) and the intercept."""

    weights: np.ndarray
    intercept: float


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct buckets of the character n-grams of each text, A-Z as a-z; null counts as empty."""
    seen = np.zeros(BUCKETS, bool)
    for part in slices(texts):
        points = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        heads = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])[part.offsets]
        grams = {}
        total = np.zeros(len(points), np.uint64)
        for k in range(max(SIZES)):
            total = total[: max(len(points) - k, 0)] + points[k:] * _MULTIPLIERS[k]
            if k + 1 in SIZES:
                # The top bits of one more multiplication are well spread.
                grams[k + 1] = ((total ^ (total >> np.uint64(29))) * _MULTIPLIERS[k] >> np.uint64(46)).astype(np.int64)
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            for size, buckets in grams.items():
                if b - a >= size:
                    seen[buckets[a: b - size + 1]] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            yield own


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Adaptive-step logistic regression on ratio-scaled presence features."""
    counts = np.full((2, BUCKETS), SMOOTHING)
    texts = np.full(2, 2 * SMOOTHING)
    for own, label in rows:
        counts[label, own] += 1
        texts[label] += 1
    share = counts / texts[:, None]
    ratio = np.log(share[1] / share[0])
    weights, bias = np.zeros(BUCKETS), 0.0
    squares, bias_square = np.full(BUCKETS, 1e-2), 1e-2
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own, label = rows[i]
            r = ratio[own]
            # Root scaling keeps one step alike for short and long texts.
            norm = 1 / np.sqrt(1 + np.sqrt(len(own)))
            z = bias + norm * float(weights[own] @ r)
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
            grad = slope * norm * r + DECAY * weights[own]
            squares[own] += grad ** 2
            weights[own] -= RATE * grad / np.sqrt(squares[own])
            bias_square += slope ** 2
            bias -= RATE * slope / np.sqrt(bias_square)
    return Model(weights * ratio, bias)


def score(model: Model, own: np.ndarray) -> float:
    z = model.intercept + float(model.weights[own].sum()) / np.sqrt(1 + np.sqrt(len(own)))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled texts per class among the rows that ``usable`` selects.

    The fit runs in one task on that bounded sample.  Labels other than 0 and
    1 and labels without a text are left out; without both classes the model
    scores every text alike, by the share of toxic labels.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1)) \
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    order = F.xxhash64("id"), F.col("id")
    chosen = known.where("y = 1").orderBy(*order).limit(fit_rows) \
        .unionByName(known.where("y = 0").orderBy(*order).limit(fit_rows))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = [(n.get(k, 0) + 1) / (sum(n.values()) + 2) for k in (0, 1)]
    taken = [min(n.get(k, 0), fit_rows) for k in (0, 1)]
    if not all(taken):
        return Model(np.zeros(BUCKETS), float(np.log(prior[1] / prior[0])))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def featurise(batches):
        schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())])
        for batch in batches:
            yield batch_of(schema, id=batch.column(0), y=batch.column(1),
                           f=[own.astype(np.uint32).tobytes() for own in features(batch.column(2))])

    def learn(batches):
        # A few kilobytes for each of a bounded number of rows, kept packed.
        rows = sorted((i, y, f) for batch in batches for i, y, f in zip(*(c.to_pylist() for c in batch.columns)))
        del batches
        model = fit([(np.frombuffer(f, np.uint32), y) for _, y, f in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
                                          pa.array([model.intercept])], names=["weights", "intercept"])

    sample = stored(texts.select(F.col("id").cast("bigint"), "y", "text")
                    .mapInArrow(featurise, "id bigint, y int, f binary"), "sample")
    got = sample.coalesce(1).mapInArrow(learn, "weights binary, intercept double").first()
    # The sample has other class shares than the labels.
    shift = np.log(prior[1] / prior[0]) - np.log(taken[1] / taken[0])
    return Model(np.frombuffer(bytes(got["weights"]), "<f4").astype(np.float64), got["intercept"] + float(shift))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row.

    A null or empty text has no n-grams and gets the intercept's score; rows
    with a null or repeated id are scored like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.intercept))

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        local = Model(shipped.value[0].astype(np.float64), shipped.value[1])
        for batch in batches:
            yield batch_of(schema, doc_id=batch.column(0), score=[score(local, f) for f in features(batch.column(1))])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, score double") \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
