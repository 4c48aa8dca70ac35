"""Top pieces and sampled tokens of a row of logits, a matrix of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from polyprobe.functions import vectors as V
from polyprobe.functions.draws import draw_long

TOP_K = 10
#: Logits held at a time.
_CELLS = 1 << 22
_DRAWS = float(2**60)


def matrices(logits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal width as matrices of bounded size, with their places; null and empty rows are left out."""
    size = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False)
    flat = logits.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    for width in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == width)
        step = max(1, _CELLS // int(width))
        for k in range(0, len(rows), step):
            some = rows[k: k + step]
            if len(rows) == len(size):
                yield some, flat[start[some[0]]: start[some[-1]] + width].reshape(len(some), width)
            else:
                yield some, flat[start[some][:, None] + np.arange(width)]


def _weights(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.exp(x - x.max(axis=1, keepdims=True))


def _top(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k largest of each row, larger first, of equal ones the smaller id; NaN comes last."""
    width = x.shape[1]
    k = min(k, width)
    cost = np.where(np.isnan(x), np.inf, -x)
    if k < width:
        # Everything below the k-th cost is in; of those equal to it, the smallest ids.
        border = np.partition(cost, k - 1, axis=1)[:, k - 1: k]
        below, tied = cost < border, cost == border
        room = k - below.sum(axis=1, keepdims=True)
        chosen = below | (tied & (np.cumsum(tied, axis=1) <= room))
        ids = np.nonzero(chosen)[1].reshape(len(x), k)
    else:
        ids = np.tile(np.arange(width), (len(x), 1))
    order = np.argsort(np.take_along_axis(cost, ids, axis=1), axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1)


def _top_rows(k: int) -> Callable:
    @F.arrow_udf("array<struct<token_id:int,percent:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for logits in batches:
            found = np.full((len(logits), k), -1, np.int64)
            share = np.full((len(logits), k), np.nan)
            for rows, x in matrices(logits):
                ids = _top(x, k)
                w = _weights(x)
                found[rows, : ids.shape[1]] = ids
                share[rows, : ids.shape[1]] = np.take_along_axis(w, ids, axis=1) / w.sum(axis=1, keepdims=True) * 100
            have = found >= 0
            upto = np.concatenate([[0], np.cumsum(have.sum(axis=1))])
            percent = share[have]
            known = ~np.isnan(percent)
            cells = pa.StructArray.from_arrays([
                pa.array(found[have], pa.int32()),
                pa.array(np.where(known, percent, 0).astype(np.int32), mask=~known)], names=["token_id", "percent"])
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), cells)

    return run


def top_pieces(df: DataFrame, vocab: DataFrame, logits: str = "logits", k: int = TOP_K) -> DataFrame:
    """The k most probable tokens per row with their share in whole percent.

    Partial selection inside the row, in matrices of an Arrow batch; only k
    entries per row leave it.  Of equal logits the smaller id comes first; NaN
    comes last and makes the shares null.
    """
    keys = [c for c in df.columns if c != logits]
    top = df.select(*keys, F.posexplode(_top_rows(k)(V.as_double(F.col(logits)))).alias("_pos", "_t"))
    return top.select(*keys, (F.col("_pos") + 1).alias("rank"), "_t.*").join(vocab, "token_id")


def _drawn(temperature: float) -> Callable:
    @F.arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for logits, draws in batches:
            token = np.full(len(logits), -1, np.int64)
            u = (draws.to_numpy(zero_copy_only=False).astype(np.float64) + 0.5) / _DRAWS
            for rows, x in matrices(logits):
                upto = np.cumsum(_weights(x / temperature), axis=1)
                # The first token whose running sum passes the draw: all sums up to there are not above it.
                at = (upto <= (u[rows] * upto[:, -1])[:, None]).sum(axis=1)
                token[rows] = np.where(np.isnan(upto[:, -1]), -1, np.minimum(at, x.shape[1] - 1))
            yield pa.array(token.astype(np.int32), mask=token < 0)

    return run


def sample_token(logits: Column, temperature: float, *seed: Column | str | int) -> Column:
    """Token id drawn from softmax(logits / temperature); greedy at zero.

    One draw of 60 bits per row, found in the running sums of the weights.
    Null for a row without logits or with NaN among them.
    """
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if temperature == 0:
        return V.argmax_index(logits)
    return _drawn(float(temperature))(V.as_double(logits), draw_long(*seed))
