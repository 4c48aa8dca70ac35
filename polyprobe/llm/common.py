"""What several operators share: tables in the shared folder, and hashing of whole Arrow columns.

Texts are hashed a few megabytes at a time.  With ``H[i]`` the sum of
``(byte[j] + 1) * BASE**j`` over ``j < i`` modulo 2**64, the polynomial hash of
any span is ``(H[end] - H[start]) * BASE**-start``, so all words of a slice are
hashed by a handful of vector operations and no Python runs per word.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from polyprobe.session import scratch_path

#: Bytes of text hashed at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared folder and continue from that table.

    The lineage ends here, so an executor lost later costs a read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps.

    Spark deletes them when the driver collects the objects that stand for
    them, which takes a second round once Python has let go of its side.
    Called between steps whose results are stored.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (finaliser of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), SLICE_BYTES // 4)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Hashes(NamedTuple):
    """Prefix polynomial hashes of a byte array."""

    prefix: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Hashes:
        up, _ = _Powers.upto(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
        return cls(prefix)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _Powers.upto(len(self.prefix))
        return mixed((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Slice(NamedTuple):
    """Some consecutive rows of a text column: rows [first, last), their bytes, and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; null counts as empty."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        column = pc.fill_null(chunk.cast(pa.large_string()), "")
        _, where, body = column.buffers()
        offsets = np.frombuffer(where, np.int64)[column.offset: column.offset + len(column) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield Slice(first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first])
            first = last


class Words(NamedTuple):
    """Words of a slice: where each starts and ends, its hash, and the first word of each row (one more than rows)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def is_blank(data: np.ndarray) -> np.ndarray:
    """Blank, tab, line feed, vertical tab, form feed or carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(part: Slice, fold_case: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; with ``fold_case`` A-Z count as a-z."""
    data = part.data
    if fold_case:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~is_blank(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge))
    end = np.flatnonzero(before & (~solid | edge))
    return Words(start, end, Hashes.of(data).spans(start, end), np.searchsorted(start, part.offsets))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word window that stays inside its row, and the first window of each row."""
    n = len(found.hash)
    per_row = np.maximum(np.diff(found.first) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    if n < size:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = mixed(total + found.hash[k: n - size + 1 + k])
    # Window i starts at word i; keep those whose last word belongs to the same row.
    at = np.arange(len(total))
    row = np.searchsorted(found.first, at, "right") - 1
    return total[at + size <= found.first[row + 1]], bounds


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
