"""Word, line, symbol and repetition counts of texts, a few megabytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import Hashes, slices, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeats(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, value) pairs: whether the pair occurs again, and whether it is the first of its kind."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    again = ~fresh
    again[:-1] |= ~fresh[1:]
    out_again, out_fresh = np.empty(len(r), bool), np.empty(len(r), bool)
    out_again[order], out_fresh[order] = again, fresh
    return out_again, out_fresh


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def counts(texts: pa.Array, window: int = 3) -> dict[str, np.ndarray]:
    """The counts of each text; null and blank texts count nothing."""
    parts = {name: [] for name in COUNTS}
    for part in slices(texts):
        data, found = part.data, words(part)
        solid = np.zeros(len(data) + 1, np.int8)
        np.add.at(solid, found.start, 1)
        np.add.at(solid, found.end, -1)
        inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
        newline = np.flatnonzero(data == 10)
        start = np.union1d(part.offsets[:-1][np.diff(part.offsets) > 0], newline + 1)
        start = start[start < len(data)]
        end = np.minimum(part.offsets[np.searchsorted(part.offsets, start, "right")],
                         np.append(newline, len(data))[np.searchsorted(newline, start)])
        worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
        start, end = start[worded], end[worded]
        line_row = np.searchsorted(part.offsets, start, "right") - 1
        _, fresh = _repeats(line_row, Hashes.of(data).spans(start, end))
        lines = np.searchsorted(start, part.offsets)
        hashes, bounds = windows(found, window)
        win_row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        again, _ = _repeats(win_row, hashes)
        first_word = np.arange(len(hashes)) - bounds[win_row] + found.first[win_row]
        hit = np.zeros(len(found.start), bool)
        for k in range(window):
            hit[first_word[again] + k] = True
        for name, values in zip(COUNTS, (
                np.diff(found.first), _per_row(inside & ((data & 0xC0) != 0x80), part.offsets),
                _per_row(_SYMBOL[data], part.offsets), np.diff(lines), _per_row(~fresh, lines),
                _per_row(hit, found.first))):
            parts[name].append(values.astype(np.int64))
    return {name: np.concatenate(p) if p else np.zeros(0, np.int64) for name, p in parts.items()}


def with_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and the counts of the text column, in one pass over the texts."""
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept_schema = kept.drop("__text").schema
    out = kept_schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for batch in batches:
            found = counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(found[c]) for c in COUNTS],
                names=batch.schema.names[:-1] + list(COUNTS))

    return kept.mapInArrow(run, out.replace(":", " ") + "".join(f", {c} bigint" for c in COUNTS))
