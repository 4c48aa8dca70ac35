"""Exact removal of every byte that a repeated 200-byte string covers.

Any 200-byte window holds an anchor: the position of its smallest 50-byte
polynomial hash.  Which position that is depends on the window's bytes alone, so
equal windows have their anchors at equal places and meet under one key (the
hash at the anchor).  Only texts with a repeated key are looked at again.  There
an anchor stands for the suffixes that start at the windows it was chosen for.
Two contexts under a key are compared by binary search over prefix hashes for
their common extension to both sides of the anchor, in logarithmic time.  Where
more meet, the suffixes of their windows are merge-sorted by prefix hash of the
length that counts.  Every match is confirmed byte by byte.

Equal texts are one text with a count from the start.  A key under more than
``HEAVY`` contexts is not gathered into a task: its windows are counted by
128 bits of hash in an ordinary aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import Hashes, batch_of, mixed, release, signed, slices, stored

SPAN = 200
GRAM = 50
HEAVY = 20_000
#: Texts are anchored in stretches of this many window starts, so positions fit into 20 bits.
_STRETCH = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by blockwise running minima from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def anchors(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of a text: key, position, and first and last window start that chose it."""
    parts = []
    for base in range(0, len(data) - span + 1, _STRETCH):
        piece = data[base: base + _STRETCH + span - 1]
        start = np.arange(len(piece) - gram + 1)
        hashes = Hashes.of(piece).spans(start, start + gram)
        least = _sliding_min((hashes & ~_LOW) | start.astype(np.uint64), span - gram + 1)
        runs = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (least[runs] & _LOW).astype(np.int64)
        parts.append((hashes[at], base + at, base + runs, base + np.append(runs[1:], len(least)) - 1))
    if not parts:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _texts(column: pa.Array):
    for part in slices(column):
        for k in range(part.last - part.first):
            yield part.data[part.offsets[k]: part.offsets[k + 1]]


def anchor_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("tid", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()),
                        ("hi", pa.int32())])

    def run(batches):
        for batch in batches:
            for tid, data in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if len(data) >= span:
                    key, at, lo, hi = anchors(data, span, gram)
                    yield batch_of(schema, key=signed(key), tid=np.full(len(key), tid), at=at, lo=lo, hi=hi)

    return texts.select("tid", "text").mapInArrow(merged(run, schema),
                                                  "key bigint, tid bigint, at int, lo int, hi int")


def merged(run, schema: pa.Schema, rows: int = 1 << 16):
    """Join the small batches a mapper yields into larger ones."""
    def out(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
    return out


def _contexts(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Bytes around each repeated anchor, from its first window to the end of its last.

    Equal contexts of one text are one row with all their window starts.
    """
    schema = pa.schema([("key", pa.int64()), ("heavy", pa.bool_()), ("tid", pa.int64()), ("rel", pa.int32()),
                        ("starts", pa.list_(pa.int32())), ("copies", pa.int64()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            tids, copies, marks = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for tid, n, own, data in zip(tids, copies, marks, _texts(batch.column(3))):
                raw, seen = data.tobytes(), {}
                for m in own:
                    body = raw[m["lo"]: m["hi"] + span]
                    seen.setdefault((m["key"], m["heavy"], m["at"] - m["lo"], body), []).append(m["lo"])
                keys = list(seen)
                yield batch_of(schema, key=[k[0] for k in keys], heavy=[k[1] for k in keys], tid=[tid] * len(keys),
                               rel=[k[2] for k in keys], starts=list(seen.values()), copies=[n] * len(keys),
                               body=[k[3] for k in keys])

    return texts.join(wanted, "tid").select("tid", "n", "marks", "text").mapInArrow(
        merged(run, schema, 1 << 14),
        "key bigint, heavy boolean, tid bigint, rel int, starts array<int>, copies bigint, body binary")


class Suffixes:
    """Suffixes of joined contexts, compared through prefix hashes, many pairs at a time."""

    def __init__(self, bodies: list[bytes]):
        self.ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
        self.begins = self.ends - np.array([len(b) for b in bodies], np.int64)
        self.raw = b"".join(bodies)
        self.hashes = Hashes.of(np.frombuffer(self.raw, np.uint8))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Length of the common extension from positions a and b, to the right (step 1) or left (-1), by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            if step > 0:
                same = self.hashes.spans(a, a + mid) == self.hashes.spans(b, b + mid)
            else:
                same = self.hashes.spans(a - mid, a) == self.hashes.spans(b - mid, b)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def equal(self, a: int, b: int, n: int) -> bool:
        return self.raw[a: a + n] == self.raw[b: b + n]


def repeated_windows(groups: list[list[tuple[int, bytes]]], span: int) -> list[np.ndarray]:
    """For the distinct contexts (place of the anchor, bytes) of each key: which window starts also occur in another.

    The answer lists the contexts of all groups in order.
    """
    rels = np.array([rel for g in groups for rel, _ in g], np.int64)
    text = Suffixes([body for g in groups for _, body in g])
    key = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    sizes = np.array([len(g) for g in groups], np.int64)
    first = np.cumsum(sizes) - sizes
    windows_of = text.ends - text.begins - span + 1
    hit = np.zeros(len(text.raw) + 1, bool)
    # Two contexts: their suffixes at the anchors, extended to both sides.
    i = first[sizes == 2]
    j = i + 1
    a, b = text.begins[i] + rels[i], text.begins[j] + rels[j]
    right = text.common(a, b, np.minimum(text.ends[i] - a, text.ends[j] - b), 1)
    left = text.common(a, b, np.minimum(rels[i], rels[j]), -1)
    long = left + right >= span
    for x, y, n in zip((a - left)[long].tolist(), (b - left)[long].tolist(), (left + right)[long].tolist()):
        if text.equal(x, y, n):
            hit[x: x + n - span + 1] = hit[y: y + n - span + 1] = True
    # More: the suffixes of all their windows are merge-sorted by key and hash, and each is confirmed against the first
    # of its class.
    rows = np.flatnonzero(sizes[key] > 2) if len(key) else np.zeros(0, np.int64)
    n = windows_of[rows]
    at = np.repeat(text.begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    of, h = np.repeat(key[rows], n), text.hashes.spans(at, at + span)
    order = np.lexsort((h, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    head = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    later = ~fresh
    x, y = at[order[later]], at[head[later]]
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    # Windows that follow each other against the same context are confirmed in one comparison.
    cut = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)]))
    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(x)).tolist()):
        c, d, m = int(x[lo]), int(y[lo]), hi - lo
        if text.equal(c, d, m - 1 + span):
            hit[c: c + m] = hit[d: d + m] = True
        else:
            for k in range(m):
                if text.equal(c + k, d + k, span):
                    hit[c + k] = hit[d + k] = True
    return [hit[s: s + k] for s, k in zip(text.begins.tolist(), windows_of.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _light(contexts: DataFrame, span: int) -> DataFrame:
    """Repeated window starts (tid, lo, hi) under keys whose contexts fit into a task."""
    schema = pa.schema([("tid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def closed(rows: list[tuple]):
        distinct: dict[tuple, list[tuple]] = {}
        for key, tid, rel, starts, copies, body in rows:
            distinct.setdefault((key, rel, body), []).append((tid, starts, copies))
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key, rel, body in distinct:
            groups.setdefault(key, []).append((rel, body))
        shared = {k: g for k, g in groups.items() if len(g) > 1}
        found = iter(repeated_windows(list(shared.values()), span))
        tids, los, his = [], [], []
        for key, own in groups.items():
            for rel, body in own:
                flags = next(found) if key in shared else None
                owners = distinct[key, rel, body]
                if len(owners) > 1 or len(owners[0][1]) > 1 or owners[0][2] > 1:
                    runs = ((0, len(body) - span),)
                elif flags is None or not flags.any():
                    continue
                else:
                    runs = tuple(zip(*(e.tolist() for e in _runs(flags))))
                for tid, starts, _ in owners:
                    for start in starts:
                        for lo, hi in runs:
                            tids.append(tid)
                            los.append(start + lo)
                            his.append(start + hi)
        return batch_of(schema, tid=tids, lo=los, hi=his)

    def run(batches):
        # Whole keys, several thousand rows at a time.
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= 4096 and row[0] != rows[-1][0]:
                    yield closed(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield closed(rows)

    return contexts.repartition("key").sortWithinPartitions("key") \
        .select("key", "tid", "rel", "starts", "copies", "body") \
        .mapInArrow(merged(run, schema), "tid bigint, lo int, hi int")


def _heavy(contexts: DataFrame, span: int) -> DataFrame:
    """The same for keys with any number of contexts: windows are counted by two hashes."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("tid", pa.int64()), ("lo", pa.int32()),
                        ("copies", pa.int64())])

    def run(batches):
        for batch in batches:
            for tid, starts, copies, body in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - span + 1)
                first = Hashes.of(data).spans(at, at + span)
                # Other bytes under the same base: an independent second hash.
                second = Hashes.of((mixed(data.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)).spans(at, at + span)
                n = len(starts)
                yield batch_of(schema, h1=signed(np.tile(first, n)), h2=signed(np.tile(second, n)),
                               tid=np.full(len(at) * n, tid), lo=(np.array(starts)[:, None] + at).ravel(),
                               copies=np.full(len(at) * n, copies))

    rows = contexts.select("tid", "starts", "copies", "body").mapInArrow(
        merged(run, schema), "h1 bigint, h2 bigint, tid bigint, lo int, copies bigint")
    again = rows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    return rows.join(again, ["h1", "h2"]).select("tid", "lo", F.col("lo").alias("hi"))


def repeated_bytes(docs: DataFrame, text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                   heavy: int = HEAVY) -> DataFrame:
    """Per distinct text: digest (md5 of its UTF-8 bytes), n_bytes, spans removed and the bytes kept.

    ``spans`` are maximal runs (start, end) in bytes.  Null counts as empty;
    texts shorter than ``span`` keep everything; a text that occurs in several
    rows repeats itself; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = stored(docs.select(text.alias("text")).groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
                   .agg(F.first("text").alias("text"), F.count("*").alias("n"))
                   .withColumn("tid", F.monotonically_increasing_id()), "texts")
    release(spark)
    marks = stored(anchor_rows(texts, span, gram), "anchors")
    shared = marks.groupBy("key").agg(F.count("*").alias("c")).where("c > 1") \
        .select("key", (F.col("c") > heavy).alias("heavy"))
    wanted = marks.join(shared, "key").groupBy("tid").agg(
        F.collect_list(F.struct("key", "heavy", "at", "lo", "hi")).alias("marks"))
    contexts = stored(_contexts(texts, wanted, span), "contexts")
    release(spark)
    found = _light(contexts.where(~F.col("heavy")), span).unionByName(_heavy(contexts.where("heavy"), span))
    per_text = stored(found.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    release(spark)

    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            digests, copies, runs = (batch.column(i).to_pylist() for i in (0, 1, 2))
            n_bytes, spans, kept = [], [], []
            for n, own, data in zip(copies, runs, _texts(batch.column(3))):
                edge = np.zeros(len(data) + 1, np.int32)
                if n > 1 and len(data) >= span:
                    own = [{"lo": 0, "hi": len(data) - span}]
                if own:
                    np.add.at(edge, [r["lo"] for r in own], 1)
                    np.add.at(edge, [r["hi"] + span for r in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                lo, hi = _runs(gone)
                n_bytes.append(len(data))
                spans.append([{"start": s, "end": e + 1} for s, e in zip(lo.tolist(), hi.tolist())])
                kept.append(data[~gone].tobytes())
            yield batch_of(schema, digest=digests, n_bytes=n_bytes, spans=spans, kept=kept)

    return texts.join(per_text, "tid", "left").select("digest", "n", "runs", "text").mapInArrow(
        cut, "digest string, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def text_digest(text_col: str = "text"):
    """Column that names a row's text in the result of ``repeated_bytes``."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
