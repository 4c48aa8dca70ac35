"""Which tokens of two tokenizers cover the same bytes, and how often two ids meet in the corpus.

Both tokenizers code a text; where the bytes of either side differ from the
text with a space in front, the row has no tokens.  Otherwise a token is a byte
interval.  All tokens of a slice are sorted by start, the running maximum of
their ends is taken, and a group breaks where a start reaches that maximum: at
the places where both sides end a token.  Inside, every token of the first side
expands over the tokens of the second that it overlaps; these are the links.

Consecutive documents form a block of bounded size.  A task reduces the links
of each document to distinct id pairs, and those of a block to its distinct
pairs with the number of documents that hold them.  Only these short lists are
shuffled and summed over the corpus, and the sums come back to the block, where
the documents' packed links are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import slices, stored

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 12 << 20
_SLICE = 1 << 20
#: Ids of the second side take the low bits of a pair, so a pair fits 32 bits.
B_BITS = 15
A_LIMIT = 1 << 16
#: The rank coder takes texts up to this code point without a longer run of one kind of character; the rest goes to the file's own coder.
_ODD = re.compile("[^\\x00-\\u024F\\u2010-\\u2027]|\\S{1000}|\\s{200}")


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, code: Callable[[list[str]], list], spelled: list[bytes]):
        self.code = code
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first one of each text (one more than texts)."""
        coded = [np.asarray(c, np.int64) for c in self.code(texts)]
        first = np.cumsum([0, *map(len, coded)])
        return np.concatenate(coded) if coded else np.zeros(0, np.int64), first

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - upto + sizes, sizes) + np.arange(upto[-1] if len(ids) else 0)]


@lru_cache(maxsize=2)
def byte_level_side(path: str, ranks_path: str | None) -> Side:
    """Byte-level vocabulary of a tokenizer file.

    ``ranks_path`` names the same vocabulary as merge ranks; the rank coder is
    several times as fast and takes the texts for which both are known to cut
    alike.
    """
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    vocab |= {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    # Printable bytes stand for themselves, the others for characters from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}
    spelled = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        spelled[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    if len(spelled) > A_LIMIT:
        raise ValueError(f"more than {A_LIMIT} ids on the first side")

    def exact(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    if ranks_path is None:
        return Side(exact, spelled)
    import base64

    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def code(texts: list[str]) -> list[list[int]]:
        out = [() if _ODD.search(t) else fast.encode_ordinary(" " + t) for t in texts]
        odd = [k for k, ids in enumerate(out) if not len(ids)]
        for k, ids in zip(odd, exact([texts[k] for k in odd])):
            out[k] = ids
        return out

    return Side(code, spelled)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """Pieces of a SentencePiece model that puts a space in front."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > 1 << B_BITS:
        raise ValueError(f"more than {1 << B_BITS} ids on the second side")
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, model.id_to_piece(i)) for i in range(n))]
    return Side(lambda texts: model.encode(texts, num_threads=1), spelled)


def _rows_equal(side: Side, ids: np.ndarray, first: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row: whether the joined bytes of its tokens are the row's bytes."""
    upto = np.concatenate([[0], np.cumsum(side.sizes[ids])])[first]
    same = np.diff(upto) == np.diff(bounds)
    if same.all():
        wrong = side.bytes_of(ids) != data
        if wrong.any():
            same[np.searchsorted(bounds, np.flatnonzero(wrong), "right") - 1] = False
        return same
    for k in np.flatnonzero(same):
        same[k] = np.array_equal(side.bytes_of(ids[first[k]: first[k + 1]]), data[bounds[k]: bounds[k + 1]])
    return same


def _kept(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the wanted rows, and the first one of each row; the others get none."""
    if rows.all():
        return ids, first
    sizes = np.where(rows, np.diff(first), 0)
    return ids[np.repeat(rows, np.diff(first))], np.concatenate([[0], np.cumsum(sizes)])


def coalesced(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the group of each interval: intervals that touch a common byte, directly or through others, share it."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


_DIGITS = np.frombuffer(b"".join(b"%-6d" % i for i in range(A_LIMIT)), np.uint8).reshape(-1, 6)
_WIDTH = np.array([len(str(i)) for i in range(A_LIMIT)])


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray,
             n_rows: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each row: ids of a group's first side, then of its second."""
    n = len(a) + len(b)
    at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    ids, mark, row = np.empty(n, np.int64), np.full(n, ord(","), np.uint8), np.empty(n, np.int64)
    ids[at_a], ids[at_b], row[at_a], row[at_b] = a, b, row_a, row_b
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
    cells = np.concatenate([_DIGITS[ids], np.zeros((n, 1), np.uint8)], axis=1)
    width = _WIDTH[ids]
    cells[np.arange(n), width] = mark
    flat = cells[np.arange(7) <= width[:, None]].tobytes()
    ends = np.cumsum(width + 1)
    upto = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(n_rows + 1))].tolist()
    return [flat[x: y - 1] if y > x else b"" for x, y in zip(upto, upto[1:])]


def _narrow(x: np.ndarray) -> bytes:
    """The numbers in the smallest unsigned type that holds them; its width leads."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


_ROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                  ("steps", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int32())),
                  ("n_docs", pa.list_(pa.int32()))])
ROW_TYPE = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
            "steps binary, times binary, pairs array<int>, n_docs array<int>")


class _Block:
    """Documents collected so far, with their distinct pairs."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.columns: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def batches(self, number: int):
        """A row per document, then one row with the block's pairs and how many documents hold each."""
        if not self.ids:
            return
        flat = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        own, place, n_docs = np.unique(flat, return_inverse=True, return_counts=True)
        upto = np.cumsum([0, *map(len, self.pairs)])
        done = 0
        for ids, column in zip(self.ids, self.columns):
            n = len(ids)
            steps = [_narrow(np.diff(place[upto[k]: upto[k + 1]], prepend=0)) for k in range(done, done + n)]
            times = [_narrow(self.times[k]) for k in range(done, done + n)]
            done += n
            empty = pa.nulls(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), ids, *(pa.array(column[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                 pa.array(column["groups"], pa.binary()).cast(pa.string()), pa.array(steps, pa.binary()),
                 pa.array(times, pa.binary()), empty, empty], schema=_ROW)
        none = {f.name: pa.nulls(1, f.type) for f in _ROW}
        lists = {"block": pa.array([number]), "pairs": pa.array([own.astype(np.int32)], pa.list_(pa.int32())),
                 "n_docs": pa.array([n_docs.astype(np.int32)], pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_arrays([{**none, **lists}[f.name] for f in _ROW], schema=_ROW)


def _aligned(part, a_side: Side, b_side: Side, block: _Block) -> None:
    """Tokens, groups and links of a slice, added to the block."""
    raw, where = part.data.tobytes(), part.offsets.tolist()
    texts = [raw[x:y].decode() for x, y in zip(where, where[1:])]
    n = len(texts)
    some = np.diff(part.offsets) > 0
    a, first_a = _kept(*a_side.ids(texts), some)
    b, first_b = _kept(*b_side.ids(texts), some)
    # A space goes in front of every text that is not empty.
    data = np.insert(part.data, part.offsets[:-1][some], 32)
    bounds = part.offsets + np.concatenate([[0], np.cumsum(some)])
    good = some & _rows_equal(a_side, a, first_a, data, bounds) & _rows_equal(b_side, b, first_b, data, bounds)
    a, first_a = _kept(a, first_a, good)
    b, first_b = _kept(b, first_b, good)
    row_a, row_b = (np.repeat(np.arange(n), np.diff(f)) for f in (first_a, first_b))
    end_a, end_b = np.cumsum(a_side.sizes[a]), np.cumsum(b_side.sizes[b])
    start_a, start_b = end_a - a_side.sizes[a], end_b - b_side.sizes[b]
    group = coalesced(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
    group_a, group_b = group[:len(a)], group[len(a):]
    n_groups = np.zeros(n, np.int64)
    held = np.diff(first_a) > 0
    n_groups[held] = group_a[first_a[1:][held] - 1] - group_a[first_a[:-1][held]] + 1
    # Tokens of the second side that overlap each token of the first.
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    each = high - low
    upto = np.cumsum(each)
    other = np.repeat(low - upto + each, each) + np.arange(upto[-1] if len(a) else 0)
    links = np.repeat(row_a, each) << 32 | np.repeat(a, each) << B_BITS | b[other]
    n_links = np.bincount(np.repeat(row_a, each), minlength=n)
    distinct, times = np.unique(links, return_counts=True)
    cuts = np.searchsorted(distinct >> 32, np.arange(1, n))
    block.pairs += np.split(distinct & 0xFFFFFFFF, cuts)
    block.times += np.split(times, cuts)
    block.columns.append({
        "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": n_groups, "n_links": n_links,
        "groups": _written(a, b, group_a, group_b, row_a, row_b, n)})


def align(docs: DataFrame, byte_level_path: str, piece_path: str, ranks_path: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, and one per block of documents.

    A document: doc_id, n_a, n_b, n_groups, n_links, groups (ids of both sides,
    ``a1,a2|b1;a3|b2,b3``), and its distinct linked pairs as places in the list
    of its block (``steps`` between places, ``times`` each occurs).  A block:
    ``pairs`` (first id shifted, second id in the low bits) and ``n_docs``, the
    number of its documents that hold each; its other columns are null.

    Null and empty texts, and texts that either side does not give back byte by
    byte, have no tokens: all counts are zero and ``groups`` is empty.  Rows
    with null or repeated ids and equal rows are documents of their own; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    def run(batches):
        a_side, b_side = byte_level_side(byte_level_path, ranks_path), piece_side(piece_path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        block = _Block()
        for batch in batches:
            for part in slices(batch.column(1), _SLICE):
                if block.size and block.size + len(part.data) > BLOCK_BYTES:
                    yield from block.batches(number)
                    block, number = _Block(), number + 1
                block.ids.append(batch.column(0).slice(part.first, part.last - part.first))
                block.size += len(part.data) + part.last - part.first
                _aligned(part, a_side, b_side, block)
        yield from block.batches(number)

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, ROW_TYPE)


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """The documents of ``align``, with n_best and count_sum.

    The count of a pair is the number of documents that hold it linked;
    ``count_sum`` adds it up over a document's links, and ``n_best`` counts the
    links whose count is the highest of their first id, ties included.
    Columns beside those of ``align`` are kept.
    """
    own = set(_ROW.names)
    extra = [f for f in aligned.schema.fields if f.name not in own]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if "groups" in aligned.columns else []),
             *(f.name for f in extra)]
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    aligned = stored(aligned, "aligned")
    docs = aligned.where(F.col("n_a").isNotNull()).select("block", *names, "steps", "times")
    listed = aligned.where(F.col("n_a").isNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "p")) \
        .select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    # A first id has at most as many partners as the second vocabulary has ids.
    a_id = F.shiftrightunsigned("pair", B_BITS).alias("a")
    best = counts.groupBy(a_id).agg(F.max("count").alias("top"))
    marked = stored(counts.withColumn("a", a_id).join(best, "a").select(
        "pair", "count", (F.col("count") == F.col("top")).alias("best")), "pair_counts")
    met = listed.join(marked, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")

    def sums(of_docs: pa.Table, of_pairs: pa.Table) -> pa.Table:
        place = of_pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = of_pairs.column("count").to_numpy(), of_pairs.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for steps, times in zip(of_docs.column("steps").to_pylist(), of_docs.column("times").to_pylist()):
            at, n = np.cumsum(_widened(steps)), _widened(times)
            total.append(int(count[at] @ n))
            n_best.append(int(best[at] @ n))
        return of_docs.select(names).append_column("n_best", pa.array(n_best, pa.int64())) \
            .append_column("count_sum", pa.array(total, pa.int64()))

    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_best bigint", "count_sum bigint"])
    return docs.groupBy("block").cogroup(met.groupBy("of_block")).applyInArrow(sums, out)
