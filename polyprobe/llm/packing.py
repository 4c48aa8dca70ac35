"""Best-fit packing of whole documents into token sequences of fixed capacity.

Documents are tokenised in place and cut only where longer than a sequence.
Their pieces are range-sorted by length, longest first, so a piece is known by
its rank.  Gaps are sorted too: both sizes are whole numbers up to the capacity,
so a run of equal sizes is one class with a count.  Bulk steps then go through
the lengths in descending order.  Each step sweeps from a length to its
successors among the gaps, gives the next ranks of that length to the tightest
gaps, one per gap and in rank order, updates those gaps, and repeats until all
pieces of the length are placed; where no gap is left, new sequences open.  The
sweep needs counts per class only, a few thousand numbers for any number of
documents, and yields runs (first rank, first sequence, offset); every task then
places its own pieces by rank.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from polyprobe.llm.common import batch_of, slices, stored, words

CAPACITY = 4096
END_ID = 1
#: Word forms remembered by a Python worker before it starts afresh.
CACHE_WORDS = 300_000
_TAIL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
_SLICE = 1 << 21


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


class WordCoder:
    """Token ids of single words, equal to those the tokenizer gives them inside a text.

    The tokenizer splits at white space and between letters and punctuation
    before it merges, so words and their trailing punctuation are coded apart
    and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Whole words, and words without the punctuation after them.
        self.whole: dict[bytes, bytes] = {}
        self.cache: dict[bytes, bytes] = {}
        # Printable bytes stand for themselves in a byte-level vocabulary, the others for characters from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}

    def _encode(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # plain ASCII letters stand for themselves
            return self._packed([token.id for token in self.model.tokenize(word.decode())])
        text = word.decode()
        if text.isalpha() and all(c < "ƀ" and c not in "İŉſ" for c in text):
            # Letters of one kind are one unit for the merges; composed Latin letters are already normal.
            units = "".join(self.letters[b] for b in text.lower().encode())
            ids = [token.id for token in self.model.tokenize(units)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._packed(ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, word: bytes) -> bytes:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = self._encode(word)
        return found

    def code(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of a word without blanks."""
        found = self.whole.get(word)
        if found is None:
            if len(self.whole) >= CACHE_WORDS:
                self.whole.clear()
            found = self.whole[word] = self._code(word)
        return found

    def _code(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold the name of a special token
            return self._known(word)
        body = word.rstrip(_TAIL)
        if len(body) == len(word) or not body or not (body[-1:].isalnum() and body[-1] < 128):
            return self._known(word.lower() if word.isascii() else word)
        if body.isascii():
            body = body.lower()
        return self._known(body) + self._known(word[len(word.rstrip(_TAIL)):])


def _ids_of(part, coder: WordCoder) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a slice, and where each row's ids start."""
    found = words(part)
    if not len(found.start):
        return np.zeros(0, np.uint32), np.zeros(len(part.offsets), np.int64)
    _, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
    raw = part.data.tobytes()
    coded = [coder.code(raw[s:e]) for s, e in zip(found.start[first].tolist(), found.end[first].tolist())]
    sizes = np.array([len(c) for c in coded]) // 4
    flat = np.frombuffer(b"".join(coded), np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    each = sizes[which]
    upto = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(begins[which] - upto[:-1], each) + np.arange(upto[-1])]
    return ids, upto[found.first]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        coder = _coder(tokenizer_path)
        for batch in batches:
            # By position, not by value: an id may be null or repeat.
            rows, piece, start, length, crc = [], [], [], [], []
            for part in slices(batch.column(1), _SLICE):
                ids, bounds = _ids_of(part, coder)
                for k in range(part.last - part.first):
                    own = np.append(ids[bounds[k]: bounds[k + 1]], np.uint32(END_ID))
                    for p, at in enumerate(range(0, len(own), capacity)):
                        cut = own[at: at + capacity]
                        rows.append(part.first + k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.astype("<u4").tobytes()))
            yield batch_of(schema, doc_id=batch.column(0).take(pa.array(rows, pa.int64())), piece=piece, start=start,
                           length=length, ids_crc32=crc)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of ``counts[length]`` pieces per length: runs of (first rank, first sequence, offset).

    Pieces of ranks [first rank, next first rank) go, in order, to consecutive
    sequences at the same offset.  Ranks follow descending length.
    """
    gaps: dict[int, list[list[int]]] = {}
    sizes: list[int] = []  # heap of gap sizes that may have sequences
    runs: list[tuple[int, int, int]] = []
    opened = rank = 0

    def put(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                heapq.heappush(sizes, size)
            gaps[size].append([first, n])

    for length in sorted(counts, reverse=True):
        left, skipped = counts[length], []
        while left:
            while sizes and sizes[0] < length:
                skipped.append(heapq.heappop(sizes))
            if sizes:
                size = sizes[0]
                first, n = gaps[size].pop()
                if n > left:
                    gaps[size].append([first + left, n - left])
                    n = left
                if not gaps[size]:
                    del gaps[size]
                    heapq.heappop(sizes)
            else:
                fit = capacity // length
                first, n, size = opened, -(-left // fit), capacity
                opened += n
                if n * fit > left and n > 1:  # the last new sequence may take fewer
                    put(capacity, first + n - 1, 1)
                    n -= 1
            # The same sequences take pieces of this length while they fit, in rank order.
            while left >= n and size >= length:
                runs.append((rank, first, capacity - size))
                rank, left, size = rank + n, left - n, size - length
            put(size, first, n)
        for size in skipped:
            heapq.heappush(sizes, size)
    starts, sequences, offsets = np.array(runs, np.int64).reshape(-1, 3).T
    return starts, sequences, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Place of every piece: the columns of ``token_pieces``, sequence_id and offset.

    A null, empty or blank text is the end token alone.  A row with a null or
    repeated id is a document like any other.  Ties in length go by id and
    piece; rows equal in both get distinct places.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece")]
    ranked = stored(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("task", F.shiftright("at", 33))
    tasks = ranked.groupBy("task").count()
    # One row per task of the sort.
    begins = tasks.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count")).alias("before"))
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, capacity))

    def place(batches):
        starts, sequences, offsets = runs.value
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(starts, rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[at] + rank - starts[at]), pa.array(offsets[at])],
                names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.join(begins, "task").select(
        *columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")) \
        .mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                            "sequence_id bigint, offset bigint")
