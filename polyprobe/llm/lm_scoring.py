"""Stupid-backoff scores of documents; counts of n-grams come back to the documents that hold them.

Counts come from the whole corpus.  An occurrence does not vouch for itself: its
own count is taken off everywhere, so an n-gram that occurs once backs off.
With ``b = log(0.4)``

    S1(w)        = log(max(c(w) - 1, 1/2) / N)
    Sk(prefix w) = log((c(prefix w) - 1) / (c(prefix) - 1))   if the k-gram occurs again
                   = b + S(k-1)(suffix w)                       otherwise

Documents are dealt into blocks of bounded size by a hash of their content, so
a block is the same whenever it is read.  Order by order a block sends its
distinct n-grams, with how often it holds each, to buckets of hashes.  A bucket
adds them up and answers every block in the order it was asked, so an answer
is a list of counts and needs no keys.  Only k-grams both of whose (k - 1)-grams occur again are
sent.  Counts of the most frequent n-grams are shipped to all tasks instead, a
bounded number of them.  n-grams are 64-bit hashes; blocks and buckets grow in
number, not in size, with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import mixed, release, signed, slices, stored, words

BACKOFF = 0.4
UNSEEN = 0.5
#: Bytes of text in a block, and of the corpus for each bucket; small corpora have so many of them.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
MIN_BLOCKS, MIN_BUCKETS = 128, 64
#: What a row takes beside its text.
ROW_BYTES = 16
#: Most frequent n-grams of an order whose counts are shipped to all tasks: 8 MB.
MAX_FREQUENT = 1 << 19
#: Lower ends of the levels by which frequent n-grams are chosen, eight for each doubling.
LEVELS = np.unique(np.ceil(2.0 ** (np.arange(8, 8 * 62) / 8)).astype(np.int64))

_LONGS = pa.list_(pa.field("element", pa.int64()))
_SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("h", _LONGS), ("times", _LONGS)])
SENT_TYPE = "block bigint, bucket bigint, h array<bigint>, times array<bigint>"
_COUNTED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("c", _LONGS), ("h", _LONGS), ("again", _LONGS),
                      ("total", pa.int64())])
COUNTED_TYPE = "block bigint, bucket bigint, c array<bigint>, h array<bigint>, again array<bigint>, total bigint"
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
SCORED_TYPE = "doc_id bigint, n_words bigint, log_score double"


def joined_hash(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of a k-gram from those of its first and last k - 1 words."""
    return mixed(mixed(prefix) + np.uint64(3) * suffix)


def _flat(lists: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Values of all lists of a column."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(kind)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before."""
    return np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]])


class Frequent:
    """Counts of the most frequent n-grams, ``limit`` at most: documents that hold them need no answer from a bucket.

    All n-grams that occur ``least`` times or more, the smallest such level that
    few enough reach (null: none); the counts of the others come from the
    buckets, so the bound changes no result.
    """

    def __init__(self, terms: DataFrame, limit: int = MAX_FREQUENT):
        spark = terms.sparkSession

        def levels(batches):
            for batch in batches:
                level = np.searchsorted(LEVELS, _flat(pa.chunked_array([batch.column(1)]), np.int64), "right")
                n = np.bincount(level, minlength=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["level", "n"])

        found = terms.mapInArrow(levels, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
        room, least = limit, None
        for level, n in found.orderBy(F.desc("level")).collect():
            room -= n
            if room < 0:
                break
            least = int(LEVELS[level - 1])
        self.least = least

        def chosen(batches):
            for batch in batches:
                h, c = (_flat(pa.chunked_array([x]), np.int64) for x in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= least]), pa.array(c[c >= least])], names=["h", "c"])

        h = c = np.zeros(0, np.int64)
        if least is not None:
            rows = terms.mapInArrow(chosen, "h bigint, c bigint").toArrow()
            h, c = (rows.column(name).to_numpy() for name in ("h", "c"))
        by = np.argsort(h.view(np.uint64))
        self.terms = spark.sparkContext.broadcast((h.view(np.uint64)[by], c[by]))

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are among them, and the counts of those."""
        h, c = self.terms.value
        if not len(h):
            return np.zeros(len(hashes), bool), c
        at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
        inside = h[at] == hashes
        return inside, c[at[inside]]


class _Block:
    """Words of a block's documents, and the counts of their n-grams as far as they are known."""

    def __init__(self, docs: pa.Table):
        found = [words(part) for part in slices(docs.column("text").cast(pa.large_string()).combine_chunks())]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *(x.hash for x in found)])
        self.n_words = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.first) for x in found)])
        self.row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.copies = docs.column("copies").to_numpy()
        self.order = 1
        self.asked = np.ones(len(self.gram), bool)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams to ask for, ascending, how often each occurs, and the place among them of each occurrence."""
        grams = self.gram[self.asked]
        by = np.argsort(grams)
        ordered = grams[by]
        new = _runs(ordered)
        starts = np.flatnonzero(new)
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        times = np.diff(np.append(starts, len(by)))
        if (self.copies > 1).any():
            of = self.copies[self.row[: len(self.gram)]][self.asked][by]
            times = np.add.reduceat(of, starts) if len(of) else times
        return ordered[starts], times, place

    def counts(self, answers: np.ndarray, frequent: Frequent) -> np.ndarray:
        """Corpus count of the n-gram that starts at each word, 0 for those not asked for."""
        grams, _, place = self.distinct()
        known, shipped = frequent.split(grams)
        if len(grams) - len(shipped) != len(answers):
            raise ValueError(f"{len(answers)} counts for {len(grams) - len(shipped)} n-grams: documents changed between two reads")
        each = np.empty(len(grams), np.int64)
        each[known], each[~known] = shipped, answers
        counts = np.zeros(len(self.gram), np.int64)
        counts[self.asked] = each[place]
        return counts

    def lengthen(self, counts: np.ndarray) -> None:
        """Go on to the n-grams of one word more."""
        again = counts > 1
        self.order += 1
        self.gram = joined_hash(self.gram[:-1], self.gram[1:])
        self.asked = again[:-1] & again[1:] & (self.row[: len(self.gram)] == self.row[self.order - 1:])

    def answered(self, met: pa.Table, frequent: list[Frequent]):
        """Counts by order, going on to the next after each."""
        met = met.sort_by([("k", "ascending"), ("bucket", "ascending")])
        ends = np.searchsorted(met.column("k").to_numpy(), np.arange(len(frequent) + 1), "right")
        for k, shipped in enumerate(frequent):
            counts = self.counts(_flat(met.column("c").slice(ends[k], ends[k + 1] - ends[k]), np.int64), shipped)
            yield counts
            self.lengthen(counts)


def _sent(docs: DataFrame, met: DataFrame | None, frequent: list[Frequent], n_buckets: int) -> DataFrame:
    """A row per block and bucket: ``h``, the distinct n-grams of the next order, ascending, and ``times`` each occurs."""

    def sent(own: pa.Table, answers: pa.Table | None) -> pa.Table:
        block = _Block(own)
        for _ in block.answered(answers, frequent) if frequent else ():
            pass
        grams, times, _ = block.distinct()
        # Ascending with the hash, so the answers of the buckets follow each other.
        bucket = (grams >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        starts = np.flatnonzero(_runs(bucket))
        ends = pa.array(np.append(starts, len(grams)), pa.int32())
        return pa.Table.from_arrays([
            pa.repeat(own.column("block")[0], len(starts)), pa.array(bucket[starts].astype(np.int64)),
            pa.ListArray.from_arrays(ends, pa.array(signed(grams)), type=_LONGS),
            pa.ListArray.from_arrays(ends, pa.array(times), type=_LONGS)], schema=_SENT)

    own = docs.groupBy("block")
    if met is None:
        return own.applyInArrow(lambda table: sent(table, None), SENT_TYPE)
    return own.cogroup(met.groupBy("block")).applyInArrow(sent, SENT_TYPE)


def _counted(sent: DataFrame) -> DataFrame:
    """The answers: a row per block and bucket with the counts ``c`` of its n-grams, in their order.

    And a row per bucket, its block null: the n-grams ``h`` that occur again,
    their counts ``again``, and the ``total`` of all counts.
    """

    def added(asked: pa.Table) -> pa.Table:
        lists = asked.column("h").combine_chunks()
        grams, times = _flat(asked.column("h"), np.uint64), _flat(asked.column("times"), np.int64)
        by = np.argsort(grams)
        ordered = grams[by]
        starts = np.flatnonzero(_runs(ordered))
        c = np.add.reduceat(times[by], starts)
        each = np.empty(len(by), np.int64)
        each[by] = np.repeat(c, np.diff(np.append(starts, len(by))))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        n, again = len(asked), c > 1
        none = pa.nulls(n, _LONGS)
        answers = [asked.column("block").combine_chunks(), asked.column("bucket").combine_chunks(),
                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each), type=_LONGS), none, none,
                   pa.nulls(n, pa.int64())]
        own = [pa.nulls(1, pa.int64()), pa.array([asked.column("bucket")[0].as_py()]), pa.nulls(1, _LONGS),
               pa.array([signed(ordered[starts[again]])], _LONGS), pa.array([c[again]], _LONGS), pa.array([int(c.sum())])]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=_COUNTED) for x in (answers, own)])

    return sent.groupBy("bucket").applyInArrow(added, COUNTED_TYPE)


def _scores(block: _Block, counts: list[np.ndarray], total: int) -> np.ndarray:
    """Sum over the words of each row of the log of their scores."""
    log_b = math.log(BACKOFF)
    n, row = len(block.row), block.row
    # Of the longest n-gram so far that ends at each word.
    score = np.log(np.maximum(counts[0] - 1, UNSEEN) / total)
    for k, c in enumerate(counts[1:], 2):
        # The n-gram from word i on ends at word i + k - 1, and so does its suffix, whose score stands there.
        inside = row[: len(c)] == row[k - 1:]
        again = c > 1
        later = score[k - 1:]
        ratio = np.log((c[again] - 1) / (counts[k - 2][: len(c)][again] - 1))
        later[inside] += log_b
        later[again] = ratio
    return np.bincount(row, score, minlength=len(block.n_words)) if n else np.zeros(len(block.n_words))


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ``block`` and ``copies``, and the bytes of all.

    Equal rows fall into one block, so those that would fill it become one row;
    ``copies`` says how many it stands for.
    """
    key = F.xxhash64("doc_id", "text")
    sizes = rows.select(key.alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("size")) \
        .groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    full = (F.col("n") > 1) & (F.col("size") > BLOCK_BYTES)
    size, many = sizes.agg(F.sum("size"), F.count_if(full)).first()
    size = size or 0
    each = rows.withColumn("copies", F.lit(1).cast("bigint"))
    if many:  # one for each BLOCK_BYTES of the corpus at most
        chosen = F.broadcast(stored(sizes.where(full).select("key"), "copied"))
        keyed = each.withColumn("key", key)
        one = keyed.join(chosen, "key", "left_semi").groupBy("doc_id", "text").agg(F.sum("copies").alias("copies"))
        each = keyed.join(chosen, "key", "left_anti").drop("key").unionByName(one)
    return each.withColumn("block", F.pmod(key, F.lit(max(MIN_BLOCKS, size // BLOCK_BYTES)))), size


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and log_score (sum over words of the natural log of the backoff score).

    A null, empty or blank text has no words and score 0.  Rows that repeat an
    id are one document; rows with a null id are counted in the corpus and
    summed under null; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, size = _dealt(rows)
    n_buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    met, frequent, total = None, [], 1
    for k in range(1, order + 1):
        counted = stored(_counted(_sent(rows, met, frequent, n_buckets)), f"counts{k}")
        release(spark)
        if k == 1:
            total = counted.agg(F.sum("total")).first()[0] or 1
        shipped = Frequent(counted.where("block is null").select("h", "again"))
        answers = F.col("c") if shipped.least is None else F.filter("c", lambda c: c < shipped.least)
        answers = counted.where("block is not null").select("block", F.lit(k).alias("k"), "bucket", answers.alias("c"))
        met = answers if met is None else met.unionByName(answers)
        frequent = [*frequent, shipped]
    known = frequent

    def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(own)
        counts = list(block.answered(answers, known))
        return pa.Table.from_arrays([own.column("doc_id"), pa.array(block.n_words * block.copies),
                                     pa.array(_scores(block, counts, total) * block.copies)], schema=_SCORED)

    return rows.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(scored, SCORED_TYPE) \
        .groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))


#: The same for order 3 and distinct ids, on DuckDB.
ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (
  SELECT doc_id, w, i, lag(w) OVER before AS p, lag(w, 2) OVER before AS q
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split) AS listed
  WINDOW before AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM words GROUP BY w),
n AS (SELECT count(*) AS n FROM words),
c2 AS (SELECT p, w, count(*) AS c FROM words WHERE p IS NOT NULL GROUP BY p, w),
c3 AS (SELECT q, p, w, count(*) AS c FROM words WHERE q IS NOT NULL GROUP BY q, p, w),
scored AS (
  SELECT words.doc_id, CASE WHEN words.q IS NOT NULL AND c3.c > 1 THEN ln((c3.c - 1) / (cqp.c - 1))
    ELSE CASE WHEN words.q IS NULL THEN 0 ELSE ln(0.4) END
      + CASE WHEN words.p IS NOT NULL AND c2.c > 1 THEN ln((c2.c - 1) / (cp.c - 1))
        ELSE CASE WHEN words.p IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(c1.c - 1, 0.5) / n.n) END END AS s
  FROM words JOIN c1 ON c1.w = words.w CROSS JOIN n LEFT JOIN c1 cp ON cp.w = words.p
  LEFT JOIN c2 ON c2.p = words.p AND c2.w = words.w
  LEFT JOIN c2 cqp ON cqp.p = words.q AND cqp.w = words.p
  LEFT JOIN c3 ON c3.q = words.q AND c3.p = words.p AND c3.w = words.w)
SELECT split.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(t.s, 0), 3) AS log_score
FROM split LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) t ON t.doc_id = split.doc_id
"""
