"""Words one edit apart, their common spelling, and the root of each chain of spellings.

Words of one length are points of a k-d tree over their letter counts.  An edit
moves a word little: a replaced letter takes one from a count and adds one to
another, an inserted letter adds one.  So the partners of a word lie in a box
of one up and one down in the tree of its own length, and of one up in the tree
of the next length; a subtree is entered only if the box meets it.  Whatever
remains at a leaf is compared by distance of counts and then letter by letter.

The upper levels of the trees deal the words to buckets of bounded size: each
level is chosen from counts over all words, and only the splits (about two per
bucket) reach the driver.  Every word is a point of one bucket and a query to
the buckets its boxes meet; the queries of a bucket are cut into parts, so no
task holds more than a bucket and a part.  Inside, the tree goes on to leaves.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from polyprobe.llm.common import stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Points of a bucket, queries of a part and points of a leaf.
BUCKET_WORDS, PART_QUERIES, LEAF_WORDS = 8_192, 65_536, 64
#: Characters a run may hold, in the order of their counts.
LETTERS = np.array([*range(97, 123), *range(192, 256)])
_PLACE = np.zeros(256, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))
#: Products of counts compared at a time.
_CELLS = 1 << 22


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = ~text.rlike("[\\u0080-\\uFFFF\\x{10000}-\\x{10FFFF}]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, slip_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the letter runs of all texts, at least so long and so frequent.

    With ``slip_every`` a run whose crc32 of ``<id>:<run>`` it divides loses
    the letter at that number modulo the run's length, in every occurrence
    within the document.  A null id counts as empty.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(
        F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(RUN), F.lit(0))).alias("word"))
    if slip_every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.select(F.when(h % slip_every == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= min_count)


# ---- letter counts and trees ------------------------------------------------

class Words:
    """Words of one length: their characters and letter counts, one row each."""

    def __init__(self, words: list[bytes], length: int):
        self.codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)
        kind = np.int16 if length < 1 << 15 else np.int32
        self.counts = np.zeros((len(words), len(LETTERS)), kind)
        row = np.repeat(np.arange(len(words)), length)
        np.add.at(self.counts, (row, _PLACE[self.codes.ravel()]), 1)


def latin(words: pa.Array) -> list[bytes]:
    """One byte per letter; their order is that of code points."""
    return [w.encode("latin-1") for w in words.to_pylist()]


class Tree:
    """Splits of one or more k-d trees: a node sends counts of ``letter`` up to ``top`` left, the others right.

    A leaf has no children (-1).
    """

    def __init__(self):
        self.letter, self.top, self.left, self.right = [], [], [], []
        self.roots: dict[int, int] = {}

    def leaf(self) -> int:
        for column, value in ((self.letter, 0), (self.top, 0), (self.left, -1), (self.right, -1)):
            column.append(value)
        return len(self.left) - 1

    def split(self, node: int, letter: int, top: int) -> tuple[int, int]:
        self.letter[node], self.top[node] = letter, top
        self.left[node], self.right[node] = self.leaf(), self.leaf()
        return self.left[node], self.right[node]

    def visits(self, root: int, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the rows whose box meets them.

        The box of a row holds the counts that differ from it by at most
        ``up`` more and ``down`` fewer letters, each 0 or 1.
        """
        todo = [(root, np.arange(len(counts)), np.full(len(counts), up, np.int8), np.full(len(counts), down, np.int8))]
        while todo:
            node, rows, ups, downs = todo.pop()
            if not len(rows):
                continue
            if self.left[node] < 0:
                yield node, rows
                continue
            own, top = counts[rows, self.letter[node]], self.top[node]
            low = own <= top
            # A row next to the border may step over it, once in each direction.
            under, over = (own == top + 1) & (downs > 0), (own == top) & (ups > 0)
            to_left, to_right = low | under, ~low | over
            todo.append((self.left[node], rows[to_left], ups[to_left], (downs - under)[to_left]))
            todo.append((self.right[node], rows[to_right], (ups - over)[to_right], downs[to_right]))


def _balanced(counts: np.ndarray) -> tuple[int, int] | None:
    """Letter and border that divide the rows most evenly, or None if all rows are equal."""
    n, best = len(counts), None
    for top in range(int(counts.max(initial=0))):
        uneven = np.abs(2 * (counts <= top).sum(axis=0) - n)
        letter = int(uneven.argmin())
        if best is None or uneven[letter] < best[0]:
            best = (int(uneven[letter]), letter, top)
        elif top > 3:
            break
    return best[1:] if best and best[0] < n else None


def local_tree(counts: np.ndarray, leaf: int = LEAF_WORDS) -> tuple[Tree, dict[int, np.ndarray]]:
    """Tree over all rows, and the rows of each leaf."""
    tree, members = Tree(), {}
    todo = [(tree.leaf(), np.arange(len(counts)))]
    while todo:
        node, rows = todo.pop()
        found = _balanced(counts[rows]) if len(rows) > leaf else None
        if found is None:
            members[node] = rows
            continue
        low = counts[rows, found[0]] <= found[1]
        left, right = tree.split(node, *found)
        todo += [(left, rows[low]), (right, rows[~low])]
    return tree, members


# ---- pairs inside a bucket --------------------------------------------------

def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row b is row a with one more letter: what they share in front and at the end covers a."""
    front = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return front + back >= a.shape[1]


def near_pairs(queries: Words, points: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, point) of words exactly one edit apart; points are as long as the queries or one longer."""
    longer = points.codes.shape[1] - queries.codes.shape[1]
    tree, members = local_tree(points.counts)
    exact = np.float32 if points.codes.shape[1] < 4096 else np.float64
    q, p = queries.counts.astype(exact), points.counts.astype(exact)
    q_square, p_square = (q * q).sum(axis=1), (p * p).sum(axis=1)
    # The counts differ by one up and one down, or by one up alone.
    distance, verify = (1, _one_inserted) if longer else (2, _one_replaced)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, rows in tree.visits(0, queries.counts, up=1, down=1 - longer):
        own = members[leaf]
        step = max(1, _CELLS // max(len(rows), 1))
        for at in range(0, len(own), step):
            some = own[at: at + step]
            gap = q_square[rows][:, None] + p_square[some][None] - 2 * (q[rows] @ p[some].T)
            i, j = np.nonzero(gap == distance)
            wide = max(1, _CELLS // points.codes.shape[1])
            for k in range(0, len(i), wide):
                a, b = rows[i[k: k + wide]], some[j[k: k + wide]]
                good = verify(queries.codes[a], points.codes[b])
                found.append((a[good], b[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _summed(word: np.ndarray, near: np.ndarray, near_rank: np.ndarray, near_n: np.ndarray):
    """Per word: how many partners, and the row of the one with the largest n, then the smallest rank."""
    order = np.lexsort((near_rank[near], -near_n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][:len(word)])
    return word[first], np.diff(np.r_[first, len(word)]), near[first]


_PARTIAL = "word string, n_near bigint, best_n bigint, best string"


def _search(points: pa.Table, queries: pa.Table) -> pa.Table:
    """Partial results of one bucket and one part of its queries."""
    out: list[tuple] = []
    if points.num_rows and queries.num_rows:
        p_words = latin(points.column("word"))
        length = len(p_words[0])
        whole, p_n = Words(p_words, length), points.column("n").to_numpy()
        q_words, q_n = np.array(latin(queries.column("q")), object), queries.column("qn").to_numpy()
        sizes = np.array([len(w) for w in q_words])
        p_words = np.array(p_words, object)
        p_rank = np.argsort(np.argsort(p_words))
        for size in (length, length - 1):
            rows = np.flatnonzero(sizes == size)
            if not len(rows):
                continue
            a, b = near_pairs(Words(q_words[rows].tolist(), size), whole)
            a = rows[a]
            out += [(q_words, p_words, p_n, *_summed(a, b, p_rank, p_n))]
            if size < length:  # the longer word learns of the shorter one
                out += [(p_words, q_words, q_n, *_summed(b, a, np.argsort(np.argsort(q_words)), q_n))]
    text = [[w.decode("latin-1") for w in of[rows]] for of, _, _, rows, _, _ in out]
    best = [[w.decode("latin-1") for w in other[top]] for _, other, _, _, _, top in out]
    return pa.table({
        "word": pa.array([w for part in text for w in part], pa.string()),
        "n_near": pa.array(np.concatenate([o[4] for o in out]) if out else [], pa.int64()),
        "best_n": pa.array(np.concatenate([o[2][o[5]] for o in out]) if out else [], pa.int64()),
        "best": pa.array([w for part in best for w in part], pa.string())})


# ---- dealing words to buckets -----------------------------------------------

def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Words]]:
    """Length, rows and words of each length in a batch; few cells at a time."""
    words = np.array(latin(batch.column(0)), object)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, _CELLS // max(int(size), len(LETTERS)))
        for k in range(0, len(rows), step):
            yield int(size), rows[k: k + step], Words(words[rows[k: k + step]].tolist(), int(size))


def bucket_tree(words: DataFrame, bucket: int = BUCKET_WORDS) -> Tree:
    """Splits that leave at most ``bucket`` words in a leaf, words with equal letter counts aside.

    Each round asks for one count per open node, letter and value, and takes the
    most even split; the driver sees a row per split.
    """
    spark, tree = words.sparkSession, Tree()
    open_nodes = set()
    for row in words.groupBy(F.length("word").alias("length")).count().collect():  # a row per length
        tree.roots[row["length"]] = tree.leaf()
        if row["count"] > bucket:
            open_nodes.add(tree.roots[row["length"]])
    while open_nodes:
        shared = spark.sparkContext.broadcast((tree, np.array(sorted(open_nodes))))

        def tally(batches):
            known, wanted = shared.value
            for batch in batches:
                for size, _, found in _by_length(batch):
                    for node, rows in known.visits(known.roots[size], found.counts, 0, 0):
                        if node not in wanted:
                            continue
                        counts = found.counts[rows]
                        letter, value = np.broadcast_to(np.arange(counts.shape[1]), counts.shape).ravel(), counts.ravel()
                        key, n = np.unique(value.astype(np.int64) << 8 | letter, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), node)), pa.array(key & 255), pa.array(key >> 8), pa.array(n)],
                            names=["node", "letter", "value", "n"])

        tallied = words.select("word").mapInArrow(tally, "node bigint, letter bigint, value bigint, n bigint") \
            .groupBy("node", "letter", "value").agg(F.sum("n").alias("n"))
        # A window holds the few values one letter's count takes.
        upto = Window.partitionBy("node", "letter").orderBy("value")
        sums = tallied.select("*", F.sum("n").over(upto).alias("low"),
                              F.sum("n").over(Window.partitionBy("node", "letter")).alias("all"))
        even = F.struct(F.abs(2 * F.col("low") - F.col("all")).alias("gap"), "letter", "value", "low", "all")
        best = sums.where(F.col("low") < F.col("all")).groupBy("node").agg(F.min(even).alias("s")).select("node", "s.*")
        open_nodes = set()
        for row in sorted(best.collect()):
            sides = tree.split(row["node"], row["letter"], row["value"])
            for side, n in zip(sides, (row["low"], row["all"] - row["low"])):
                if n > bucket:
                    open_nodes.add(side)
        shared.unpersist()
    return tree


def near_words(words: DataFrame, bucket: int = BUCKET_WORDS, part: int = PART_QUERIES) -> DataFrame:
    """Per word with partners: n_near, and the partner ``best`` of largest ``best_n`` (ties: smallest word).

    ``words`` has distinct words of letters ``RUN`` admits, and n.
    """
    spark = words.sparkSession
    tree = spark.sparkContext.broadcast(bucket_tree(words, bucket))

    def deal(batches):
        known = tree.value
        for batch in batches:
            for size, rows, found in _by_length(batch):
                for goal, up, down in ((size, 0, 0), (size, 1, 1), (size + 1, 1, 0)):
                    if goal not in known.roots:
                        continue
                    for node, some in known.visits(known.roots[goal], found.counts, up, down):
                        take = pa.array(rows[some])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), node)), pa.array(np.full(len(some), up == 0)),
                             batch.column(0).take(take), batch.column(1).take(take)],
                            names=["bucket", "point", "word", "n"])

    dealt = stored(words.select("word", "n").mapInArrow(deal, "bucket bigint, point boolean, word string, n bigint"), "dealt")
    queries = dealt.where(~F.col("point"))
    parts = queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    # Points go with every part of the bucket's queries; a query is in one part.
    points = dealt.where("point").join(parts, "bucket").select(
        F.col("bucket").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "word", "n")
    asked = queries.join(parts, "bucket").select(
        F.col("bucket").alias("qb"), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("qp"),
        F.col("word").alias("q"), F.col("n").alias("qn"))
    found = points.groupBy("b", "p").cogroup(asked.groupBy("qb", "qp")).applyInArrow(_search, _PARTIAL)
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("t")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select(
        "word", "n_near", (-F.col("t.less")).alias("best_n"), F.col("t.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow ``form`` from each word to the last; every round doubles the length of the paths.

    A form is at least twice as frequent as its word, so no path is longer
    than the bits of a count and none returns.
    """
    paths = stored(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not paths.join(ahead, "root", "left_semi").limit(1).count():
            return paths
        paths = stored(paths.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "paths")


def spelling_groups(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2,
                    slip_every: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                    bucket: int = BUCKET_WORDS, part: int = PART_QUERIES) -> DataFrame:
    """Per word: n, n_near, form, form_n, root.

    ``form`` is the near word of largest n (ties: smallest by code points) if
    that is at least ``ratio`` (2 or more) times the word's n, else null;
    ``root`` follows forms to the last and is the word itself without one.

    Null and empty texts have no words; texts of any length are read whole;
    rows with null or repeated ids and equal rows all count; other columns are
    ignored whatever their names; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or paths may not end")
    words = stored(word_counts(docs, min_length, min_count, slip_every, id_col, text_col), "words")
    near = near_words(words, bucket, part)
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "judged")
    last = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
