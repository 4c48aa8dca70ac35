"""Vocabulary ids that can begin an answer word."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from polyprobe.functions import words as W
from polyprobe.functions.trie import Codes, PieceTrie, PrefixForest, sorted_sets

#: Pieces and bytes of a vocabulary that is shipped whole; a larger one is cut by first character.
MAX_PIECES, MAX_PIECE_BYTES = 2_000_000, 64 << 20
#: Words of one first character that meet its part of a cut vocabulary in one task.
PART_WORDS = 200_000
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


@dataclass
class FirstTokenizer:
    """First token of texts under a model's tokenizer.

    ``first`` codes a list of texts.  ``horizon`` is the number of leading
    characters that decide the first token, if the tokenizer has such a bound;
    longer prefixes then share the result, and time is linear in a word.
    """

    first: Callable[[list[str]], list[int | None]]
    horizon: int | None = None


class _Coder:
    """Candidate ids of an Arrow column of words."""

    def __init__(self, trie: PieceTrie, bytes_known: dict[int, int], tokenizer: FirstTokenizer | None):
        self.trie, self.tokenizer = trie, tokenizer
        self.byte_id = np.full(256, -1, np.int64)
        for byte, i in bytes_known.items():
            # A byte that prints as itself has no piece of its own; tab, line feed and carriage return have escapes.
            if byte >= 0x7F or byte < 0x20 and byte not in b"\t\n\r":
                self.byte_id[byte] = i

    def ids(self, words: pa.Array) -> pa.ListArray:
        codes = Codes(words, max(self.trie.depth, 1))
        coded = self.trie.coded(codes)
        found = [self.trie.walk(codes, coded), self.trie.walk(codes, coded, W.WORD_START), self._first_bytes(codes)]
        if self.tokenizer is not None:
            texts = pc.fill_null(words, "")
            limit = self.tokenizer.horizon
            forest = PrefixForest(texts.to_pylist(), Codes(texts, limit or int(pc.max(pc.utf8_length(texts)).as_py() or 0)))
            found.append(forest.first_tokens(self.tokenizer.first(forest.names)))
        return sorted_sets(len(words), *(np.concatenate(x) for x in zip(*found)))

    def _first_bytes(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(codes.size > 0)
        point = codes.flat[codes.start[rows]].astype(np.int64)
        lead = np.select([point < 0x80, point < 0x800, point < 0x10000],
                         [point, 0xC0 | point >> 6, 0xE0 | point >> 12], 0xF0 | point >> 18)
        ids = self.byte_id[lead]
        return rows[ids >= 0], ids[ids >= 0]


def _byte_pieces(vocab: DataFrame) -> dict[int, int]:
    """Ids of the byte pieces, 256 at most."""
    rows = vocab.where(F.col("piece").rlike(f"^{_BYTE_PIECE.pattern}$")).collect()
    return {int(_BYTE_PIECE.match(r["piece"])[1], 16): r["token_id"] for r in rows}


def candidate_ids(
    words: DataFrame, vocab: DataFrame, keys: list[str], word: str = "word",
    load_tokenizer: Callable[[], FirstTokenizer] | None = None,
) -> DataFrame:
    """Sorted distinct ``token_ids`` per row; [] where the vocabulary has none.

    The candidates of a word are the pieces that are a prefix of it, those that
    are the word-start marker and a prefix, and the byte piece of its first
    byte.  One walk over a trie of the pieces finds each kind, so a word is one
    row throughout and costs no more steps than the longest piece has letters.
    Model families that need it pass a tokenizer, which adds the first token of
    every prefix of the word.  ``keys`` must contain ``word``.
    """
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()
    if size["n"] > MAX_PIECES or size["b"] > MAX_PIECE_BYTES:
        return _by_first_character(words, vocab, keys, word, load_tokenizer)
    rows = vocab.select("piece", "token_id").toArrow()
    trie = PieceTrie(rows.column("piece").to_pylist(), rows.column("token_id").to_pylist())
    shared: Broadcast = words.sparkSession.sparkContext.broadcast((trie, _byte_pieces(vocab)))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _Coder(*shared.value, load_tokenizer and load_tokenizer())
        for batch in batches:
            yield coder.ids(batch)

    return words.select(*keys, ids(F.col(word)).alias("token_ids"))


def _by_first_character(
    words: DataFrame, vocab: DataFrame, keys: list[str], word: str, load_tokenizer: Callable[[], FirstTokenizer] | None
) -> DataFrame:
    """The same for a vocabulary too large to ship: words meet the pieces of their first character.

    A marked piece goes by the character after the marker, too.  Words of a
    frequent character are cut into parts.
    """
    first, second = F.substring("piece", 1, 1), F.substring("piece", 2, 1)
    leads = F.array_distinct(F.when(first == W.WORD_START, F.array(first, second)).otherwise(F.array(first)))
    pieces = vocab.select("piece", "token_id", F.explode(leads).alias("lead")).where(F.length("lead") > 0)
    led = words.select(*keys, F.coalesce(F.substring(word, 1, 1), F.lit("")).alias("_lead"))
    parts = led.groupBy(F.col("_lead").alias("lead")).agg(
        F.ceil(F.count(F.lit(1)) / PART_WORDS).cast("int").alias("parts"))
    dealt = pieces.join(parts, "lead").select(
        F.col("lead").alias("p_lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part"), "piece", "token_id")
    asked = led.join(parts.withColumnRenamed("lead", "_lead"), "_lead").withColumn(
        "_part", F.pmod(F.xxhash64(word), F.col("parts")).cast("int")).drop("parts")
    bytes_known = _byte_pieces(vocab)

    def walk(of_words: pa.Table, of_pieces: pa.Table) -> pa.Table:
        trie = PieceTrie(of_pieces.column("piece").to_pylist(), of_pieces.column("token_id").to_pylist())
        coder = _Coder(trie, bytes_known, load_tokenizer and load_tokenizer())
        column = of_words.column(word).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return of_words.select(keys).append_column("token_ids", coder.ids(column))

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in words.select(*keys).schema), "token_ids array<int>"])
    return asked.groupBy("_lead", "_part").cogroup(dealt.groupBy("p_lead", "p_part")).applyInArrow(walk, out)


def ids_to_pieces(df: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "token_ids") -> DataFrame:
    """``pieces`` in the order of ``ids``; [] where there are no ids, and unknown ids are left out."""
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("b")).first()
    if size["n"] > MAX_PIECES or size["b"] > MAX_PIECE_BYTES:
        listed = df.select(*keys, F.posexplode_outer(ids).alias("_pos", "token_id")).join(vocab, "token_id", "left")
        known = F.when(F.col("piece").isNotNull(), F.struct("_pos", "piece"))
        return listed.groupBy(*keys).agg(
            F.transform(F.sort_array(F.collect_list(known)), lambda p: p["piece"]).alias("pieces"))
    rows = vocab.select("token_id", "piece").orderBy("token_id").toArrow()
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("array<string>")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, pieces = shared.value.column("token_id").to_numpy(), shared.value.column("piece").combine_chunks()
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            have = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            upto = np.searchsorted(row[have], np.arange(len(batch) + 1))
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pieces.take(pa.array(at[have], pa.int64())))

    return df.select(*keys, spelled(F.col(ids)).alias("pieces"))


def with_forced_stem(answer_words: DataFrame) -> DataFrame:
    """Add the stem the class words of a language share and the rest of each word.

    A shared stem carries no information about the class: it is appended to
    the prompt and the candidates are taken from the remainders.
    """
    keys = ["task", "label_mode", "lang"]
    stems = answer_words.groupBy(*keys).agg(
        W.common_prefix(F.sort_array(F.collect_set("word"))).alias("stem"))
    return answer_words.join(stems, keys).withColumn(
        "rest", F.col("word").substr(F.length("stem") + 1, F.length("word")))


def class_table(answer_words: DataFrame, vocab: DataFrame, families: dict[str, Callable[[], FirstTokenizer] | None]) -> DataFrame:
    """One row per (family, task, label_mode, lang) with its classes.

    ``classes`` is sorted by class name and holds class, word, gold_word and
    token_ids.  ``families`` maps a model family to the loader of its tokenizer,
    or to None where spelling alone decides.
    """
    keys = ["task", "label_mode", "lang", "stem", "class", "word", "gold_word", "rest"]
    stemmed = with_forced_stem(answer_words)
    per_family = [
        candidate_ids(stemmed, vocab, keys, "rest", load).withColumn("family", F.lit(family))
        for family, load in families.items()
    ]
    every = per_family[0]
    for more in per_family[1:]:
        every = every.unionByName(more)
    return every.groupBy("family", "task", "label_mode", "lang", "stem").agg(
        F.sort_array(F.collect_list(F.struct("class", "word", "gold_word", "token_ids"))).alias("classes")
    )
