"""Pieces a tokenizer could use to begin a word, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_START = "▁"


def token_prefixes(word: Column, max_len: Column | None = None) -> Column:
    """Every non-empty prefix of ``word`` by code point, shortest first.

    ``max_len`` stops early; passing the longest piece length of a vocabulary
    changes nothing for a later vocabulary lookup and bounds the array.
    """
    n = F.length(word)
    if max_len is not None:
        n = F.least(n, max_len)
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(1), n), lambda i: word.substr(F.lit(1), i)),
    ).otherwise(F.array().cast("array<string>"))


def with_word_start(pieces: Column, marker: str = WORD_START) -> Column:
    """Marked variants of ``pieces`` followed by the pieces themselves."""
    return F.concat(F.transform(pieces, lambda p: F.concat(F.lit(marker), p)), pieces)


def byte_fallback_piece(word: Column) -> Column:
    """``<0xHH>`` for the first UTF-8 byte of ``word``.

    Null unless that byte is outside printable ASCII; tab, line feed and
    carriage return count as printable because they have their own escapes.
    """
    first = F.substring(F.hex(F.encode(F.substring(word, 1, 1), "UTF-8")), 1, 2)
    escaped = (first >= "7F") | ((first < "20") & ~first.isin("09", "0A", "0D"))
    return F.when((F.length(word) > 0) & escaped, F.concat(F.lit("<0x"), first, F.lit(">")))


def common_prefix(words: Column) -> Column:
    """Longest prefix shared by all strings of an array column ('' if none)."""
    shared = F.filter(
        token_prefixes(F.get(words, 0)),
        lambda p: F.forall(words, lambda w: F.startswith(w, p)),
    )
    return F.coalesce(F.get(shared, F.size(shared) - 1), F.lit(""))
