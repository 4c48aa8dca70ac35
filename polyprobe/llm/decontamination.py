"""Benchmark decontamination on templates: the same question counts as leaked even with other numbers and names.

Words become canonical: case and outer punctuation go, and numbers, names
(capitalised words inside a sentence) and units become typed placeholders.
Windows of the benchmark's templates are hash-joined with those of the
documents; a hit carries the words that filled the placeholders.  Along one
alignment of a document with an item each filler of the item must map to one
filler of the document, so a re-parameterised question passes and a chance
meeting of placeholders does not.  Windows with a filler that maps to several
are dropped; where many fillers do, only windows filled alike are kept.  Windows
without placeholders always count.  Shorter windows of the words themselves, placeholders
or not, are joined beside them: they find what lies between two edits, and
items that are all names and numbers.  A word of an item is covered if any
window with it is hit, and an item is found if enough of its words are, or a
long run of them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import Hashes, Slice, Words, batch_of, mixed, signed, slices, stored, words

WINDOW = 8
#: A window needs this many words that are no placeholders.
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
#: Changed fillers of an alignment are believed if at most this share of them maps to several fillers.
MAX_CONFLICTS = 0.1
#: Words of a window that must be met as they are (but for case and outer punctuation).
VERBATIM = 5
#: An item is also found by a run of so many words met as they are, however long the item is.
LONG_RUN = 13
#: Shorter windows count together if edits have shifted them by up to this many words against each other.
DRIFT = 16
#: Benchmark windows up to which their hashes travel to the scan as a filter; beyond, all windows are shuffled.
FILTER_LIMIT = 4_000_000

# Unit words.
UNITS = ("mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb "
         "lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min "
         "minute minutes h hr hour hours day days week weeks month months year years percent % dollar dollars cent "
         "cents euro euros usd eur mph kmh degrees celsius fahrenheit watt watts volt volts joule joules").split()
_NUMBER, _NAME, _UNIT = (mixed(np.array([k], np.uint64))[0] for k in (11, 12, 13))
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "%$<>"]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals as small letters."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[second] += 32
    return out


class Template(NamedTuple):
    """Canonical words of a slice: hash, whether a placeholder, hash of the plain word, and the first word per row."""

    hash: np.ndarray
    slot: np.ndarray
    plain: np.ndarray
    first: np.ndarray


def template(part: Slice) -> Template:
    found: Words = words(part)
    data, start, end = part.data, found.start.copy(), found.end.copy()
    if not len(start):
        return Template(found.hash, np.zeros(0, bool), found.hash, found.first)
    for _ in range(4):
        trim = (end - start > 1) & _PUNCTUATION[data[end - 1]]
        end[trim] -= 1
        trim = (end - start > 1) & _PUNCTUATION[data[start]]
        start[trim] += 1
    plain = Hashes.of(_folded(data)).spans(start, end)
    opens = np.ones(len(start), bool)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    opens[1:] = _STOP[data[found.end[:-1] - 1]] | (newline[found.start[1:]] > newline[found.end[:-1]])
    opens[found.first[:-1][np.diff(found.first) > 0]] = True
    head, after = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] > digits[start]
    unit = np.isin(plain, _UNIT_HASHES)
    hashes = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital & ~opens, _NAME, plain)))
    return Template(hashes, number | unit | (capital & ~opens), plain, found.first)


def _unit_hashes() -> np.ndarray:
    part = next(slices(pa.array([" ".join(UNITS)])))
    found = words(part)
    return Hashes.of(part.data).spans(found.start, found.end)


_UNIT_HASHES = _unit_hashes()


def template_windows(rows: DataFrame, id_col: str, text_col: str, sizes: list[int],
                     known: np.ndarray | None = None, whole: bool = False, plain: bool = False) -> DataFrame:
    """Windows of each text: id, size, hash, at (first word) and slots (plain hashes of placeholder words).

    With ``known`` only windows of those hashes.  With ``whole`` a text has
    windows of the largest size, or is one window if it is shorter.  With
    ``plain`` windows are of the words themselves: they have no slots, any
    words will do, and their hashes differ from those of templates.
    """
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
                        ("slots", pa.list_(pa.int64()))])
    shipped = rows.sparkSession.sparkContext.broadcast(None if known is None else np.sort(known))

    def run(batches):
        wanted = shipped.value
        for batch in batches:
            for part in slices(batch.column(1)):
                got = template(part)
                length = np.diff(got.first)
                slot = np.zeros(len(got.slot), bool) if plain else got.slot
                hashes = mixed(got.plain + np.uint64(1)) if plain else got.hash
                literal = np.concatenate([[0], np.cumsum(~slot)])
                for size in sizes:
                    n = len(got.hash) - size + 1
                    if n <= 0:
                        continue
                    total = np.full(n, size, np.uint64)
                    for k in range(size):
                        total = mixed(total + hashes[k: n + k])
                    at = np.arange(n)
                    row = np.searchsorted(got.first, at, "right") - 1
                    ok = at + size <= got.first[row + 1]
                    ok &= literal[at + size] - literal[at] >= min(MIN_LITERALS, size)
                    if whole and size < max(sizes):
                        ok &= length[row] == size
                    if wanted is not None:
                        ok[ok] = np.isin(total[ok], wanted)
                    at, row, total = at[ok], row[ok], total[ok]
                    slots = [signed(got.plain[a: a + size][slot[a: a + size]]) for a in at.tolist()]
                    yield batch_of(schema, id=batch.column(0).take(pa.array(part.first + row)), hash=signed(total),
                                   at=at - got.first[row], size=np.full(len(at), size), slots=slots)

    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id bigint, hash bigint, at bigint, size bigint, slots array<bigint>")


def _both(parts) -> DataFrame:
    first, second = parts
    return first.unionByName(second)


def _lengths(batches):
    """Words of each text."""
    schema = pa.schema([("item_id", pa.int64()), ("of", pa.int64())])
    for batch in batches:
        of = [np.diff(words(part).first) for part in slices(batch.column(1))]
        yield batch_of(schema, item_id=batch.column(0), of=np.concatenate([np.zeros(0, np.int64), *of]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
          min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and an item it contains, with n_windows, coverage and exact.

    ``n_windows`` counts the item's places at which a window is found in
    consistent alignments, ``coverage`` is the share of the item's words in such windows,
    ``exact`` says that all placeholders in the alignments are filled alike.  A pair counts
    if ``min_coverage`` of the words are covered, or ``LONG_RUN`` words in a
    row are met as they are.  Items shorter than a window are looked for as a whole; items without
    words (null and empty ones too) have no windows and are never found.  Null
    and empty documents contain nothing; rows with a null id are left out;
    repeated rows count once; other columns are ignored; an empty table on
    either side gives an empty result.
    """
    named = benchmark.where(F.col(item_col).isNotNull())
    kinds = ((window, False), (min(VERBATIM, window), True))
    items = stored(_both(template_windows(named, item_col, item_text_col, list(range(1, size + 1)), whole=True, plain=plain)
                         .withColumn("plain", F.lit(plain)) for size, plain in kinds).distinct(), "items")
    # Sizes below the window exist only for short items.
    used = {plain: [size] for size, plain in kinds}
    for r in items.groupBy("plain").agg(F.sort_array(F.collect_set("size")).alias("sizes")).collect():
        used[r["plain"]] = r["sizes"]
    n = items.select("hash").distinct().count()
    known = None
    if n <= FILTER_LIMIT:
        known = np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)
    own = docs.where(F.col(id_col).isNotNull())
    hits = _both(template_windows(own, id_col, text_col, used[plain], known, plain=plain) for _, plain in kinds)
    pairs = hits.join(items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", "size",
                                   F.col("slots").alias("item_slots")), ["hash", "size"])
    pairs = pairs.where(F.size("slots") == F.size("item_slots")) \
        .withColumn("fill", F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d"))))
    # One alignment holds at most the windows of one item.
    lines = pairs.groupBy(F.col("id").alias("doc_id"), "item_id", (F.col("at") - F.col("item_at")).alias("shift")) \
        .agg(F.collect_set(F.struct("item_at", "size", "fill")).alias("found"),
             F.array_distinct(F.flatten(F.collect_set("fill"))).alias("fill"))
    values = F.map_from_entries(F.transform(
        F.array_distinct(F.transform("fill", lambda p: p["i"])),
        lambda i: F.struct(i, F.transform(F.filter("fill", lambda p: p["i"] == i), lambda p: p["d"]))))
    lines = lines.withColumn("values", values) \
        .withColumn("clash", F.map_keys(F.map_filter("values", lambda i, ds: F.size(ds) > 1))) \
        .withColumn("changed", F.size(F.map_keys(F.map_filter("values", lambda i, ds: F.exists(ds, lambda d: d != i))))) \
        .withColumn("believed", F.size("clash") <= MAX_CONFLICTS * F.col("changed"))
    lines = lines.withColumn("found", F.filter("found", lambda w: F.forall(w["fill"], lambda p: p["i"] == p["d"]) | (
        F.col("believed") & F.forall(w["fill"], lambda p: ~F.array_contains(F.col("clash"), p["i"]))))) \
        .withColumn("exact", F.forall("fill", lambda p: p["i"] == p["d"]))
    total = named.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text")) \
        .mapInArrow(_lengths, "item_id bigint, of bigint").groupBy("item_id").agg(F.max("of").alias("of"))
    def covered(found):
        return F.array_sort(F.array_distinct(F.flatten(F.transform(
            found, lambda w: F.sequence(w["item_at"], w["item_at"] + w["size"] - 1)))))

    as_is = covered(F.filter("found", lambda w: (F.size(w["fill"]) == 0) & (w["size"] <= VERBATIM)))
    run = F.exists(F.sequence(F.lit(1), F.size("as_is") - LONG_RUN + 1),
                   lambda k: F.element_at("as_is", k + LONG_RUN - 1) - F.element_at("as_is", k) == LONG_RUN - 1)
    lines = lines.where(F.size("found") > 0).withColumn("as_is", as_is) \
        .withColumn("run", F.when(F.size("as_is") >= LONG_RUN, run).otherwise(False))
    # Template windows count together wherever they lie, all windows count together in overlapping bands of shifts.
    bands = [F.struct(F.lit(k).alias("kind"), F.floor((F.col("shift") + k * DRIFT) / (2 * DRIFT)).alias("band"))
             for k in (0, 1)]
    far = F.struct(F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("band"))
    lines = lines.withColumn("band", F.explode(F.array(*bands, far))).withColumn(
        "found", F.filter("found", lambda w: (F.col("band")["kind"] < 2) | (w["size"] > VERBATIM)))
    ats = F.array_distinct(F.flatten(F.collect_set(F.transform("found", lambda w: w["item_at"]))))
    found = lines.withColumn("words", covered("found")).groupBy("doc_id", "item_id", "band").agg(
        F.size(ats).cast("bigint").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("covered"),
        F.min("exact").alias("exact"), F.max("run").alias("run")).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("covered").alias("covered"), F.min("exact").alias("exact"),
        F.max("run").alias("run"))
    return found.join(total, "item_id").withColumn("coverage", F.col("covered") / F.col("of")) \
        .where((F.col("coverage") >= min_coverage) | F.col("run")) \
        .select("doc_id", "item_id", "n_windows", "coverage", "exact")
