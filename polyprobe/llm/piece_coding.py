"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes single characters; an agenda holds every adjacent pair whose
joined spelling is a piece, best score first and leftmost among equal scores.
The top pair is joined, its new neighbours enter the agenda, and pairs whose
symbols have changed leave it.  Characters without a piece of their own become
byte pieces.

Where no piece holds two neighbouring characters, no join ever crosses the place
between them.  Which kinds of neighbours never meet in a piece is read off the
vocabulary when it is loaded: a letter before a space, and Latin letters beside
anything else.  A text is therefore cut there into units.  The units a Python
worker has not met yet go through their agendas together, one join per unit and
step, as vector operations; longer ones have a heap each.  Their ids are
remembered.  The library codes every Arrow batch as well; whether a row's ids
and decoded text equal the library's is a column of the result.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyprobe.llm.common import slices

SPACE = "▁"
#: Units remembered by a Python worker before it starts afresh.
CACHE_UNITS = 500_000
#: Characters from which on a unit has a heap of its own; such units are not remembered.
LONG_UNIT = 48
_SLICE = 1 << 21
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_IS_LATIN = re.compile(f"[{_LATIN}]")
#: Characters that normalisation forms, case folding and trimming would change.
_PROBE = "  ＡÄ Ä\t ﬁ  x "


class Agenda:
    """Joins of adjacent symbols in the order of a vocabulary's scores.

    A symbol is a piece's id, or minus the code point minus one for a
    character that is no piece.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.byte_ids = byte_ids
        # Place of each piece in the order of scores; equal scores share a place, and the leftmost pair wins.
        places = {score: k for k, score in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.last = len(places)
        self.single = np.full(0x110000, -1, np.int32)
        joins = {}
        for piece, (i, score) in pieces.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left and right:
                    joins[left[0] << 32 | right[0]] = (i, places[score])
        if any(self.single[ord(c)] < 0 for c in set("".join(pieces))):
            raise ValueError("a character of some piece is no piece itself")
        self.joins = joins
        order = sorted(joins)
        self.pairs = np.array(order, np.int64)
        self.joined, self.place = (np.array([joins[p][k] for p in order], np.int32) for k in (0, 1))

    def _symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        known = self.single[codes]
        return np.where(known >= 0, known, -1 - codes.astype(np.int64)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the table of joins, -1 where the pair makes no piece."""
        pair = left << 32 | right
        row = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[row] == pair) & (left >= 0) & (right >= 0), row, -1)

    def _spelled_out(self, symbols: list[int]) -> bytes:
        if symbols and min(symbols) < 0:
            symbols = [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-1 - s).encode()])]
        return struct.pack(f"={len(symbols)}i", *symbols)

    def encode(self, units: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each unit; a unit is not empty."""
        out: list[bytes] = [b""] * len(units)
        short = [k for k, unit in enumerate(units) if len(unit) < LONG_UNIT]
        for k, symbols in zip(short, self._stepped([units[k] for k in short])):
            out[k] = self._spelled_out(symbols)
        for k, unit in enumerate(units):
            if len(unit) >= LONG_UNIT:
                out[k] = self._spelled_out(self._queued(unit))
        return out

    def _stepped(self, units: list[str]) -> list[list[int]]:
        """All agendas at once: every step joins the top pair of every unit that still has one."""
        if not units:
            return []
        symbols = self._symbols("".join(units))
        sizes = np.array([len(u) for u in units])
        unit = np.repeat(np.arange(len(units)), sizes)
        # Row of the pair that starts at each symbol.
        row = np.full(len(symbols), -1, np.int64)
        row[:-1] = np.where(unit[1:] == unit[:-1], self._look_up(symbols[:-1], symbols[1:]), -1)
        done_units, done_symbols = [], []
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            order = np.where(row >= 0, self.place[row], self.last).astype(np.int64) << 32 | np.arange(len(row))
            top = np.minimum.reduceat(order, begins)
            alive = top >> 32 < self.last
            if not alive.all():
                size = np.diff(np.r_[begins, len(symbols)])
                stay = np.repeat(alive, size)
                done_units.append(unit[~stay])
                done_symbols.append(symbols[~stay])
                shift = np.cumsum(~stay)
                symbols, unit, row = symbols[stay], unit[stay], row[stay]
                at = (top & 0xFFFFFFFF)[alive]
                at -= shift[at]
            else:
                at = top & 0xFFFFFFFF
            if not len(at):
                break
            symbols[at] = self.joined[row[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol went from every unit before
            symbols, unit, row = symbols[keep], unit[keep], row[keep]
            after = np.minimum(at + 1, len(symbols) - 1)
            row[at] = np.where((after > at) & (unit[after] == unit[at]), self._look_up(symbols[at], symbols[after]), -1)
            left = at[(at > 0) & (unit[at - 1] == unit[at])]
            row[left - 1] = self._look_up(symbols[left - 1], symbols[left])
        unit, symbols = np.concatenate(done_units), np.concatenate(done_symbols)
        symbols = symbols[np.argsort(unit, kind="stable")].tolist()
        upto = np.cumsum(np.bincount(unit, minlength=len(units))).tolist()
        return [symbols[a:b] for a, b in zip([0, *upto], upto)]

    def _queued(self, text: str) -> list[int]:
        """The agenda of a long unit: a heap of pairs over linked symbols, n log n steps."""
        symbols = self._symbols(text).tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int]] = []
        gone = 1 << 31

        def pair(left: int) -> int:
            right = after[left]
            joinable = right < n and symbols[left] >= 0 and symbols[right] >= 0
            return symbols[left] << 32 | symbols[right] if joinable else -1

        def offer(left: int) -> None:
            p = pair(left)
            if p in self.joins:
                heapq.heappush(agenda, (self.joins[p][1], left, p))

        for left in range(n):
            offer(left)
        while agenda:
            _, left, p = heapq.heappop(agenda)
            # An entry is stale once either side has been joined elsewhere.
            if symbols[left] == gone or pair(left) != p:
                continue
            right = after[left]
            symbols[left], symbols[right] = self.joins[p][0], gone
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [s for s in symbols if s != gone]


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        spelled = [sp.id_to_piece(i) for i in every]
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        byte_ids = {int(spelled[i][3:5], 16): i for i in every if sp.is_byte(i)}
        if len(byte_ids) != 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("only vocabularies with byte pieces and without unused pieces are handled")
        if sp.normalize(_PROBE) != (SPACE + _PROBE).replace(" ", SPACE):
            raise ValueError("only models that add a space in front and change nothing else are handled")
        pieces = {spelled[i]: (i, sp.get_score(i)) for i in plain}
        bodies = [p.lstrip(SPACE) for p in pieces]
        if any(SPACE in body for body in bodies):
            raise ValueError("a piece runs from a letter into a space")
        mixed = any(bool(_IS_LATIN.match(a)) != bool(_IS_LATIN.match(b)) for body in bodies for a, b in zip(body, body[1:]))
        self.units = re.compile(" *[^ ]+| +" if mixed else f" *[{_LATIN}]+| *[^ {_LATIN}]+| +").findall
        self.agenda = Agenda(pieces, [byte_ids[b] for b in range(256)])
        # What each id stands for; control and unknown pieces are not produced here.
        spell = [b""] * len(every)
        for piece, (i, _) in pieces.items():
            spell[i] = piece.replace(SPACE, " ").encode()
        for b, i in byte_ids.items():
            spell[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(spell), np.uint8)
        self.sizes = np.array([len(s) for s in spell], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none for an empty text."""
        # The space symbol itself means a space to the model.
        cut = [self.units(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        coded = self.agenda.encode(new)
        known.update(zip(new, coded))
        out = [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in cut]
        for unit in new:
            if len(unit) >= LONG_UNIT:
                del known[unit]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids that ``encode`` gave: their spellings in order, without the space put in front."""
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(ids) else 0
        spelled = self.blob[np.repeat(self.starts[ids] - upto + sizes, sizes) + np.arange(total)].tobytes()
        return spelled[1:] if spelled[:1] == b" " else spelled


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
               check: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array<int>), decoded (string), agrees (boolean).

    ``agrees`` says whether the library gives the same ids for the row and the
    same text for these ids; it is null with ``check=False``.

    A null or empty text has no ids and decodes to the empty text.  Texts of
    any length are whole; one that exceeds a slice is a slice of its own.
    Rows with null or repeated ids are rows like any other, equal rows are kept
    apart, other columns are ignored whatever their names, an empty table gives
    an empty result.  Nothing is shuffled.  A run of letters without a space is
    one unit however long, in n log n steps.
    """
    names = ["doc_id", "ids", "decoded", "agrees"]

    def run(batches):
        own = coder(model_path)
        for batch in batches:
            for part in slices(batch.column(1), _SLICE):
                raw, bounds = part.data.tobytes(), part.offsets.tolist()
                texts = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]
                coded = own.encode(texts)
                decoded = [own.decode(ids) for ids in coded]
                agrees = [None] * len(texts)
                if check:
                    lib = own.library
                    theirs = lib.encode(texts, num_threads=1)
                    agrees = [a.tolist() == b and lib.decode(b).encode() == d
                              for a, b, d in zip(coded, theirs, decoded)]
                upto = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.last - part.first),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(flat)),
                    pa.array(decoded, pa.binary()).cast(pa.string()), pa.array(agrees, pa.bool_())], names=names)

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string, agrees boolean")
