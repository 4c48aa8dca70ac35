"""Double-array trie over vocabulary pieces, walked by all words of an Arrow batch in step."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Codes:
    """Code points of an Arrow string column, at most ``limit`` per row; null counts as empty."""

    def __init__(self, words: pa.Array, limit: int):
        words = pc.fill_null(words.cast(pa.large_string()), "")
        self.size = np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), limit).astype(np.int64)
        cut = pc.utf8_slice_codeunits(words, 0, limit) if limit else words
        text = "".join(cut.to_pylist()) if limit else ""
        self.flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.size)


class PieceTrie:
    """Node s goes over character code c to node base[s] + c if check of that node is s.

    ``value`` is the id of the piece that ends at a node, or -1.
    """

    def __init__(self, pieces: Iterable[str], ids: Iterable[int]):
        pairs = [(p, i) for p, i in zip(pieces, ids) if p]
        self.alphabet = np.unique(np.frombuffer("".join(p for p, _ in pairs).encode("utf-32-le"), np.uint32))
        self.depth = max((len(p) for p, _ in pairs), default=0)
        code = {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, i in pairs:
            node = 0
            for c in piece:
                step = code[c]
                if step not in children[node]:
                    children[node][step] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][step]
            if ends[node] >= 0:
                raise ValueError(f"piece {piece!r} has two ids")
            ends[node] = i
        self._lay_out(children, ends)

    def _lay_out(self, children: list[dict[int, int]], ends: list[int]) -> None:
        """Give every node a place such that siblings keep the distances of their codes."""
        room = 2 * len(children) + len(self.alphabet) + 2
        base, check, value = [0] * room, [-1] * room, [-1] * room
        check[0] = -2
        free, todo = 1, deque([(0, 0)])
        while todo:
            node, place = todo.popleft()
            steps = sorted(children[node])
            if not steps:
                continue
            while check[free] != -1:
                free += 1
            at = max(free - steps[0], 0)
            while True:
                if at + steps[-1] >= room:
                    more = room
                    base, check, value = base + [0] * more, check + [-1] * more, value + [-1] * more
                    room += more
                if all(check[at + s] == -1 for s in steps):
                    break
                at += 1
            base[place] = at
            for s in steps:
                check[at + s], value[at + s] = place, ends[children[node][s]]
                todo.append((children[node][s], at + s))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def coded(self, codes: Codes) -> np.ndarray:
        """Code of each character, 0 where no piece holds it."""
        if not len(self.alphabet):
            return np.zeros(len(codes.flat), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes.flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes.flat, at + 1, 0)

    def below(self, lead: str) -> int:
        """Node reached over ``lead``, or -1."""
        node = 0
        for c in lead:
            step = int(np.searchsorted(self.alphabet, ord(c)))
            if step >= len(self.alphabet) or self.alphabet[step] != ord(c):
                return -1
            node, parent = int(self.base[node]) + step + 1, node
            if node >= len(self.check) or self.check[node] != parent:
                return -1
        return node

    def walk(self, codes: Codes, coded: np.ndarray, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of every piece that is ``lead`` and a non-empty prefix of the row's word; one step per character."""
        rows_found, ids_found = [], []
        node = self.below(lead)
        rows = np.arange(len(codes)) if node >= 0 else np.zeros(0, np.int64)
        state = np.full(len(rows), max(node, 0), np.int64)
        for k in range(self.depth - len(lead)):
            more = codes.size[rows] > k
            rows, state = rows[more], state[more]
            if not len(rows):
                break
            step = coded[codes.start[rows] + k]
            ahead = np.minimum(self.base[state] + step, len(self.check) - 1)
            on = (step > 0) & (self.check[ahead] == state)
            rows, state = rows[on], ahead[on]
            ids = self.value[state]
            rows_found.append(rows[ids >= 0])
            ids_found.append(ids[ids >= 0])
        if not rows_found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_found), np.concatenate(ids_found).astype(np.int64)


class PrefixForest:
    """The distinct prefixes of a batch of words as numbered nodes, level by level.

    Every node is tokenised once.  ``link`` leads from a node to the nearest
    shorter prefix whose first token differs, so a word meets each of its
    first tokens in a few jumps, however many prefixes share it.
    """

    def __init__(self, words: list[str], codes: Codes):
        n = len(words)
        self.last = np.full(n, -1, np.int64)
        self.parent, self.names = [], []
        rows, node, made = np.arange(n), np.full(n, -1, np.int64), 0
        depth = 0
        while True:
            more = codes.size[rows] > depth
            rows, node = rows[more], node[more]
            if not len(rows):
                break
            key = (node + 1) << 21 | codes.flat[codes.start[rows] + depth].astype(np.int64)
            fresh, first, which = np.unique(key, return_index=True, return_inverse=True)
            self.parent.append((fresh >> 21) - 1)
            depth += 1
            self.names += [words[r][:depth] for r in rows[first].tolist()]
            node = made + which.ravel()
            made += len(fresh)
            self.last[rows] = node

    def first_tokens(self, ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of the first tokens of all prefixes, given those of ``names``; None counts as no token."""
        token = np.array([-1 if i is None else i for i in ids], np.int64)
        link = np.full(len(token), -1, np.int64)
        start = 0
        for parent in self.parent:
            own = slice(start, start + len(parent))
            start += len(parent)
            root = parent < 0
            same = ~root & (token[own] == token[parent])
            link[own] = np.where(root, -1, np.where(same, link[parent], parent))
        rows = np.flatnonzero(self.last >= 0)
        node = self.last[rows]
        rows_found, ids_found = [], []
        while len(rows):
            found = token[node] >= 0
            rows_found.append(rows[found])
            ids_found.append(token[node[found]])
            node = link[node]
            rows, node = rows[node >= 0], node[node >= 0]
        if not rows_found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows_found), np.concatenate(ids_found)


def sorted_sets(n: int, rows: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Distinct ids of each of ``n`` rows, ascending."""
    pairs = np.unique(rows.astype(np.int64) << 32 | ids.astype(np.int64))
    upto = np.searchsorted(pairs >> 32, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
