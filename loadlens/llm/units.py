"""Words cut into units that a white-space dropping, lower-casing BPE tokenizer treats independently of each other.

A unit never crosses white space. Inside a word it ends where an ASCII letter meets ASCII punctuation (either way, but
not after an apostrophe, which may begin a contraction). ASCII letters are lowered at once, so equal words in another
case are one unit. Words with ``<`` may hold a special string and are left whole. The ids of the units, end to end,
are the ids of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from loadlens.llm.arrays import LOWER, binary_array, raw, word_edges

#: Units remembered from one batch of a task to the next (a cache in two generations: it never changes an id).
MEMO_UNITS = 150_000
MEMO_UNIT_BYTES = 48

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_LETTER
_MARK[ord("0"):ord("9") + 1] = False


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units, n + 1 positions of the documents among them)."""
    data, off = raw(texts)
    space, first, end = word_edges(data, off)
    body = data[~space]
    del space
    word_at = np.concatenate([[0], np.cumsum(end - first)])
    cut = np.zeros(len(body) + 1, dtype=bool)
    letter, mark = _LETTER[body], _MARK[body]
    cut[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & (body[:-1] != ord("'")) & letter[1:])
    low = LOWER[body]
    special = np.flatnonzero(body == ord("<"))
    if len(special):
        whole = np.zeros(len(word_at) - 1, dtype=bool)
        whole[np.searchsorted(word_at, special, "right") - 1] = True
        inside = np.repeat(whole, end - first)
        cut[:-1][inside] = False
        low = np.where(inside, body, low)
    cut[word_at] = True
    if not len(body):
        return binary_array(body, np.zeros(1, np.int64)), np.zeros(len(off), np.int64)
    edges = np.flatnonzero(cut)
    return binary_array(low, edges), np.searchsorted(edges, word_at[np.searchsorted(first, off)])


class UnitEncoder:
    """Ids of units, remembering short ones. ``encode`` maps a list of unit texts to their lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Empty the cache, at the end of a task."""
        self.memo, self.older = {}, {}

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit as uint32 bytes."""
        if len(self.memo) > MEMO_UNITS:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        out: list = [memo.get(u) for u in units]
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                u = units[i]
                ids = older.get(u)
                if ids is None:
                    new.append(i)
                else:
                    out[i] = memo[u] = ids
        if new:
            found = self.encode([units[i].decode("utf-8", "replace") for i in new])
            flat = np.fromiter((t for ids in found for t in ids), np.uint32).tobytes()
            at = 0
            for i, ids in zip(new, found):
                end = at + 4 * len(ids)
                out[i] = flat[at:end]
                at = end
                if len(units[i]) <= MEMO_UNIT_BYTES:
                    memo[units[i]] = out[i]
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, n + 1 offsets of the texts among them)."""
        units, docs = split_units(texts)
        if not len(units):
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        coded = units.dictionary_encode()
        table = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary())
        data, off = raw(table.take(coded.indices))
        return data.view(np.uint32) if len(data) else np.zeros(0, np.uint32), off[docs] // 4
