"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m bytes shares at least m - q + 1 - k q of the item's q-grams with it, on
diagonals that lie at most k apart. Documents are read once: their q-grams are looked up among the items' q-grams, the
hits are counted in overlapping bands of 2 (k + 1) diagonals, bands that reach the bound are verified by a banded
alignment of the item with the text around them.

Texts and items are compared in lower case (A-Z) with each run of white space as one space. k is ``edit_rate`` of the
item's length, less for items so short that the bound would fall below one shared q-gram. Items shorter than q must
occur exactly, as whole words.

Items are taken in blocks of about ``BLOCK_BYTES`` (by a hash of the item), each block one pass over the documents, so
what travels to the tasks is bounded however large the benchmark is.

Edge cases: null or empty texts hold nothing; null or blank items are skipped; items without an id are reported with
a null item_id; repeated rows are reported row by row; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import LOWER, SPACE, byte_batches, column, raw, tidy

Q = 12
EDIT_RATE = 0.05
BLOCK_BYTES = 4 << 20
TABLE_BITS = 22
BATCH_BYTES = 1 << 20
GAP = 0xFF  # between texts; no UTF-8 byte


def normal_form(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normal bytes with GAP before each text, position of each in ``data``, n + 1 text positions).

    Text i is normal[at[i]:at[i + 1] - 1]; normal[at[i] - 1] is the gap before it.
    """
    space = SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    keep[begins] = ~space[begins]  # no leading space, also after another text's end
    low = LOWER[data]
    low[space] = 0x20
    source = np.flatnonzero(keep)
    count = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
    n = len(off) - 1
    out = np.full(len(source) + n + 1, GAP, np.uint8)
    doc = np.searchsorted(off, source, "right") - 1
    place = np.arange(len(source)) + doc + 1
    out[place] = low[source]
    origin = np.full(len(out), -1, np.int64)
    origin[place] = source
    return out, origin, count + np.arange(n + 1) + 1


def gram_codes(b: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes from each position on."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = b[:-3].astype(np.uint32)
    for j in (1, 2, 3):
        w |= b[j:len(b) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    code = w[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in (4, 8):
        code ^= code >> np.uint64(29)
        code += w[j:n + j]
        code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def edit_budget(m: int, rate: float = EDIT_RATE) -> int:
    """The most edits for which an item of m bytes must still share a q-gram."""
    return max(0, min(int(rate * m), (m - Q) // Q))


@dataclass
class Index:
    """The q-grams of one block of items."""

    texts: list[np.ndarray]      # normal form
    ids: list[int | None]
    codes: np.ndarray            # sorted distinct codes
    first: np.ndarray            # n + 1 positions in the postings
    item: np.ndarray             # postings: item number and position of the gram in it
    pos: np.ndarray
    table: np.ndarray            # hash bits of the codes
    budget: np.ndarray
    short: list[int]

    @classmethod
    def build(cls, items: list[tuple[int | None, str]], rate: float) -> "Index":
        texts, ids = [], []
        for key, text in items:
            data, off = raw(pa.array([text], pa.string()))
            norm = normal_form(data, off)[0][1:-1]
            if len(norm) and norm[-1] == 0x20:
                norm = norm[:-1]
            if len(norm):
                texts.append(norm)
                ids.append(key)
        code, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            c = gram_codes(t)
            code.append(c)
            item.append(np.full(len(c), i))
            pos.append(np.arange(len(c)))
        code, item, pos = np.concatenate(code), np.concatenate(item), np.concatenate(pos)
        order = np.argsort(code, kind="stable")
        distinct, first = np.unique(code[order], return_index=True)
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[distinct >> np.uint64(64 - TABLE_BITS)] = True
        return cls(texts, ids, distinct, np.append(first, len(code)), item[order], pos[order], table,
                   np.array([edit_budget(len(t), rate) for t in texts], np.int64),
                   [i for i, t in enumerate(texts) if len(t) < Q])

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of every band whose shared q-grams reach the item's bound."""
        code = gram_codes(text)
        at = np.flatnonzero(self.table[code >> np.uint64(64 - TABLE_BITS)])
        slot = np.searchsorted(self.codes, code[at])
        known = slot < len(self.codes)
        known[known] = self.codes[slot[known]] == code[at[known]]
        at, slot = at[known], slot[known]
        many = self.first[slot + 1] - self.first[slot]
        total = int(many.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        posting = np.repeat(self.first[slot], many) + run
        item = self.item[posting]
        diagonal = np.repeat(at, many) - self.pos[posting] + max(map(len, self.texts))  # never negative
        half = self.budget[item] + 1
        band = diagonal // half
        stride = len(text) + 2 * max(map(len, self.texts)) + 2
        key = np.concatenate([item * stride + band, (item * stride + band - 1)[band > 0]])
        key, count = np.unique(key, return_counts=True)
        item, band = key // stride, key % stride
        size = np.array([len(t) for t in self.texts], np.int64)[item]
        need = np.maximum(size - Q + 1 - self.budget[item] * Q, 1)
        keep = count >= need
        return item[keep], band[keep] * (self.budget[item[keep]] + 1) - max(map(len, self.texts))

    def matches(self, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified passages of normal texts, the best of each overlapping group."""
        found = []
        for item, low in zip(*(x.tolist() for x in self.candidates(text))):
            k, pattern = int(self.budget[item]), self.texts[item]
            # the band's surroundings, within the one text that holds its middle
            row = int(np.searchsorted(at, min(max(low + k + 1 + len(pattern) // 2, 1), len(text) - 1), "right")) - 1
            begin = max(int(at[row]), low - k)
            end = min(int(at[row + 1]) - 1, low + 2 * (k + 1) + len(pattern) + k)
            hit = align(pattern, text[begin:end], k)
            if hit:
                found.append((item, begin + hit[0], begin + hit[1], hit[2]))
        whole = text.tobytes() if self.short else b""
        for item in self.short:
            word, at = self.texts[item].tobytes(), -1
            while (at := whole.find(word, at + 1)) >= 0:
                if whole[at - 1] in (0x20, GAP) and whole[at + len(word)] in (0x20, GAP):
                    found.append((item, at, at + len(word), 0))
        best: list[tuple[int, int, int, int]] = []
        for hit in sorted(found):
            if best and best[-1][0] == hit[0] and hit[1] < best[-1][2]:
                best[-1] = min(best[-1], hit, key=lambda x: (x[3], x[1]))
            else:
                best.append(hit)
        return best


def align(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the passage of ``text`` nearest to ``pattern`` if within k edits (the first of ties).

    Semi-global alignment within a band: cell d of row i is pattern position i against text position i + d - k. The
    text handed in is only the surroundings of a candidate, so the band has a few times k diagonals.
    """
    m, n = len(pattern), len(text)
    exact = text.tobytes().find(pattern.tobytes())
    if exact >= 0:
        return exact, exact + m, 0
    if not k or n < m - k:
        return None
    width = max(n - m, 0) + 2 * k + 1
    wide = np.full(m + width + 1, GAP, np.uint8)  # text with k gaps before it and gaps after it
    wide[k:k + min(n, m + width + 1 - k)] = text[:m + width + 1 - k]
    d = np.arange(width)
    far = 1 << 30
    cost = np.where((d >= k) & (d - k <= n), 0, far)
    origin = d - k
    for i, c in enumerate(pattern.tolist()):
        new, start = cost + (wide[i:i + width] != c), origin.copy()        # match or replace
        skip = np.append(cost[1:] + 1, far)                                # leave out a pattern byte
        better = skip < new
        new[better], start[better] = skip[better], np.append(origin[1:], 0)[better]
        lowest = np.minimum.accumulate(new - d)                            # take in text bytes
        source = np.maximum.accumulate(np.where(new - d == lowest, d, 0))
        cost, origin = lowest + d, start[source]
        if cost.min() > k:
            return None
    end = m + d - k
    cost = np.where((end >= 0) & (end <= n), cost, far)
    best = int(np.argmin(cost))
    return (int(origin[best]), int(end[best]), int(cost[best])) if cost[best] <= k else None


HIT_SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def find_passages(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, start and end (bytes of the original text) and edits of every benchmark passage found."""
    parts = [_pass(docs.select("doc_id", "text"), index) for index in blocks(benchmark, edit_rate)]
    if not parts:
        return docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def blocks(benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> Iterator[Index]:
    """The items in blocks of about BLOCK_BYTES, as indexes."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for i in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Index.build(sorted(((r[0], r[1]) for r in block.collect()),
                                 key=lambda x: (x[0] is None, x[0] or 0, x[1])), edit_rate)


def _scan(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) with positions in the original text."""
    data, off = raw(texts)
    normal, origin, at = normal_form(data, off)
    for item, start, end, edits in index.matches(normal, at):
        row = int(np.searchsorted(at, start, "right")) - 1
        yield row, item, int(origin[start] - off[row]), int(origin[end - 1] + 1 - off[row]), edits


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            rows = list(_scan(column(b, "text"), shared.value)) if shared.value.texts else []
            if rows:
                row, item, start, end, edits = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id").cast(pa.int64()).take(pa.array(row)),
                     pa.array([shared.value.ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()),
                     pa.array(end, pa.int64()), pa.array(edits, pa.int64())],
                    ["doc_id", "item_id", "start", "end", "edits"])
    return docs.mapInArrow(tidy(run), HIT_SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The documents without any benchmark passage, all columns unchanged; each row is judged on its own text."""
    for index in blocks(benchmark, edit_rate):
        docs = _clean(docs, index)
    return docs


def _clean(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            keep = np.ones(b.num_rows, dtype=bool)
            if shared.value.texts:
                keep[[r[0] for r in _scan(column(b, "text"), shared.value)]] = False
            yield b.filter(pa.array(keep))
    return docs.mapInArrow(tidy(run), docs.schema)
