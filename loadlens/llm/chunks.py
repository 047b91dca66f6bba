"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes decides where chunks end, so an insertion moves only the chunk edges near
it and equal passages fall into equal chunks again. Chunks are compared by a 128-bit digest; of equal chunks the one
that starts first (smallest doc_id, then earliest start) is the original and all others are repeats.

One chunking misses a repeated passage in which its edges fall into step too late to close a whole chunk. With
``tables`` above 1, each text is cut by so many independent gear tables and the distinct chunks are taken together.

Edge cases: a null or empty text has no chunks. Rows without an id count as one document that comes after all others;
rows that share an id count as one document. Documents shorter than the smallest chunk are one chunk. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import byte_batches, column, raw

WINDOW = 32
MIN_BYTES, MASK_BITS, MAX_BYTES = 32, 5, 256
LAST = (1 << 63) - 1
UNITED = 3


def gear_table(k: int) -> np.ndarray:
    """256 random 32-bit words, from a fixed seed."""
    return np.random.default_rng(20240229 + k).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table(0)


def gear_hash(data: np.ndarray, gear: np.ndarray = GEAR) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[byte i] mod 2^32, by doubling: the sum over a window of w bytes gives that over 2 w."""
    h = gear[data]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return h


def chunk_edges(data: np.ndarray, off: np.ndarray, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS,
                max_bytes: int = MAX_BYTES, gear: np.ndarray = GEAR) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every chunk of every text. A chunk ends after ``min_bytes`` (at least the hash window, so no
    hash spans two chunks) at the first byte whose hash has ``mask_bits`` zero top bits, or after ``max_bytes``."""
    if min_bytes < WINDOW:
        raise ValueError(f"min_bytes is less than the window of {WINDOW} bytes")
    marks = (np.flatnonzero(gear_hash(data, gear) >> np.uint32(32 - mask_bits) == 0) + 1).tolist() if len(data) else []
    starts, ends = [], []
    k, n = 0, len(marks)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
        while a < z:
            low = a + min_bytes
            while k < n and marks[k] < low:
                k += 1
            end = min(marks[k] if k < n else z, a + max_bytes, z)
            starts.append(a)
            ends.append(end)
            a = end
    return np.array(starts, np.int64), np.array(ends, np.int64)


def united_edges(data: np.ndarray, off: np.ndarray, tables: int, *sizes: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every distinct chunk by any of the first ``tables`` gear tables."""
    found = [chunk_edges(data, off, *sizes, gear=gear_table(k)) for k in range(tables)]
    if tables == 1:
        return found[0]
    first, end = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((end, first))
    first, end = first[order], end[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    return first[new], end[new]


#: ``place`` holds start (below 2^31, as any text's bytes) << 32, n_bytes << 1 and whether the same text has the chunk
#: earlier: one long instead of three columns in the shuffle.
CHUNK_SCHEMA = "doc_key long, place long, d1 long, d2 long"


def chunk_table(docs: DataFrame, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS,
                max_bytes: int = MAX_BYTES, tables: int = 1) -> DataFrame:
    """One row per chunk: its place, its digest (two longs) and whether the same text has it earlier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches):
            data, off = raw(column(b, "text"))
            first, end = united_edges(data, off, tables, min_bytes, mask_bits, max_bytes)
            if not len(first):
                continue
            doc = np.searchsorted(off, first, "right") - 1
            view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
            digest = np.frombuffer(b"".join([blake(view[a:z], digest_size=16).digest()
                                             for a, z in zip(first.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
            order = np.lexsort((first, digest[:, 1], digest[:, 0], doc))
            same = (doc[order][1:] == doc[order][:-1]) & (digest[order][1:] == digest[order][:-1]).all(axis=1)
            again = np.zeros(len(first), dtype=bool)
            again[order[1:]] = same
            key = column(b, "doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[doc]), pa.array((first - off[doc]) << 32 | (end - first) << 1 | again),
                 pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["doc_key", "place", "d1", "d2"])
    return docs.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def repeated_chunks(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, start, n_bytes and first_doc_id of every chunk that occurs earlier. The chunks of one text overlap where
    ``tables`` is more than 1.

    Two shuffles of fixed-width rows: a partial + final aggregate (a chunk that very many documents share is one row
    per task) and a join back whose hot digests the skew join splits.
    """
    table = chunk_table(docs, **sizes)
    again = F.col("place").bitwiseAND(1)
    first = table.groupBy("d1", "d2").agg(F.min("doc_key").alias("first_key"), F.max("doc_key").alias("last_key"),
                                          F.max(again).alias("inside")) \
        .where("first_key < last_key or inside = 1").select("d1", "d2", "first_key")
    key = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return table.join(first, ["d1", "d2"]).where((again == 1) | (F.col("doc_key") > F.col("first_key"))) \
        .select(key("doc_key").alias("doc_id"), F.shiftright("place", 32).alias("start"),
                F.shiftright("place", 1).bitwiseAND((1 << 31) - 1).alias("n_bytes"),
                key("first_key").alias("first_doc_id"))
