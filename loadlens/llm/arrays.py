"""Byte-level helpers shared by the operators: Arrow text columns as numpy arrays, words, balanced batches.

Every function works on one Arrow batch inside a task, so memory is bounded by the batch (``byte_batches``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BATCH_BYTES = 4 << 20


def column(batch, name: str) -> pa.Array:
    """One column of a batch or table as a single Arrow array."""
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the n + 1 offsets; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
                             else "")
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes and offsets as an Arrow large_binary array."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                  pa.py_buffer(np.ascontiguousarray(data))])


def byte_batches(batches: Iterable[pa.RecordBatch], name: str = "text",
                 limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so that each holds about ``limit`` bytes of column ``name``; a longer text is alone in its batch.

    When the last one is done, the worker gives back what it no longer uses; what its caller still holds goes back with
    ``tidy``.
    """
    yield from _slices(batches, name, limit)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and the next stage runs beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow; at its end, with its last batch and arrays gone, the worker gives back their memory."""
    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return batch_by_batch


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    """``run`` for applyInArrow, as ``tidy``."""
    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out
    return group


def tidy_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]):
    """``run`` for applyInArrow on two frames, as ``tidy``."""
    def cogroup(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out
    return cogroup


def _slices(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1 and size[b - 1] > limit:  # a very long last text goes alone
                yield batch.slice(a, b - 1 - a)
                yield batch.slice(b - 1, 1)
            else:
                yield batch.slice(a, b - a)


def word_edges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(space mask, first byte, end byte) of every word; words never cross documents."""
    space = SPACE[data]
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = ~space[cut]
    end[cut - 1] = ~space[cut - 1]
    return space, np.flatnonzero(start), np.flatnonzero(end) + 1


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_edges``, with the document index of every word."""
    space, first, end = word_edges(data, off)
    return space, first, end, np.searchsorted(off, first, "right") - 1


def word_array(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts as one Arrow binary array, and the document index of each."""
    space, first, end, doc = word_spans(data, off)
    return binary_array(data[~space], np.concatenate([[0], np.cumsum(end - first)])), doc


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums of integer weights) by document index."""
    out = np.bincount(doc, weights, n)
    return out.astype(np.int64)


def mask_counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many True bytes each document has."""
    total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(np.int64)
