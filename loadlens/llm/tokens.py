"""Token counts with a public tokenizer, by batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at safe boundaries: before white space that follows a character which
is not white space. No token of the byte-level pattern crosses such a boundary and no special string holds white
space, so the counts of the pieces add up to the count of the whole text, whatever its length. Equal pieces of a batch
are encoded once; a text without such a boundary is one piece.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted one by one; an empty table
gives an empty result; null ids stay null.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadlens.llm.arrays import SPACE, binary_array, byte_batches, column, raw

TOKEN_BATCH_BYTES = 8 << 20
#: Pieces remembered from one batch of a task to the next (a cache: it never changes a count).
MEMO_PIECES = 300_000
MEMO_PIECE_BYTES = 48


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` JSON file, without truncation or padding, loaded once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def piece_tokenizer(path: str):
    """A sentencepiece model, loaded once in each worker."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def safe_cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Piece offsets (n + 1): document edges, and every white-space byte after a character that is none.

    A character of two or three bytes before the space is accepted only if its lead byte cannot start Unicode white
    space (C2, E1, E2, E3 can).
    """
    if not len(data):
        return off
    cut = np.zeros(len(data) + 1, dtype=bool)
    space = SPACE[data]
    cut[1:-1] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(cut[:-1] & np.concatenate([[False], data[:-1] >= 0x80]))
    lead2 = data[np.maximum(wide - 2, 0)]
    lead3 = data[np.maximum(wide - 3, 0)]
    cut[wide[(lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3))]] = False
    cut[off] = True
    return np.flatnonzero(cut)


class PieceCounter:
    """Token counts of byte strings, remembering short pieces."""

    def __init__(self, path: str):
        self.path = path
        self.memo: dict[bytes, int] = {}

    def forget(self) -> None:
        """Empty the cache, at the end of a task."""
        self.memo = {}

    def _encode(self, pieces: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in piece_tokenizer(self.path).encode(pieces, num_threads=1)]
        encoded = library_tokenizer(self.path).encode_batch_fast(pieces, add_special_tokens=False)
        return [len(x) for x in encoded]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        memo = self.memo
        out = np.fromiter((memo.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            found = self._encode([pieces[i].decode("utf-8", "replace") for i in new])
            out[new] = found
            if len(memo) + len(new) > MEMO_PIECES:
                memo.clear()
            for i, n in zip(new.tolist(), found):
                if len(pieces[i]) <= MEMO_PIECE_BYTES:
                    memo[pieces[i]] = n
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each whole text of a batch."""
    data, off = raw(texts)
    n = len(off) - 1
    # sentencepiece normalises white space across words, so its texts are never cut
    cuts = np.unique(off) if path.endswith(".model") else safe_cuts(data, off)
    coded = binary_array(data, cuts).dictionary_encode()
    if not len(coded):
        return np.diff(off), np.zeros(n, np.int64)
    each = counter(path).counts(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    total = np.concatenate([[0], np.cumsum(each)])
    at = np.searchsorted(cuts, off)
    return np.diff(off), total[at[1:]] - total[at[:-1]]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text has more than ``limit`` tokens; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=TOKEN_BATCH_BYTES):
            size, count = count_batch(column(b, "text"), tokenizer_path)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(size), pa.array(count),
                                              pa.array(count > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        counter(tokenizer_path).forget()
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
