"""Language-model scores by prediction by partial matching (PPM), with a word-frequency base score beside it.

The model is a trie of byte contexts up to ``ORDER`` bytes: for each context the counts of the bytes that followed it
in the training documents. A byte is predicted in the longest context; if it never followed there, an escape leads to
the next shorter context, in which the bytes already ruled out are excluded (symbol exclusion), down to a uniform
choice among the bytes left. Escapes are estimated by method D: of n occurrences with d distinct bytes, a byte seen c
times has (2 c - 1) / 2 n and the escape d / 2 n. The score of a text is the log10 probability of its bytes (A-Z in
lower case) and of its end, from the pretrained counts.

Nothing of the corpus goes to the driver or to all tasks. Documents are dealt to blocks of bounded size; each
block lists its distinct words and (ORDER + 1)-grams with their counts. Counts are summed over all blocks by key, the
trie's levels are tables derived from one another by grouping and joined suffix to suffix, and each block gets back
the values of its own keys alone. A word or gram is one row per block, whatever its frequency.

Edge cases: a null or empty text is its end alone. Rows without an id are held out. Without training documents every
byte is uniform and the base is that of unknown tokens. Repeated rows train and are scored one by one. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.arrays import LOWER, column, give_back, raw, word_array
from loadlens.llm.blocks import block_count, dealt, documents, packed
from loadlens.llm.tables import materialise

ORDER = 5
CODEC = "zstd"
CHUNK_BYTES = 1 << 20
#: Values packed together; a piece holds those of one block among them.
PACK_ROWS = 1 << 20
#: Bytes that UTF-8 never uses: before a text, and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256


def context_codes(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A code of each byte (and of each text's end) with the ``order`` bytes before it, the byte itself lowest; and the
    n + 1 positions of the texts among the codes."""
    n = len(off) - 1
    pad = order + 1
    doc = np.repeat(np.arange(n), np.diff(off))
    laid = np.full(len(data) + n * pad, BEFORE, np.uint8)
    laid[np.arange(len(data)) + doc * pad + order] = LOWER[data]
    laid[off[1:] + np.arange(n) * pad + order] = END
    code = laid.astype(np.uint64)
    for j in range(1, order + 1):
        code[j:] |= laid[:-j].astype(np.uint64) << np.uint64(8 * j)
    return code[laid != BEFORE].astype(np.int64), off + np.arange(n + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their counts summed."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    return zip(edges, edges[1:])


def block_words(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The distinct lower-case words of a block by first appearance, and per chunk of rows the number and the row of
    each word."""
    parts, numbers, rows = [], [], []
    for a, z in _chunks(texts):
        data, off = raw(texts.slice(a, z - a))
        words, doc = word_array(LOWER[data], off)
        coded = words.dictionary_encode()
        parts.append(coded.dictionary)
        numbers.append(coded.indices.to_numpy(zero_copy_only=False))
        rows.append((doc + a).astype(np.int32))
    whole = pa.concat_arrays(parts).dictionary_encode()
    index = whole.indices.to_numpy(zero_copy_only=False)
    at = 0
    for i, part in enumerate(parts):
        numbers[i] = index[at:at + len(part)][numbers[i]]
        at += len(part)
    return whole.dictionary, numbers, rows


FEATURES = "block int, slot long, word binary, n long"


def _features(pieces: pa.Table) -> pa.Table:
    """The distinct words (slot -1, -2, ...) and grams (slot = code) of a block with their counts in training rows."""
    docs = documents(pieces)
    texts, train = column(docs, "text"), ~column(docs, "held_out").to_numpy(zero_copy_only=False)
    words, numbers, rows = block_words(texts)
    n_word = np.zeros(len(words), np.int64)
    for number, row in zip(numbers, rows):
        n_word += np.bincount(number[train[row]], minlength=len(words))
    del numbers, rows
    parts = []
    for a, z in _chunks(texts):
        code, at = context_codes(*raw(texts.slice(a, z - a)))
        trains = np.repeat(train[a:z], np.diff(at))
        for some, counted in ((code[trains], True), (code[~trains], False)):
            some = np.sort(some)
            first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else some
            parts.append((some[first], np.diff(np.append(first, len(some))) if counted
                          else np.zeros(len(first), np.int64)))
    code, n_code = _merge(parts)
    total = len(n_word) + len(code)
    block = column(pieces, "block")[0].as_py()
    give_back()
    return pa.table({
        "block": pa.array(np.full(total, block, np.int32)),
        "slot": pa.array(np.concatenate([-1 - np.arange(len(n_word)), code])),
        "word": pa.concat_arrays([words.cast(pa.binary()), pa.nulls(len(code), pa.binary())]),
        "n": pa.array(np.concatenate([n_word, n_code]))})


def dealt_with_folds(docs: DataFrame) -> DataFrame:
    """doc_id, text, block and held_out: crc32(doc_id as text) mod 10 is 0, or there is no id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return dealt(docs, block_count(docs)).withColumn("held_out", F.coalesce(fold, F.lit(0)) == 0)


def block_features(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("block").applyInArrow(_features, FEATURES)


def gram_model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """code -> log10 probability of its byte in its context, for every (code, n) given (n may be 0).

    Level k holds the suffixes of k + 1 bytes with their counts, and the code length that an escape from their context
    costs (``lower``). A row's context has at most 256 rows, so no window partition grows with the data.
    """
    levels = [materialise(grams.select("code", "n"), "lm-level", CODEC)]
    for k in range(order - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("code").bitwiseAND(_mask(k)).alias("code")).agg(F.sum("n").alias("n"))
        levels.append(materialise(shorter, "lm-level", CODEC))
    levels.reverse()
    # level 0: one context, at most 256 rows
    level = _context(levels[0], F.lit(0).cast("long")) \
        .withColumn("lower", F.when(F.col("d") < SYMBOLS, -F.log10(F.lit(float(SYMBOLS)) - F.col("d"))).otherwise(0.0))
    for k in range(1, order + 1):
        below = level.select(F.col("code").alias("suffix"), F.col("n").alias("n0"), F.col("total").alias("total0"),
                             F.col("d").alias("d0"), F.col("lower").alias("lower0"))
        joined = levels[k].withColumn("suffix", F.col("code").bitwiseAND(_mask(k - 1))).join(below, "suffix")
        level = _context(joined, F.shiftright("code", 8)) \
            .withColumn("lower", _predict(F.col("n0"), F.col("total0") - F.col("excluded"), F.col("d0") - F.col("d"),
                                          F.col("lower0"))) \
            .select("code", "n", "total", "d", "lower")
    return level.select("code", _predict(F.col("n"), F.col("total"), F.col("d"), F.col("lower")).alias("logp"))


def _mask(k: int) -> Column:
    return F.lit((1 << 8 * (k + 1)) - 1).cast("long")


def _context(rows: DataFrame, context: Column) -> DataFrame:
    """total and d (distinct bytes) of each row's context; ``excluded``: the lower-level count of its seen bytes."""
    same = Window.partitionBy("context")
    out = rows.withColumn("context", context).withColumn("total", F.sum("n").over(same)) \
        .withColumn("d", F.sum((F.col("n") > 0).cast("long")).over(same))
    if "n0" in rows.columns:
        out = out.withColumn("excluded", F.sum(F.when(F.col("n") > 0, F.col("n0")).otherwise(0)).over(same))
    return out


def _predict(n: Column, total: Column, d: Column, lower: Column) -> Column:
    """Method D in a context of ``total`` occurrences of ``d`` bytes; an empty context escapes at no cost."""
    return F.when(total <= 0, lower).when(n > 0, F.log10((2.0 * n - 1) / (2.0 * total))) \
        .otherwise(F.log10(d / (2.0 * total)) + lower)


class Lookup:
    """Values of known keys by hashing: a key alone in its slot is settled there, the others at the next level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(4 * len(keys) - 1).bit_length())
            slot = self._slot(keys, bits, len(self.levels))
            alone = np.bincount(slot, minlength=1 << bits)[slot] == 1
            table = np.full(1 << bits, np.nan, np.float32)
            table[slot[alone]] = values[alone]
            self.levels.append((bits, table))
            keys, values = keys[~alone], values[~alone]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        k = keys.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15 + 2 * level * 0x5851F42D4C957F2D) & (1 << 64) - 1 | 1)
        return (k >> np.uint64(64 - bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = None, None
        for n, (bits, table) in enumerate(self.levels):
            found = table[self._slot(keys, bits, n)]
            if out is None:
                out = found
                open_ = np.flatnonzero(np.isnan(out))
            else:
                out[open_] = found
                open_ = open_[np.isnan(found)]
            if not len(open_):
                break
            keys = keys[np.isnan(found)]
        return out if out is not None else np.zeros(len(keys), np.float32)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of all numbers, lowest first: the planes of high bytes are almost empty and pack to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str, n: int) -> tuple[np.ndarray, bytes]:
    """The first ``n`` numbers of ``_planes`` and the bytes behind them."""
    size = np.dtype(kind).itemsize * n
    planes = np.frombuffer(data, np.uint8, size).reshape(np.dtype(kind).itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), data[size:]


def pack_values(slot: np.ndarray, value: np.ndarray) -> bytes:
    """Ascending slots as differences, word counts in double and gram values in single precision, by Zstandard."""
    n_word = int(np.searchsorted(slot, 0))
    sizes = np.array([n_word, len(slot) - n_word], "<i8")
    body = _planes(np.diff(slot, prepend=np.int64(0)).astype("<i8")) + _planes(value[:n_word].astype("<f8")) \
        + _planes(value[n_word:].astype("<f4"))
    return zstandard.compress(sizes.tobytes() + body)


def unpack_values(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """slot and value of ``pack_values``."""
    data = zstandard.decompress(piece)
    n_word, n_gram = np.frombuffer(data, "<i8", 2).tolist()
    slot, rest = _numbers(data[16:], "<i8", n_word + n_gram)
    words, rest = _numbers(rest, "<f8", n_word)
    return np.cumsum(slot), np.concatenate([words, _numbers(rest, "<f4", n_gram)[0]])


def packed_values(values: DataFrame) -> DataFrame:
    """block and piece: a block's values among ``PACK_ROWS`` rows of a task."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        block, slot, value = (column(rows, c).to_numpy() for c in ("block", "slot", "value"))
        order = np.lexsort((slot, block))
        block, slot, value = block[order], slot[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        pieces = [pack_values(slot[a:z], value[a:z]) for a, z in zip(first, np.append(first[1:], len(block)))]
        return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(pieces, pa.binary())],
                                          ["block", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK_ROWS:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)
        give_back()
    return values.select("block", "slot", "value").mapInArrow(run, "block int, piece binary")


SCORED = "doc_id long, held_out boolean, n_words long, n_known_words long, word_logs double, score double"


def _score(pieces: pa.Table, values: pa.Table) -> pa.Table:
    """Sums of each document from the values of its block's words and grams."""
    docs = documents(pieces)
    texts = column(docs, "text")
    parts = [unpack_values(p.as_py()) for p in column(values, "piece")]
    slot, value = (np.concatenate([p[i] for p in parts]) for i in range(2)) if parts else (np.zeros(0, np.int64), np.zeros(0))
    del parts
    is_word = slot < 0
    count = np.zeros(int(is_word.sum()))
    count[-1 - slot[is_word]] = value[is_word]
    _, numbers, rows = block_words(texts)
    n = len(texts)
    logs = np.log10(count + 0.1)
    n_words, n_known, word_logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for number, row in zip(numbers, rows):
        n_words += np.bincount(row, minlength=n)
        n_known += np.bincount(row[count[number] > 0], minlength=n)
        word_logs += np.bincount(row, logs[number], n)
    table = Lookup(slot[~is_word], value[~is_word])
    score = np.zeros(n)
    for a, z in _chunks(texts):
        code, at = context_codes(*raw(texts.slice(a, z - a)))
        if z > a:
            score[a:z] = np.add.reduceat(table[code], at[:-1], dtype=np.float64)
    give_back()
    return pa.table({"doc_id": column(docs, "doc_id"), "held_out": column(docs, "held_out"),
                     "n_words": pa.array(n_words), "n_known_words": pa.array(n_known), "word_logs": pa.array(word_logs),
                     "score": pa.array(score)})


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Trains on the documents whose crc32(doc_id as text) mod 10 is not 0 and scores all of them.
    """
    blocks = dealt_with_folds(docs)
    pieces = packed(blocks)
    features = materialise(block_features(pieces), "lm-features", CODEC)
    grams = features.where("slot >= 0")
    model = gram_model(grams.groupBy(F.col("slot").alias("code")).agg(F.sum("n").alias("n")), order)
    # blocks look values up in single precision; rounded here they pack better
    gram_values = grams.select("block", "slot").join(model.withColumnRenamed("code", "slot"), "slot") \
        .select("block", "slot", F.col("logp").cast("float").cast("double").alias("value"), F.lit(False).alias("known"))
    # a word is one row per block, so a window partition has at most as many rows as there are blocks
    word = Window.partitionBy("word")
    word_values = features.where("slot < 0").select(
        "block", "slot", F.sum("n").over(word).cast("double").alias("value"),
        (F.row_number().over(word.orderBy("block")) == 1).alias("first")) \
        .select("block", "slot", "value", (F.col("first") & (F.col("value") > 0)).alias("known"))
    values = materialise(gram_values.unionByName(word_values), "lm-values", CODEC)

    n_docs = blocks.where("not held_out").count()
    n_words = features.where("slot < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = values.where("known").count() + (n_docs > 0)
    total = n_words + n_docs
    scored = pieces.groupBy("block").cogroup(packed_values(values).groupBy("block")) \
        .applyInArrow(lambda left, right: _score(left, right), SCORED)
    unit = F.lit(float(np.log10(total + 0.1 * (kinds + 1))))
    n_tokens = F.col("n_words") + 1
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known_words") + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_logs") + F.lit(float(np.log10(n_docs + 0.1))) - n_tokens * unit).alias("base_score"), "score")
