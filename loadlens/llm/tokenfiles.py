"""Token-id files: raw little-endian ids with a minimal perfect hash index from document key to position.

A shard file holds the documents of one key range in ascending order. Its index is a minimal perfect hash built level
by level: at each level every remaining key hashes to a bit, keys alone on their bit are settled there, the rest go on.
The rank of a key's bit is its slot; the slot holds a 32-bit fingerprint of the key (so an unknown key is refused) and
the document's number, which leads to its span in the payload: constant time, no search, no stored key comparison.
Ids take 16 bits if the vocabulary fits, else 32.

Shards are written through Spark's file writer (one shard per row and file) and read with the binary-file source, so
lost tasks are repeated by Spark and any shared file system works.

Edge cases: a null or empty text has only the end id. Null keys come first and cannot be looked up. A repeated key
keeps all its rows (ordered by a hash of the text); a lookup finds the first of them. An empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.arrays import byte_batches, column
from loadlens.llm.blocks import block_count
from loadlens.llm.tokens import library_tokenizer
from loadlens.llm.units import UnitEncoder

MAGIC = b"TOKSHARD"
#: magic, shard number, ids, documents, bytes per id, hash levels, indexed keys; big-endian, so that SQL can read it
HEADER = struct.Struct(">8sQQQIIQ")
GAMMA = 1.5
BATCH_BYTES = 4 << 20
#: Text bytes of one key range.
SHARD_BYTES = 32 << 20
JOINED = 64
NO_KEY = np.iinfo(np.int64).min


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of integer keys."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct integer keys: a bit array per level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(b.sum()) for b in levels]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            size = max(8, -(-int(GAMMA * len(left)) // 8) * 8)
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level settles it (an unknown key may also get some slot)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            at = (mix(keys[open_], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[n] + self.ranks[n][at[hit]]
            open_ = open_[~hit]
        return out


def pack_shard(number: int, keys: np.ndarray, ids: np.ndarray, off: np.ndarray, width: int) -> bytes:
    """One shard file. ``keys`` in document order (NO_KEY for null), ``off`` the n + 1 positions of their ids."""
    distinct, first = np.unique(keys, return_index=True)
    real = distinct != NO_KEY
    distinct, first = distinct[real], first[real]
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    marks, docs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slot], docs[slot] = fingerprint(distinct), first
    head = HEADER.pack(MAGIC, number, len(ids), len(keys), width, len(index.levels), len(distinct))
    sizes = np.array([len(b) for b in index.levels], "<u8").tobytes()
    bits = b"".join(np.packbits(b).tobytes() for b in index.levels)
    return b"".join([head, sizes, bits, marks.tobytes(), docs.tobytes(), keys.astype("<i8").tobytes(),
                     off.astype("<u8").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file opened for keyed access."""

    def __init__(self, data):
        if len(data) < HEADER.size:
            raise ValueError("truncated shard")
        magic, self.number, self.n_ids, self.n_docs, self.width, levels, n = HEADER.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.at = HEADER.size
        self.data = data
        sizes = self._take("<u8", levels)
        self.index = PerfectHash([np.unpackbits(self._take(np.uint8, int(s) // 8)).astype(bool) for s in sizes])
        self.marks, self.docs = self._take("<u4", n), self._take("<u4", n)
        self.keys, self.off = self._take("<i8", self.n_docs), self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.ids = self._take(f"<u{self.width}", self.n_ids)
        if self.n_docs and self.off[-1] != self.n_ids:
            raise ValueError("shard positions do not match its payload")

    def _take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * int(n)
        if self.at + size > len(self.data):
            raise ValueError("truncated shard")
        out = np.frombuffer(self.data, kind, int(n), self.at)
        self.at += size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Document number of each key, -1 where its slot has another fingerprint."""
        if not len(self.marks):
            return np.full(len(keys), -1, np.int64)
        slot = self.index.slots(keys)
        known = (slot >= 0) & (self.marks[np.maximum(slot, 0)] == fingerprint(keys))
        return np.where(known, self.docs[np.maximum(slot, 0)].astype(np.int64), -1)

    def ids_of(self, doc: int) -> np.ndarray:
        return self.ids[self.off[doc]:self.off[doc + 1]]


class LibraryEncoder:
    """Ids of units from the library. Units that are one word of letters are encoded many at a time, with a space
    between; the tokens that carry the end-of-word suffix part them again."""

    def __init__(self, path: str):
        self.tok = library_tokenizer(path)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocab = self.tok.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def __call__(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        words, rest = [], []
        for i, u in enumerate(units):
            plain = self.ends is not None and u.isalpha() and u.lower().isalpha() and max(u) < "\u0300"
            (words if plain else rest).append(i)
        groups = [words[k:k + JOINED] for k in range(0, len(words), JOINED)]
        joined = self._encode([" ".join([units[i] for i in g]) for g in groups])
        for g, ids in zip(groups, joined):
            end = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(end) == len(g):
                for i, a, z in zip(g, [0, *end], end):
                    out[i] = ids[a:z]
            else:
                rest += g
        for i, ids in zip(rest, self._encode([units[i] for i in rest])):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> UnitEncoder:
    return UnitEncoder(LibraryEncoder(path))


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int) -> None:
    """Encode whole texts and write one shard per key range. A task holds its shard's ids, so there are as many ranges as
    the bytes of the texts ask for (``SHARD_BYTES`` each), and the session's shuffle partitions at least."""
    tok = library_tokenizer(tokenizer_path)
    width = 2 if max(tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    parts = max(block_count(docs, SHARD_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")) \
        .sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, counts = [], [], []
        for b in byte_batches(batches, limit=BATCH_BYTES):
            key = column(b, "doc_id").cast(pa.int64()).fill_null(int(NO_KEY)).to_numpy()
            found, off = _encoder(tokenizer_path).batch(column(b, "text"))
            out = np.full(len(found) + len(key), end_id, f"<u{width}")
            keep = np.ones(len(out), dtype=bool)
            keep[off[1:] + np.arange(len(key))] = False  # the end id after each document
            out[keep] = found
            keys.append(key)
            ids.append(out)
            counts.append(np.diff(off) + 1)
        _encoder(tokenizer_path).forget()
        if keys:
            off = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            blob = pack_shard(TaskContext.get().partitionId(), np.concatenate(keys), np.concatenate(ids), off, width)
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.large_binary())], ["value"])
    # the cast keeps the bytes as they are; the line feed after the blob is outside the lengths of the header
    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1") \
        .select("content")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids of all shards before it, from the headers alone. One row per file, so the running sum's
    single task handles as many rows as there are files (at most the number of shuffle partitions)."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 8)), 16, 10).cast("long")
    totals = shard_files(spark, path).select(number(9).alias("shard"), number(17).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """doc_id, start (ids before it over all shards), n_tokens, ids_crc32 and, if asked, the ids themselves.

    Every key is looked up through its shard's index; a key that its index does not lead back to raises.
    """
    schema = "shard long, doc_id long, local long, n_tokens long, ids_crc32 long, ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                shard = Shard(content.as_buffer())
                n = shard.n_docs
                real = shard.keys != NO_KEY
                doc = np.arange(n)
                found = shard.find(shard.keys)
                if (real & ((found < 0) | (shard.keys[np.maximum(found, 0)] != shard.keys))).any():
                    raise ValueError(f"shard {shard.number}: the index misses a key")
                spans = [shard.ids_of(i).astype("<u4") for i in doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard.number), pa.int64()), pa.array(shard.keys, pa.int64(), mask=~real),
                     pa.array(shard.off[:-1]), pa.array(np.diff(shard.off)),
                     pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                     pa.array([x.tolist() if payload else None for x in spans], pa.list_(pa.int64()))],
                    ["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])
    rows = shard_files(spark, path).mapInArrow(run, schema)
    # one row per file: bounded by the number of shuffle partitions of the writing job
    out = rows.join(F.broadcast(shard_starts(spark, path)), "shard") \
        .select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if payload else out.drop("ids")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids of each distinct key that the files hold, one row a key: of repeated keys the first row.

    The files are ranges in key order, so a key can only begin in the first file whose last key is not smaller. That
    file is found by binary search over the files' bounds (16 bytes a file, the only thing that is sent to all tasks);
    keys then meet their file by its number, so no file sees all keys. Keys without a file have no row.
    """
    bounds = shard_files(spark, path).mapInArrow(_bounds, "shard long, low long, high long").toPandas() \
        .sort_values("shard")  # one row per file
    sent = spark.sparkContext.broadcast(tuple(bounds[c].to_numpy(np.int64) for c in ("shard", "low", "high")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, low, high = sent.value
        for b in batches:
            key = column(b, "key").to_numpy()
            at = np.searchsorted(high, key, "left")
            inside = at < len(high)
            inside[inside] = low[at[inside]] <= key[inside]
            yield pa.RecordBatch.from_arrays([pa.array(key[inside]), pa.array(shard[at[inside]])], ["key", "shard"])
    routed = keys.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct() \
        .mapInArrow(route, "key long, shard long")
    wanted = routed.groupBy("shard").agg(F.collect_list("key").alias("wanted"))  # at most a shard's keys each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, want in zip(b.column("content"), b.column("wanted")):
                shard = Shard(content.as_buffer())
                want = np.array(want.as_py(), np.int64)
                found = shard.find(want)
                ok = (found >= 0) & (shard.keys[np.maximum(found, 0)] == want)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(want[ok]), pa.array([shard.ids_of(i).astype(np.int64).tolist() for i in found[ok]],
                                                  pa.list_(pa.int64()))], ["doc_id", "ids"])
    files = shard_files(spark, path).withColumn(
        "shard", F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long"))
    return files.join(wanted, "shard").select("content", "wanted").mapInArrow(run, "doc_id long, ids array<long>")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            shard = Shard(content.as_buffer())
            real = shard.keys[shard.keys != NO_KEY]
            if len(real):
                yield pa.RecordBatch.from_arrays([pa.array([shard.number]), pa.array([int(real[0])]),
                                                  pa.array([int(real[-1])])], ["shard", "low", "high"])
