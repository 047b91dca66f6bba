"""Documents dealt to blocks of bounded size, moved as compressed pieces.

An operator that goes over the texts several times groups these pieces by block. In one query Spark moves them once and
reuses the exchange. Work per block is bounded by the block size (a longer document is a block's worth by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import byte_batches, column, tidy

BLOCK_BYTES = 12 << 20
PACK_BYTES = 8 << 20


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks as the bytes of the table ask for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def dealt(docs: DataFrame, n: int, rest: bool = False) -> DataFrame:
    """doc_id, text and the block of each document, by a hash of both; with ``rest``, its other columns in a struct of
    that name (so that no name can clash)."""
    key = F.col("doc_id").cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if rest else []
    return docs.select(key.alias("doc_id"), "text", *([F.struct(*others).alias("rest")] if others else []),
                       F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int").alias("block"))


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(pieces: pa.Table, name: str = "piece") -> pa.Table | None:
    """The rows of all pieces; None without pieces."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in column(pieces, name)]
    return pa.concat_tables(parts) if parts else None


def packed(blocks: DataFrame) -> DataFrame:
    """block and piece: the rows of a batch that belong to one block, without the block column."""
    names = [c for c in blocks.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=PACK_BYTES):
            block = column(b, "block").to_numpy()
            order = np.argsort(block, kind="stable")
            rows, block = b.select(names).take(pa.array(order)), block[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            pieces = [pack(rows.slice(a, z - a)) for a, z in zip(first, np.append(first[1:], len(block)))]
            yield pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(pieces, pa.binary())],
                                             ["block", "piece"])
    return blocks.mapInArrow(tidy(run), "block int, piece binary")


def documents(pieces: pa.Table) -> pa.Table:
    """The documents of one block, in an order that does not depend on how they arrived."""
    return unpack(pieces).sort_by([("doc_id", "ascending"), ("text", "ascending")])
