"""Zstandard WARC archives: one compressed frame per record, written through Spark's file writer, read back validated.

An archive file begins with a skippable frame (magic 5D 2A 4D 18) that holds the dictionary its records were compressed
with. Records are separated by an empty skippable frame, which every Zstandard reader passes over. The files come from
Spark's text writer (the separator is its line separator), so its commit protocol and any shared file system apply: a
lost executor's part is written again.

The dictionary of a file is trained in its task on the first ``TRAIN_BYTES`` of its records: that bounded sample only
affects compression. Without enough material for training the file has no dictionary frame.

Edge cases: a null html is an empty payload; a null url omits the target; a null page_id is always a response with a
null id; rows that repeat the smallest id and payload are all responses; an empty table writes no record and reads
back empty.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: Zstandard and WARC formats
FRAME_MAGIC = 0xFD2FB528
SKIP_MAGIC = 0x184D2A50          # to ...5F
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

TRAIN_BYTES = 256 << 10
DICTIONARY_BYTES = 16 << 10
RECORD_DATE = "1970-01-01T00:00:00Z"  # the table has no crawl time


class WarcError(ValueError):
    """A record, frame or length that is not as the formats demand."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# ---------------------------------------------------------------- writing

def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of at least ``min_revisit_bytes`` the smallest page_id is
    the response that the others refer to.

    Only (page_id, digest) rows are grouped and joined; a payload shared by very many pages is one row per task after
    the partial aggregate, and its join partition is split by the skew join.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keyed = p.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit_bytes)) \
        .select("page_id", "digest")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")) \
        .where("refers_to < last").drop("last")
    revisits = keyed.join(first, "digest").where("page_id > refers_to").distinct()
    return p.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response or revisit record; a revisit has the HTTP header of the full payload but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            .encode("ascii"))
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
              ("WARC-Date", RECORD_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the sample is too small or uniform to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: Iterable[bytes], level: int = 3) -> Iterator[bytes]:
    """The parts of one archive file in order: the dictionary frame, then one frame per record."""
    records = iter(records)
    head, size = [], 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not head:
        return
    dictionary = train(head)
    if dictionary is not None:
        content = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for r in itertools.chain(head, records):
        yield press.compress(r)


def write_archives(planned: DataFrame, path: str) -> None:
    """Write one archive file per partition of ``plan_records`` output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, html, first in zip(*(b.column(c).to_pylist()
                                                    for c in ("page_id", "url", "html", "refers_to"))):
                    yield make_record(page, url, html.encode("utf-8"), first)
        held, size = [], 0
        for part in archive(records()):
            held.append(part)
            size += len(part)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
    # the cast keeps the bytes as they are
    planned.mapInArrow(run, "value binary").select(F.col("value").cast("string")) \
        .write.option("lineSep", SEPARATOR).text(path)


# ---------------------------------------------------------------- reading

def frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame that starts at ``at``, from its block headers."""
    try:
        head = zstandard.frame_header_size(data[at:at + 18])
        checksum = zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {at}: {e}") from None
    pos = at + head
    while True:
        if pos + 3 > len(data):
            raise WarcError(f"truncated frame at byte {at}")
        block = int.from_bytes(data[pos:pos + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise WarcError(f"reserved block type in the frame at byte {at}")
        pos += 3 + (1 if kind == 1 else size)
        if last:
            break
    pos += 4 if checksum else 0
    if pos > len(data):
        raise WarcError(f"truncated frame at byte {at}")
    return pos


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each record frame of an archive; the leading skippable frame gives the dictionary."""
    view, at, dictionary = memoryview(data), 0, None
    unpack = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise WarcError(f"{len(view) - at} stray bytes at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & ~0xF == SKIP_MAGIC:
            if at + 8 + size > len(view):
                raise WarcError(f"truncated skippable frame at byte {at}")
            if magic == DICTIONARY_MAGIC and at == 0:
                content = bytes(view[8:8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
                    content = zstandard.ZstdDecompressor().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
                unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            try:
                out = unpack.decompressobj().decompress(view[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at byte {at}: {e}") from None
            yield out
            at = end
        else:
            raise WarcError(f"no frame at byte {at}")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of the one record in a frame, with its lengths checked."""
    cut = record.find(b"\r\n\r\n")
    if cut < 0 or not record.startswith(VERSION + b"\r\n"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in record[len(VERSION) + 2:cut].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        if name.lower() in fields:
            raise WarcError(f"repeated field {name}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no field {name}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise WarcError("bad Content-Length")
    length = int(fields["content-length"])
    block = record[cut + 4:cut + 4 + length]
    if len(block) != length or record[cut + 4 + length:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the record")
    digest = fields.get("warc-block-digest")
    if digest is not None and digest != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest does not match")
    return fields, block


def parse_page(record: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """(page_id, url, payload, payload bytes, digest, record type, refers_to) of a record as written here."""
    fields, block = parse_record(record)
    kind = fields["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"\r\nContent-Length: ([0-9]+)$|\r\nContent-Length: ([0-9]+)\r\n", head)
    if found is None:
        raise WarcError("no length in the HTTP header")
    size = int(found[1] or found[2])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    first = None
    if kind == "response":
        if len(payload) != size:
            raise WarcError("HTTP length does not match the payload")
        if sha1_base32(payload) != digest:
            raise WarcError("payload digest does not match")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise WarcError("a revisit needs a reference and no payload")
        first = _page_of(fields["warc-refers-to"])
        payload = None
    else:
        raise WarcError(f"unknown record type {kind}")
    return _page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), payload, size, digest, kind, first


def _page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(none|-?[0-9]+)>", name)
    if found is None:
        raise WarcError(f"unknown record id {name[:80]!r}")
    return None if found[1] == "none" else int(found[1])


PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder. A file is read whole into its task, so file size (the writer's
    partition size) bounds the memory. Any fault raises ``WarcError`` with the file's name."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content")):
                rows: list[tuple] = []
                size = 0
                try:
                    for frame in frames(content.as_buffer()):
                        row = parse_page(frame)
                        rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        size += len(row[2] or b"") if payloads else 0
                        if size >= 4 << 20 or len(rows) >= 5000:
                            yield _pages(rows, kinds)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{name}: {e}") from None
                if rows:
                    yield _pages(rows, kinds)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content") \
        .mapInArrow(run, PAGE_SCHEMA)


def _pages(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], PAGE_SCHEMA.names)
