"""Archives: round trip against plain Python, and every kind of damage."""

import base64
import hashlib
import struct

import pytest
import zstandard
from llm_helpers import SF001

from loadlens.llm import queries, warc


def expected(pages, least=0):
    first = {}
    for i, html in sorted((i, h or "") for i, _, h in pages if i is not None):
        if len(html.encode()) >= least:
            first.setdefault(html, i)
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        lead = first.get(html or "", i) if i is not None else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if lead != i else "response", lead if lead != i else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in df.collect()), key=str)


def test_query_on_the_table(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    assert rows(queries.op1_warc_archive(spark, SF001)) == expected(pages)


ODD_PAGES = [(5, "http://a/é?x=1 2", "<p>\r\n\r\nWARC/1.1</p>"), (3, None, "<p>\r\n\r\nWARC/1.1</p>"), (9, "u", None),
             (8, "u", ""), (2, "u", "🙂" * 1000), (7, "u", "🙂" * 1000), (7, "u", "🙂" * 1000), (2, "u", "🙂" * 1000),
             (None, "u", "🙂" * 1000), (11, "line\r\nbreak", "P*M\x18\x00\x00\x00\x00\n"), (12, "", "x" * 300000)]


@pytest.mark.parametrize("least", [0, 10])
def test_odd_rows(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, 1, "v", "d") for r in ODD_PAGES],
                               "page_id long, url string, html string, digest int, value string, refers_to string")
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(df, least).repartition(2), path)
    back = warc.read_archives(spark, path)
    assert rows(back) == expected(ODD_PAGES, least)
    for r in back.collect():
        if r["record_type"] == "response" and r["page_id"] not in (2, None):
            assert bytes(r["payload"]).decode() in {h or "" for i, _, h in ODD_PAGES if i == r["page_id"]}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "warc")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df), path)
    assert warc.read_archives(spark, path).count() == 0


def archive_bytes(n=400):
    parts = list(warc.archive(warc.make_record(i, f"http://h/{i}", f"<html>{i} some text</html>".encode() * 20, None)
                              for i in range(n)))
    return parts, warc.SEPARATOR.encode().join(parts)


def test_dictionary_frame_leads_and_any_reader_can_read_it():
    parts, data = archive_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and len(parts) == 401
    assert len(list(warc.frames(data))) == 400
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    assert tool.decompress(parts[1]) == next(warc.frames(data))


def test_compressed_dictionary_and_plain_archives():
    parts, data = archive_bytes()
    packed = zstandard.ZstdCompressor().compress(parts[0][8:])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(parts[1:])
    assert list(warc.frames(again)) == list(warc.frames(data))
    small = b"".join(warc.archive([warc.make_record(1, None, b"x", None)]))  # too little to train on
    assert [warc.parse_page(f)[0] for f in warc.frames(small)] == [1]


def test_damage_is_refused():
    _, data = archive_bytes()
    for bad in (data[:-3], data[:len(data) // 2], data + b"xyz", data + b"\0" * 8, b"\0" * 20 + data):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 0xFF
    with pytest.raises(warc.WarcError):
        [warc.parse_page(f) for f in warc.frames(bytes(flipped))]


def test_wrong_headers_and_lengths_are_refused():
    good = warc.make_record(1, "http://a", b"payload", None)
    assert warc.parse_page(good)[2] == b"payload"
    length = good.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-4], good + b"x", good.replace(b"payload", b"payloae"),
                good.replace(b"Content-Length: " + length, b"Content-Length: 1" + length, 1),
                good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date", b"WARC-Dote"),
                good.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: response\r\n"),
                good.replace(b"WARC-Record-ID: <urn:page:1>", b"WARC-Record-ID: <urn:other:1>")):
        with pytest.raises(warc.WarcError):
            warc.parse_page(bad)
