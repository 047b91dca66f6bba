"""Token counts, BPE codec and token files against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, SF001, texts

from loadlens.llm import bpe, queries, tokenfiles, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdefgh ABC'stve <|>endoftext!?.,-0 9éÀ́İßΣ中🙂𝒳  　\u0085\n\t\x0b\x1c\x00  "


def library(path, batch):
    return tokens.library_tokenizer(path).encode_batch(batch, add_special_tokens=False)


def check_batch(batch):
    ids, off = bpe.encode_column(pa.array(batch, pa.string()), WORD)
    text, at = bpe.codec(WORD).decode_notation(ids)
    files, file_off = tokenfiles._encoder(WORD).batch(pa.array(batch, pa.string()))
    for i, e in enumerate(library(WORD, batch)):
        assert ids[off[i]:off[i + 1]].tolist() == e.ids, batch[i]
        assert files[file_off[i]:file_off[i + 1]].tolist() == e.ids, batch[i]
        decoded = bytes(text[at[off[i]] + (off[i + 1] > off[i]):at[off[i + 1]]]).decode()
        assert decoded == tokens.library_tokenizer(WORD).decode(e.ids, skip_special_tokens=False)
    size, count = tokens.count_batch(pa.array(batch, pa.string()), BYTE)
    assert count.tolist() == [len(e) for e in library(BYTE, batch)]
    assert size.tolist() == [len(t.encode()) for t in batch]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=60), min_size=1, max_size=8))
def test_batches_equal_the_library(batch):
    check_batch(batch)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_any_unicode_equals_the_library(batch):
    check_batch(batch)


def test_every_character_of_the_basic_plane():
    check_batch([f"a{chr(c)}b {chr(c)}'s{chr(c)}  {chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000])


def test_long_texts_without_spaces():
    rng = random.Random(1)
    check_batch(["a" * 20000, "ab" * 9000, "".join(rng.choice("abcdehinorst") for _ in range(30000)), "!" * 5000,
                 "é" * 4000, "7" * 3000])


def test_memory_of_the_stream_is_bounded():
    codec = bpe.codec(WORD)
    rng = random.Random(2)
    word = "".join(rng.choice("abcdehinorst") for _ in range(50000))
    ids = list(codec.transducer.stream(word))
    assert ids == library(WORD, [word])[0].ids
    assert codec.transducer.most_held <= codec.transducer.flush + codec.merges.lookahead


def test_transducer_equals_merging_by_rank():
    """Small random merge lists against the definition: join the leftmost pair of the best rank until none is left."""
    rng = random.Random(3)
    for _ in range(200):
        known, merges = list("abc"), []
        for _ in range(rng.randint(0, 8)):
            a, b = rng.choice(known), rng.choice(known)
            if len(a + b) <= 6 and a + b not in known:
                merges.append((a, b))
                known.append(a + b)
        m = bpe.Merges({t: i for i, t in enumerate(known)}, merges)
        run = bpe.Transducer(m)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            parts = list(word)
            while True:
                found = [(m.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in m.rank]
                if not found:
                    break
                _, i = min(found)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert [known[t] for t in run.stream(word)] == parts, (merges, word)


def test_decoder_holds_back_incomplete_characters():
    codec = bpe.codec(WORD)
    ids = codec.encode("naïve café 中文 🙂")
    step = bpe.TextDecoder(codec)
    parts = [s for i in ids for s in step.feed([i])] + list(step.feed([], last=True))
    assert "".join(parts).split() == ["naïve", "café", "中文", "🙂"] and "�" not in "".join(parts)
    assert codec.decode_text(ids) == "naïve café 中文 🙂"


def test_sentencepiece_counts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    batch = ["Hello world", "", "a  b\n c", "é中🙂"]
    _, count = tokens.count_batch(pa.array(batch), path)
    assert count.tolist() == [len(x) for x in tokens.piece_tokenizer(path).encode(batch)]


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    df = texts(spark, ODD, extra)
    got = sorted(tokens.token_counts(df, BYTE).collect(), key=str)
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["n_bytes"] == 0 and not by[1]["over_limit"]
    coded = bpe.encode_decode_digests(df, WORD).collect()
    assert len(coded) == len(ODD) and {r["n_tokens"] for r in coded if r["doc_id"] in (1, 2, 3)} == {0}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["decoded_sha256"] for r in coded if r["doc_id"] in (1, 2, 3)} == {empty}
    assert tokens.token_counts(df.limit(0), BYTE).count() == 0 and bpe.encode_decode(df.limit(0), WORD).count() == 0


def test_codec_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_bpe_codec(spark, SF001).collect()}
    counts = {r["doc_id"]: r for r in queries.op2_token_counts(spark, SF001).collect()}
    assert set(got) == set(docs) == set(counts)
    for (i, t), e, c in zip(docs.items(), library(WORD, list(docs.values())), library(BYTE, list(docs.values()))):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        text = tokens.library_tokenizer(WORD).decode(e.ids, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"], counts[i]["over_limit"]) == \
            (len(c), len(t.encode()), len(c) > 1024)


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-2 ** 62, 2 ** 62, n))
    index = tokenfiles.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_shard_round_trip_and_unknown_keys():
    keys = np.array([tokenfiles.NO_KEY, -5, 3, 3, 900], np.int64)
    off = np.array([0, 1, 3, 3, 6, 7])
    ids = np.arange(7) * 9000
    shard = tokenfiles.Shard(tokenfiles.pack_shard(4, keys, ids, off, 2))
    assert shard.find(np.array([-5, 3, 900])).tolist() == [1, 2, 4]
    assert shard.ids_of(3).tolist() == [27000, 36000, 45000]
    missing = np.arange(10_000, 30_000)
    assert (shard.find(missing) >= 0).sum() < 5  # 32-bit fingerprints
    with pytest.raises(ValueError):
        tokenfiles.Shard(tokenfiles.pack_shard(4, keys, ids, off, 2)[:-1])


def test_token_files_on_the_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, SF001).collect()}
    start = 0
    for (i, _), e in zip(docs, library(WORD, [t for _, t in docs])):
        ids = np.array([*e.ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


@pytest.mark.parametrize("extra", [False, True])
def test_token_files_of_odd_rows_and_lookup(spark, tmp_path, extra):
    path = str(tmp_path / "shards")
    tokenfiles.write_shards(texts(spark, ODD, extra), WORD, path, end_id=1)
    rows = tokenfiles.read_documents(spark, path, payload=True).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["ids"] == by[2]["ids"] == by[3]["ids"] == [1]
    assert by[None]["start"] == 0  # null keys first
    keys = spark.createDataFrame([(1,), (4,), (7,), (99,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in tokenfiles.lookup(spark, path, keys).collect()}
    assert set(found) == {1, 4, 7} and found[7] == [*library(WORD, [ODD[-1][1]])[0].ids, 1]


def test_lookup_of_keys_over_several_files(spark, tmp_path):
    """A key that fills whole files has one row, its first; unknown keys inside and outside the ranges have none."""
    path = str(tmp_path / "shards")
    pairs = [(5, f"text number {i}") for i in range(400)] + [(10 * i, f"other {i}") for i in range(1, 31)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        tokenfiles.write_shards(texts(spark, pairs), WORD, path, end_id=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert tokenfiles.shard_files(spark, path).count() > 4
    keys = spark.createDataFrame([(k,) for k in (5, 5, 10, 300, -1, 7, 15, 299, 301, None)], "doc_id long")
    df = tokenfiles.lookup(spark, path, keys)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    found = df.collect()
    assert sorted(r["doc_id"] for r in found) == [5, 10, 300]
    first = min((r for r in tokenfiles.read_documents(spark, path, payload=True).collect() if r["doc_id"] == 5),
                key=lambda r: r["start"])
    assert {r["doc_id"]: r["ids"] for r in found}[5] == first["ids"]


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "shards")
    tokenfiles.write_shards(texts(spark, []), WORD, path, end_id=1)
    assert tokenfiles.read_documents(spark, path).count() == 0


def test_batches_of_the_codec_are_small():
    """A worker's arrays are many times its batch; six of them run beside a full heap in the pipeline."""
    assert bpe.BPE_BATCH_BYTES <= 1 << 20
