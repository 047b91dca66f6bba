"""Near duplicates, substring and chunk deduplication against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, SF001, texts

from loadlens.llm import arrays, chunks, graph, minhash, queries, suffix
from loadlens.llm.arrays import binary_array
from loadlens.llm.blocks import pack

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- near duplicates

def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else \
        frozenset([tuple(w)] if w else [])


def brute_components(pairs, width, percent):
    root = {i: i for i, _ in pairs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(i, shingles(t, width)) for i, t in pairs]
    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if i is not None and j is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def near(df, width, percent):
    got = minhash.near_duplicates(df, width, percent).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got), key=str)


def family(rng, size, copies, edits):
    """Copies of a text, each with some words replaced."""
    base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"x{rng.randint(0, 10 ** 9)}"
        yield " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_families_around_the_threshold(spark, monkeypatch, width, percent):
    monkeypatch.setattr(minhash, "STAR", 5)     # star groups and blocks are split
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(width)
    rows = [t for k in range(6) for t in family(rng, 60 + 20 * k, 14, 5)]
    rows += [rows[3]] * 10 + [rows[4].upper()] * 3
    rng.shuffle(rows)
    pairs = [*enumerate(rows, 100), *ODD]
    assert near(texts(spark, pairs, extra=True), width, percent) == brute_components(pairs, width, percent)


def test_near_query_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.op5_minhash_dedup(spark, SF001).collect()
    want = brute_components(docs, 3, 85)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got), key=str) == want


def test_keep_first_keeps_columns_and_one_of_each_group(spark):
    pairs = [(9, "a b c d e f g h"), (4, "a b c d e f g h"), (7, "other words that stand alone here"), (None, "a b c d e f g h")]
    df = texts(spark, pairs, extra=True)
    out = minhash.keep_first(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["4", "7", "None"]
    assert minhash.keep_first(df.limit(0)).count() == 0 and minhash.near_duplicates(df.limit(0)).count() == 0


def test_missed_pairs_at_the_threshold_are_rare():
    for t in (0.8, 0.85):
        m = minhash.half_keys_needed(t)
        assert 2 * (1 - t ** minhash.HALF) ** m <= minhash.MISS
    # and the half keys do agree as often as the similarity says
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(40):
        common = rng.integers(0, 2 ** 63, 850).astype(np.uint64)
        a, b = (np.sort(np.concatenate([common, rng.integers(0, 2 ** 63, 75).astype(np.uint64)])) for _ in range(2))
        keys = minhash.half_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 20)
        agree.append((keys[0] == keys[1]).mean())
    assert np.mean(agree) == pytest.approx(0.85 ** 4, abs=0.04)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 500 for i in range(501, 560)}}
    assert graph.components(df.limit(0)).count() == 0


# ---------------------------------------------------------------- suffix arrays

def brute_repeats(pairs, order=None):
    """Per text: bytes, removed bytes, spans, digest; texts in the given order."""
    seen, out = set(), []
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - suffix.LENGTH + 1):
            w = b[p:p + suffix.LENGTH]
            if w in seen:
                gone[p:p + suffix.LENGTH] = b"\1" * suffix.LENGTH
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(df):
    return sorted(tuple(r) for r in suffix.repeated_digests(df).collect())


@pytest.mark.parametrize(("blocks", "run"), [(1, 3 << 19), (3, 3 << 19), (4, 600)])
def test_repeats_of_made_texts(spark, monkeypatch, blocks, run):
    monkeypatch.setattr(suffix, "block_count", lambda df, size: blocks)
    monkeypatch.setattr(suffix, "RUN_BYTES", run)
    rng = random.Random(blocks)
    base = ["".join(rng.choice("abc ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 200):][:rng.randint(20, 300)] + rng.choice(["", "x", "é"])
                 for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    edited = list(base[0] * 3)
    for k in range(40, len(edited), 130):  # copies that differ in single bytes, at most 129 apart
        edited[k] = "#"
    rows += [(90, base[0] * 3), (91, "".join(edited)), (92, "x" + "".join(edited)[:700])]
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, "a" * 99), (103, "a" * 100), (104, ""), (105, "abcdefg" * 60),
             (106, None), (107, "0123456789" * 30 + "q" + "0123456789" * 30), (108, "\x00" * 250),
             (109, "\x00" * 120 + "é" * 100)]
    assert repeats(texts(spark, rows, extra=True)) == sorted(brute_repeats(rows))


def test_a_passage_in_many_contexts_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix, "block_count", lambda df, size: 3)
    monkeypatch.setattr(suffix, "RUN_BYTES", 20_000)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(371), [word(60) for _ in range(5)]
    rows = [(i, word(150) + passage + rng.choice(tails) * (i % 2) + word(150)) for i in range(500)]
    df = texts(spark, rows)
    pieces = suffix.packed(suffix.dealt(df, 3))
    found = collections.Counter()
    anchors = pieces.groupBy("block").applyInArrow(suffix._anchor_counts, "block int, anchor long, n long")
    for r in anchors.collect():
        found[r["anchor"]] += r["n"]
    assert max(found.values()) >= 500  # regions that went to one shard
    sent = []
    merge = suffix._merge_or_pass

    def watched(shards):
        sent.append(shards)
        return merge(shards)
    monkeypatch.setattr(suffix, "_merge_or_pass", watched)
    assert repeats(df) == sorted(brute_repeats(rows))
    # the regions of a block as they are sent: none of a wide anchor, and windows in many shards
    wide = {a for a, n in found.items() if n > 20_000 // (suffix.SPAN + suffix.LENGTH)}
    block = [r for r in pieces.collect() if r["block"] == 0]
    table = pa.table({"block": pa.array([0] * len(block), pa.int32()), "piece": [bytes(r["piece"]) for r in block]})
    known = pa.table({"block": pa.array([0] * len(found), pa.int32()), "anchor": list(found),
                      "wide": [a in wide for a in found]})
    parts = suffix._regions(sent[0], 24)(table, known).to_pylist()
    for part in parts:
        if 0 <= part["shard"] < sent[0]:
            assert not wide & set(suffix.unpack(pa.table({"piece": [part["piece"]]}))["anchor"].to_pylist())
    sizes = [len(suffix.unpack(pa.table({"piece": [p["piece"]]}))) for p in parts if p["shard"] >= sent[0]]
    assert len(sizes) == 24 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_repeats_query_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(suffix, "block_count", lambda df, size: 4)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op6_suffix_dedup(spark, SF001).collect()) == brute_repeats(docs)


def test_remove_repeats_cuts_whole_characters_and_keeps_columns(spark):
    one, two = "é" * 30 + "x" * 90, "ê" * 30 + "x" * 90 + "yz"
    rows = [(1, one), (2, one), (3, two), (None, one), (4, None), (4, "short"), (4, "short")]
    df = texts(spark, rows, extra=True)
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns and out.schema == df.schema
    got = sorted(((str(r["doc_id"]), r["text"], r["n_chars"], r["lang"]) for r in out.collect()), key=str)
    # é and ê differ in their last byte: nothing before the x's repeats, and their 90 bytes are too few
    assert got == sorted([("1", one, 120, "l"), ("2", "", 0, "l"), ("3", two, 122, "l"), ("4", None, 0, "l"),
                          ("4", "short", 5, "l"), ("4", "short", 5, "l"), ("None", "", 0, "l")], key=str)
    assert suffix.remove_repeats(df.limit(0)).count() == 0 and suffix.repeated_digests(df.limit(0)).count() == 0


def peak_bytes(run):
    """What a call takes at most in arrays (numpy reports its own to tracemalloc)."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_worker_takes_little_beside_a_block():
    """Steps over a whole block hold its bytes and the arrays of a chunk, not those of the block: two workers and the
    JVM share an executor."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, suffix.BLOCK_BYTES, dtype=np.uint8)
    data[4_000_000:4_003_000] = data[1_000_000:1_003_000]
    edges = np.arange(0, len(data) + 1, 2048)
    docs = pa.table({"doc_id": pa.array(np.arange(len(edges) - 1)), "text": binary_array(data, edges).cast(pa.string())})
    pieces = pa.table({"block": pa.array([0], pa.int32()), "piece": pa.array([pack(docs)], pa.binary())})
    gone = pa.table({"block": pa.array([0], pa.int32()), "piece": pa.array([pack(suffix._removed(
        np.array([1953, 1954]), np.array([256, 0]), np.array([1693, 1109])))], pa.binary())})
    assert peak_bytes(lambda: suffix._anchor_counts(pieces)) < 6 * len(data)
    assert peak_bytes(lambda: suffix._finish(False)(pieces, gone)) < 6 * len(data)
    size = 300
    count = suffix.RUN_BYTES // size
    regions = binary_array(data[:count * size], np.arange(count + 1) * size)
    windows = np.full(count, size - suffix.LENGTH + 1)
    assert peak_bytes(lambda: suffix._classes(regions, windows, np.arange(count))) < 60 * suffix.RUN_BYTES


def test_memory_goes_back_when_a_task_holds_nothing_more(monkeypatch):
    """Workers wait beside the next stage's: what a task's last batch took must be free when it is given back."""
    class Taken:
        pass
    seen, alive = [], []
    monkeypatch.setattr(arrays, "give_back", lambda: alive.append([r() is not None for r in seen]))

    def batches(source):
        for _ in source:
            taken = Taken()
            seen.append(weakref.ref(taken))
            yield 1

    def tables(*given):
        return batches(iter(given)).__next__()
    assert list(arrays.tidy(batches)(iter("ab"))) == [1, 1]
    assert arrays.tidy_group(tables)("a") == 1 and arrays.tidy_cogroup(tables)("a", "b") == 1
    assert len(alive) == 3 and not any(map(any, alive))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abc" * 40, b"q", b"zz" * 70, b"\x00" * 30]), max_size=30))
def test_suffix_array_and_common_prefixes(parts):
    text = np.frombuffer(b"".join(parts) + b"\xff", np.uint8)
    order = suffix.suffix_array(text)
    data = text.tobytes() + b"\0" * 300
    cut = [data[i:i + suffix.LENGTH] for i in order.tolist()]
    assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(text)))
    common = suffix.common_prefixes(text, order, np.zeros(0, np.int64))
    for a, b in zip(order.tolist(), order.tolist()[1:]):
        want = next((k for k in range(2 * suffix.LENGTH) if data[a + k] != data[b + k]), 2 * suffix.LENGTH)
        assert min(common[b], suffix.LENGTH) == min(want, suffix.LENGTH)


# ---------------------------------------------------------------- chunks

def brute_chunks(text, low=chunks.MIN_BYTES, bits=chunks.MASK_BITS, high=chunks.MAX_BYTES):
    data, out, a, h = text.encode(), [], 0, 0
    hashes = []
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while a < len(data):
        end = next((e for e in range(a + low, min(a + high, len(data))) if hashes[e - 1] >> (32 - bits) == 0),
                   min(a + high, len(data)))
        out.append((a, data[a:end]))
        a = end
    return out


def brute_chunk_repeats(pairs):
    last = [(chunks.LAST if i is None else i, a, c) for i, t in pairs for a, c in brute_chunks(t or "")]
    first, seen, out = {}, set(), []
    for i, a, c in sorted(last):
        first.setdefault(c, i)
    for i, t in pairs:
        key, mine = (chunks.LAST if i is None else i), set()
        for a, c in brute_chunks(t or ""):
            if c in mine or key > first[c]:
                out.append((i, a, len(c), None if first[c] == chunks.LAST else first[c]))
            mine.add(c)
    return collections.Counter(out)


def test_chunks_of_odd_and_shifted_texts(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = [(1, base), (2, "inserted" + base), (3, base[:1500] + "in the middle" + base[1500:]), (4, base * 2),
            (None, base), (6, "tiny"), (7, "tiny"), (8, "a" * 2000), *[(i, t) for i, t in ODD if i not in (4, 6, 7)]]
    got = collections.Counter(tuple(r) for r in chunks.repeated_chunks(texts(spark, rows, extra=True)).collect())
    assert got == brute_chunk_repeats(rows)
    shifted = sum(n for i, _, n, _ in got if i == 2)
    assert shifted > 0.9 * len(base.encode())  # an insertion costs the chunk around it
    assert chunks.repeated_chunks(texts(spark, [])).count() == 0


def test_chunk_query_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = collections.Counter(tuple(r) for r in queries.op7_content_chunks(spark, SF001).collect())
    assert got == brute_chunk_repeats(docs)


def test_chunks_join_to_the_texts():
    rng = random.Random(6)
    batch = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 3000))) for _ in range(50)]
    data, off = suffix.raw(pa.array(batch))
    start, end = chunks.chunk_edges(data, off)
    assert b"".join(data[a:z].tobytes() for a, z in zip(start, end)) == data.tobytes()
    assert [(a - off[k], data[a:z].tobytes()) for k in [7] for a, z in zip(start, end) if off[k] <= a < off[k + 1]] \
        == brute_chunks(batch[7])


def test_planted_passages_are_found_by_the_united_chunks(spark):
    """Passages of 51 words, each put into two other documents."""
    rng = random.Random(7)
    some = [t.split() for t in (r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())]
    some = [w for w in some if len(w) > 200]
    trials = 1500
    rows, spans = [], []
    for k in range(trials):
        while True:  # not a few words over and over: their chunks never fall into step
            at = rng.choice(some)
            j = rng.randrange(len(at) - 51)
            passage = " ".join(at[j:j + 51])
            if len(set(at[j:j + 51])) >= 25:
                break
        for side in range(2):
            words = [f"{w}{k}{'ab'[side]}" for w in rng.choice(some)[:rng.randint(20, 60)]]  # nothing else in common
            before = " ".join(words) + " "
            rows.append((2 * k + side, before + passage + " " + " ".join(words[::-1])))
            spans.append((len(before.encode()), len((before + passage).encode())))

    def missed(tables):
        hit = set()
        for r in chunks.repeated_chunks(texts(spark, rows), tables=tables).collect():
            a, z = spans[r["doc_id"]]
            if r["start"] < z and r["start"] + r["n_bytes"] > a:
                hit.add(r["doc_id"] // 2)
        return trials - len(hit)
    one, three = missed(1), missed(chunks.UNITED)
    print("missed of", trials, one, three)
    assert one > 0 and three <= trials // 500


def test_united_chunks_equal_the_chunks_of_all_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()][:300] + \
        [(10 ** 6, "a" * 2000), (10 ** 6 + 1, "tiny"), (10 ** 6 + 2, "tiny"), (10 ** 6 + 3, "")]
    rows = []
    for i, t in docs:
        data = t.encode()
        off = np.array([0, len(data)])
        spans = {(a, z) for k in range(chunks.UNITED) for a, z in zip(*(e.tolist() for e in chunks.chunk_edges(
            np.frombuffer(data, np.uint8), off, gear=chunks.gear_table(k))))}
        rows += [(i, a, data[a:z]) for a, z in sorted(spans)]
    first, seen, want = {}, set(), collections.Counter()
    for i, a, c in sorted(rows):
        first.setdefault(c, i)
        if first[c] < i or (i, c) in seen:
            want[i, a, len(c), first[c]] += 1
        seen.add((i, c))
    got = chunks.repeated_chunks(texts(spark, docs), tables=chunks.UNITED).collect()
    assert collections.Counter(tuple(r) for r in got) == want
