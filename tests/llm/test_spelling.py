"""Spelling variants against plain Python: all words, near words by letter deletion, forms and roots."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import ODD, SF001, texts

from loadlens.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(pairs):
    count = collections.Counter()
    for i, text in pairs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def related(words):
    near, cuts = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for j in range(len(w)):
            cuts[w[:j], w[j + 1:]].add(w)
            if w[:j] + w[j + 1:] in words:
                near[w].add(w[:j] + w[j + 1:])
                near[w[:j] + w[j + 1:]].add(w)
    for group in cuts.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = related(damaged(docs))
    assert len(want) > 1000 and any(r[1] for r in want)
    assert result(queries.op13_spelling_variants(spark, SF001)) == want


def test_odd_long_and_repeated_texts(spark):
    rng = random.Random(2)
    stem = ["überholung", "straßenbau", "abcdefgh", "ÀÉÎõüÿçß", "x" * 70, "y" * 5000]
    pairs = [*ODD, *ODD, (40, "Kleinigkeit KLEINIGKEIT kleinigkeit×kleinigkeit÷KleinigkeitĀkleinigkeit")]
    for i in range(300):
        w = rng.choice(stem)
        j = rng.randrange(len(w))
        pairs.append((i, f"{w[:j]}{rng.choice(['', 'a', 'é', w[j] * 2])}{w[j + 1:]} {w} {w},{w.upper()}"))
    pairs.append((99999, " ".join(rng.choice(stem[:4]) for _ in range(600_000))))  # longer than a slice
    pairs.append((99998, "z" * 300_000 + " " + "z" * 300_000 + " " + "z" * 299_999 + " " + "z" * 299_999))
    words = spelling.damaged_words(texts(spark, pairs, extra=True))
    assert {r["word"]: r["n"] for r in words.collect()} == damaged(pairs)
    short = {w: n for w, n in damaged(pairs).items() if len(w) < 10_000}
    got = [r for r in result(spelling.word_forms(words)) if len(r[0]) < 10_000]
    assert got == related(short)


@pytest.mark.parametrize("tile", [4, 37])
def test_blocks_of_large_keys(spark, tile):
    """Thousands of words that agree in two thirds, cut into blocks: every pair is found once."""
    rng = random.Random(tile)
    words = {f"{''.join(rng.choice('abc') for _ in range(rng.choice([3, 4])))}gleiches": rng.choice([2, 3, 30, 400])
             for _ in range(150)}
    words |= {f"vornean{''.join(rng.choice('abcd') for _ in range(4))}": rng.choice([2, 25]) for _ in range(80)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.word_forms(df, tile=tile)) == related(words)


def test_chains_ties_and_empty(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "ccccccc": 2, "cccccca": 20,
             "ccccccb": 20, "ddddddd": 3, "ddddddde": 29}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r for r in result(spelling.word_forms(df))}
    assert got["aaaaaaaa"][1:3] == ("aaaaaaab", "aaaaabbb")
    assert got["ccccccc"][1] == "cccccca" and got["ddddddd"][1] is None and got["ddddddd"][4] == 1
    assert sorted(got.values(), key=str) == related(words)
    empty = texts(spark, [])
    assert spelling.word_forms(spelling.damaged_words(empty)).count() == 0


def test_checksums_of_runs():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    first = rng.integers(0, 4000, 200)
    size = np.concatenate([rng.integers(1, 40, 190), rng.integers(60, 900, 10)])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(data[a:a + n].tobytes(), int(b)) for a, n, b in zip(first, size, before)]
    assert spelling.run_checksums(data, first, size, before).tolist() == want
