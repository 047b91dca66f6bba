"""Language-model scores against a direct PPM and direct word counts."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, SF001, texts

from loadlens.llm import lm, queries
from loadlens.llm.arrays import raw

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


class DirectPpm:
    """Method D with exclusion, context by context, from dictionaries."""

    def __init__(self, train, order):
        self.order = order
        self.counts = collections.defaultdict(collections.Counter)
        for text in train:
            for context, symbol in self.events(text):
                for k in range(order + 1):
                    self.counts[k, context[order - k:]][symbol] += 1

    def events(self, text):
        data = [lm.BEFORE] * self.order + list(text.translate(LOWER).encode()) + [lm.END]
        return [(tuple(data[i - self.order:i]), data[i]) for i in range(self.order, len(data))]

    def score(self, text):
        total = 0.0
        for context, symbol in self.events(text):
            out = set()
            for k in range(self.order, -1, -1):
                seen = {s: n for s, n in self.counts[k, context[self.order - k:]].items() if s not in out}
                n, d = sum(seen.values()), len(seen)
                if n and symbol in seen:
                    total += math.log10((2 * seen[symbol] - 1) / (2 * n))
                    break
                if n:
                    total += math.log10(d / (2 * n))
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total


def check(got, pairs, order=lm.ORDER):
    train = [(t or "") for i, t in pairs if not held(i)]
    model = DirectPpm(train, order)
    words = collections.Counter(w for t in train for w in WORDS.findall(t.translate(LOWER)))
    total, kinds, ends = sum(words.values()) + len(train), len(words) + bool(train), len(train)
    want = []
    for i, t in pairs:
        tokens = WORDS.findall((t or "").translate(LOWER))
        counts = [words[w] for w in tokens] + [ends]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in counts)
        want.append((i, held(i), len(counts), sum(c > 0 for c in counts), total, base, model.score(t or "")))
    key = lambda r: (str(r[0]), r[2], round(r[6], 2))
    got = sorted((tuple(r) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-4)
    assert len(got) == len(want)


def test_small_corpus_equals_the_direct_model(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    pairs = [(r["doc_id"], r["text"][:400]) for r in docs[:60]] + ODD  # a small fixture: the direct model is slow
    monkeypatch.setattr(lm, "block_count", lambda df: 3)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    check(lm.score_documents(texts(spark, pairs, extra=True)).collect(), pairs)


def test_the_model_has_contexts_of_five_bytes(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    pairs = [(r["doc_id"], r["text"][:300]) for r in docs[100:130]]
    check(lm.score_documents(texts(spark, pairs)).collect(), pairs, order=5)


def test_probabilities_of_a_context_sum_to_one(spark):
    """Over all 256 symbols, for seen and unseen contexts."""
    code, _ = lm.context_codes(*raw(pa.array(["abracadabra", "abba"])), order=2)
    value, n = np.unique(code, return_counts=True)
    counts = dict(zip(value.tolist(), n.tolist()))
    for context in (0x6162, 0x7261, 0x7A7A, 0xFEFE):
        rows = [(context << 8 | s, counts.get(context << 8 | s, 0)) for s in range(256)]
        rows += [(c, k) for c, k in counts.items() if c >> 8 != context]
        grams = spark.createDataFrame(rows, "code long, n long")
        p = {r["code"]: 10 ** r["logp"] for r in lm.gram_model(grams, 2).collect()}
        assert sum(p[context << 8 | s] for s in range(256)) == pytest.approx(1.0, rel=1e-9)


def test_nothing_to_learn_from(spark):
    only_held = [(i, "some words here") for i in range(200) if held(i)][:4]
    check(lm.score_documents(texts(spark, only_held)).collect(), only_held)
    assert lm.score_documents(texts(spark, [])).count() == 0


def test_lookup_returns_every_value():
    keys = np.random.default_rng(1).integers(0, 2 ** 40, 20000)
    keys = np.unique(keys)
    values = np.arange(len(keys), dtype=np.float32)
    assert (lm.Lookup(keys, values)[keys[::-1]] == values[::-1]).all()


def test_packed_values_come_back():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 2 ** 48, 5000))
    for n_word, n_gram in ((0, 0), (3, 0), (0, 1), (700, 5000)):
        slot = np.concatenate([np.arange(-n_word, 0), grams[:n_gram]])
        value = np.concatenate([rng.integers(0, 2 ** 40, n_word).astype(float), -rng.random(n_gram).astype(np.float32)])
        back_slot, back = lm.unpack_values(lm.pack_values(slot, value))
        assert (back_slot == slot).all() and (back == value).all() and len(back) == len(value)


def test_one_very_long_text(spark, monkeypatch):
    """A text many times longer than chunks and packs, among short ones."""
    monkeypatch.setattr(lm, "PACK_ROWS", 64)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 500)
    pairs = [(1, "abc de " * 3000), (2, "abc"), (3, "de fg\u00e9"), (10, None)]
    check(lm.score_documents(texts(spark, pairs)).collect(), pairs)


def test_held_out_text_is_predicted_better_than_shuffled_bytes(spark):
    """Held-out accuracy: real texts get fewer bits a byte than the same bytes in random order."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fakes = [(10 ** 6 + k, "".join(rng.permutation(list(t)))) for k, (i, t) in enumerate(rows) if held(i)]
    fakes = [(next(j for j in range(i * 100, i * 100 + 100) if held(j)), t) for i, t in fakes]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(texts(spark, rows + fakes)).collect()}
    real = sum(got[i] for i, _ in rows if held(i))
    assert real > 0.75 * sum(got[i] for i, _ in fakes)


def test_query_on_the_table(spark):
    rows = queries.op4_lm_scores(spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    model = DirectPpm([t for i, t in docs.items() if not held(i)], lm.ORDER)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["score"] == pytest.approx(model.score(docs[r["doc_id"]]), rel=1e-5)
