"""Quality rules, decontamination and the pipeline against plain Python."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, SF001, texts

import corpus_pipeline
from loadlens.llm import bpe, decontaminate, minhash, quality, queries, suffix
from loadlens.llm.tables import materialise

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- quality rules

def rules(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[j:j + 5]) for j in range(len(words) - 4))
    inside = {k for j in range(len(words) - 4) if count[tuple(words[j:j + 5])] > 1 for k in range(j, j + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside),
            len(words) < 10 or 100 * len(inside) > 20 * len(words))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
TRICKY = [*ODD, (20, "a b c d e " * 4), (21, "x\nx\n x\nx \n\n\nx"), (22, "a b c d e f g h i j a b c d e"),
          (23, "é" * 50 + " 中 " * 10), (24, "\n".join(["same line here"] * 30)), (25, "w " * 50000),
          (26, "\x85 \xa0 　 y\x00z \x1c"), (27, "#*$%&|<> " * 12)]


def test_statistics_of_tricky_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = texts(spark, TRICKY, extra=True)
    got = quality.judge(df, quality.fit(df, labels)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=key) == \
        sorted(((i, *rules(t)) for i, t in TRICKY), key=key)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # nothing to calibrate on
    assert quality.judge(df.limit(0), quality.fit(df, labels)).count() == 0


def test_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op10_quality_rules(spark, SF001).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == {i: rules(t) for i, t in docs.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_verdicts_follow_the_labels(spark):
    """On larger tables: nearly all labelled poor documents go, nearly all good ones that pass the base rule stay."""
    sf = SF001.replace("0.001", "0.1")
    got = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_labels_with_gaps(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id", "quality", "toxic")
    dirty = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (10 ** 12, 0, 0)], labels.schema))
    a = quality.judge(df, quality.fit(df, labels)).select("doc_id", "kept").collect()
    b = quality.judge(df, quality.fit(df, dirty)).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)
    one_class = labels.where("quality = 1")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(df, quality.fit(df, one_class)).collect())


def test_statistics_of_a_large_batch_take_little_memory():
    """Texts are counted about a megabyte at a time, however many rows Spark hands over at once."""
    class Frame:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run
    rng = np.random.default_rng(4)
    text = "".join(chr(c) for c in rng.choice([32, *range(97, 123)], 2000))
    batch = pa.record_batch({"doc_id": pa.array(range(4000)), "text": pa.array([f"{i} {text}" for i in range(4000)])})
    tracemalloc.start()
    try:
        found = list(quality.document_statistics(Frame())(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 4000
    assert peak < 40 << 20


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(3000) ** 9, np.zeros(500), [1.0, 5e-324, 1e300]])
    y = rng.integers(0, 50, len(x)) / 49
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(quality._bits(x), quality._bits(y))], "x long, y long")
    for rank in (0, 499, 500, 1700, len(x) - 1):
        got = quality.order_statistics(df, {"x": rank, "y": len(x) - 1 - rank})
        assert np.int64(got["x"]).view(np.float64) == np.sort(x)[rank]
        assert np.int64(got["y"]).view(np.float64) == np.sort(y)[len(x) - 1 - rank]


@pytest.mark.parametrize("trees", [30, 3])  # few trees: they draw by number from more rows than come to the driver
def test_all_labelled_rows_count(spark, trees):
    """Limits and cut-off are those of all labelled rows; the rows drawn are those of the numbered table."""
    rng = random.Random(5)
    docs = [(i, " ".join("".join(rng.choice("abcdefg!#") for _ in range(6)) for _ in range(rng.randint(5, 40))))
            for i in range(1500)]
    docs += docs[:40]  # copies of rows count as often as they are there
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(1400)], "doc_id long, quality int")
    model = quality.fit(df, labels, trees=trees)
    rows = sorted((i, t) for i, t in docs if i < 1400)
    s = quality.rule_statistics(pa.array([t for _, t in rows]))
    ids = np.array([i for i, _ in rows])
    fine = ~quality.base_failed(s["n_words"], s["n_repeat_words"])
    good, x = (ids % 9 > 0)[fine], quality.features(s)[fine]
    assert (len(x) > trees * 256) == (trees == 3)
    limit = np.quantile(x[good], 1 - 0.001, axis=0, method="higher")
    assert np.array_equal(model.limit, limit)
    over = quality.excess(x, limit)
    draw = np.random.default_rng(7)
    draws = [draw.choice(len(x), 256, replace=False) for _ in range(trees)] if trees == 3 else None
    forest = quality.IsolationForest.fit(over, trees, 256, 7, draws)
    assert np.array_equal(forest.split, model.forest.split) and np.array_equal(forest.length, model.forest.length)
    assert model.cut == quality.calibrate(forest.score(over), good, 0.001)


def test_isolation_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9.0, 9.0, 9.0]]])
    forest = quality.IsolationForest.fit(x)
    score = forest.score(x)
    assert score.argmax() == 500 and 0 < score.min() and score.max() <= 1
    assert quality.IsolationForest.fit(np.ones((5, 2))).score(np.ones((3, 2))) == pytest.approx(0.5)
    # the cut loses at most its share of the good rows
    good = np.arange(len(x)) < 500
    assert (score[good] > quality.calibrate(score, good, 0.01)).mean() <= 0.01


# ---------------------------------------------------------------- decontamination

def norm(text):
    return " ".join(WORDS.findall((text or "").translate(LOWER)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_query_finds_every_passage_of_the_table(spark):
    docs = [(r["doc_id"], norm(r["text"]), r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    got = queries.op8_decontamination(spark, SF001).collect()
    exact = {(i, k) for i, t, _ in docs for k, q in items.items() if q in t}
    assert exact and {(r["doc_id"], r["item_id"]) for r in got if r["edits"] == 0} == exact
    raw_text = {i: t for i, _, t in docs}
    for r in got:
        found = norm(raw_text[r["doc_id"]].encode()[r["start"]:r["end"]].decode())
        assert edits(found, items[r["item_id"]]) == r["edits"] <= decontaminate.EDIT_RATE * len(items[r["item_id"]])


def test_edited_passages_are_found_and_strangers_are_not(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnop"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(14, 60)))) for k in range(30)]
    rows, want = [], set()
    for i in range(200):
        k, text = rng.choice(items)
        edited = list(text)
        budget = decontaminate.edit_budget(len(text))
        for _ in range(rng.randint(0, budget)):
            p = rng.randrange(len(edited))
            op = rng.randrange(3)
            if op == 0:
                edited[p] = rng.choice(letters)
            elif op == 1:
                del edited[p]
            else:
                edited.insert(p, rng.choice(letters))
        edited = "".join(edited)
        if edits(norm(edited), norm(text)) <= budget:
            want.add((i, k))
        around = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(2)]
        rows.append((i, f"{around[0]}\n{edited.upper() if i % 2 else edited.replace(' ', '  ')}\t{around[1]}"))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(300))) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_passages(texts(spark, rows, extra=True), bench).collect()}
    assert want <= got and all(i < 1000 for i, _ in got)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(texts(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_short_null_and_many_items(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "cat"), (2, None), (3, "  "), (None, "a passage without any id at all"), (5, "cat"),
                                   (5, "cat")], "item_id long, text string")
    df = texts(spark, [*ODD, (30, "A CAT\nsat"), (31, "concatenate"), (32, "a passage  without any id at ALL")], extra=True)
    want = [(30, 1, 2, 5, 0), (30, 5, 2, 5, 0), (32, None, 0, 32, 0)]
    for size in (decontaminate.BLOCK_BYTES, 10):  # one block of items, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted((tuple(r) for r in decontaminate.find_passages(df, bench).collect()), key=str) == want
        assert decontaminate.drop_contaminated(df, bench).count() == len(ODD) + 1
    assert decontaminate.find_passages(df, bench.limit(0)).count() == 0
    assert decontaminate.find_passages(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_alignment_equals_full_dynamic_programming(seed):
    rng = random.Random(seed)
    for _ in range(60):
        pattern = "".join(rng.choice("ab") for _ in range(rng.randint(5, 20)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        k = rng.randint(0, 4)
        best = min(edits(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        got = decontaminate.align(np.frombuffer(pattern.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8), k)
        if best > k:
            assert got is None
        else:
            assert got[2] == best == edits(pattern, text[got[0]:got[1]])


# ---------------------------------------------------------------- pipeline

def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "suffix_dedup", "decontamination",
                                                      "bpe_codec"]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF001).collect()}
    # 1: the verdicts of the operator (their statistics are compared above)
    kept = {r["doc_id"] for r in queries.op10_quality_rules(spark, SF001).where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    # 2: one of each group of similar five-word shingle sets
    sets = {i: frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) for i, t in rows
            for w in [WORDS.findall(t.translate(LOWER))]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = [(i, t) for i, t in rows if find(i) == i]
    # 3: repeated strings of 100 bytes are cut; a character cut in part stays
    seen, cut = set(), []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        out, at = [], 0
        for ch in t:
            size = len(ch.encode())
            out.append("" if all(gone[at:at + size]) else ch)
            at += size
        cut.append((i, "".join(out)))
    # 4: documents with a passage go
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in cut if not any(q in norm(t) for q in items)]
    near = {r["doc_id"] for r in decontaminate.find_passages(texts(spark, clean), spark.read.parquet(
        f"{SF001}/benchmark.parquet")).collect()}
    clean = [(i, t) for i, t in clean if i not in near]
    # 5: the ids of what is left
    assert set(got) == {i for i, _ in clean}
    ids, off = bpe.encode_column(pa.array([t for _, t in clean]), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    for k, (i, _) in enumerate(clean):
        assert got[i] == (int(off[k + 1] - off[k]), ids[off[k]:off[k + 1]].astype("<u4").tobytes())


def test_every_stage_takes_odd_rows_and_an_empty_table(spark):
    for pairs in (ODD * 2 + [(50, "long " * 30000)], []):
        docs = texts(spark, pairs, extra=True)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, docs, SF001), "stage")
            if name != "bpe_codec":
                assert out.columns == columns, name
            assert out.count() <= len(pairs)
            if name != "quality_rules":  # each on the odd rows themselves, not only on what the first stage leaves
                assert out.count() >= 0
    assert minhash.near_duplicates(texts(spark, ODD)).count() == len(ODD)
    assert suffix.repeated_digests(texts(spark, ODD)).count() == len(ODD)
