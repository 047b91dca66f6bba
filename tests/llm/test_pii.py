"""Personal data: base patterns against their regular expressions, the field against enumeration and held-out rows."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from llm_helpers import ODD, SF001, texts

from loadlens.llm import pii, queries

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_patterns_of_random_texts():
    rng = random.Random(5)
    for alphabet, n in (("ab.@-+1203 ()é..11 ", 30), ("0123456789- ", 60), ("0.1.25 ", 40), ("a@.b", 20)):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
            assert pii.base_spans(text) == base(text), text


def test_very_long_texts_take_linear_time(model):
    for unit in ("a", "1", "1.", "+1 ", "a@", "1 ", "at dot ", "@"):
        text = unit * (2_000_000 // len(unit)) if unit in "a1" else unit * 20_000
        began = time.time()
        assert pii.find_spans(model, text)[0] is not None
        assert time.time() - began < 60, unit


LINES = ["das ist eine zeile mit ganz normalen worten und noch mehr davon, bis sie lang genug ist.",
         "une autre ligne sans chiffres, mais avec des mots; et encore un peu de texte derrière",
         "the third line of the carriers has nothing of interest at all and goes on for a while"]


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_table(LINES))


def test_held_out_rows(model):
    """Spans in forms the patterns miss are found, and rows without personal data get none."""
    hit = miss = wrong = 0
    for text, spans in pii.labelled_table(LINES, 800, seed=77):
        fixed, found = pii.find_spans(model, text)
        assert set(fixed) <= set(found)
        if not spans:
            wrong += len(found) - len(fixed)
            continue
        lost = [s for s in spans if s not in fixed and not any(s[0] < z and a < s[2] for a, _, z in fixed)]
        hit += sum(s in found for s in lost)
        miss += sum(s not in found for s in lost)
    assert hit > 100 and hit >= 0.85 * (hit + miss) and wrong <= 2


def test_forms_that_the_patterns_miss(model):
    for text, kind in (("mail anna.berg (at) example (dot) com, please", 0), ("host 152[.]143[.]123[.]131 is down", 1),
                       ("pay 4785.3805.9239.1139 now", 2), ("call (743) 555-3824 today", 3)):
        fixed, found = pii.find_spans(model, text)
        assert not fixed and [k for _, k, _ in found] == [kind], text


def small_model(rng):
    features = pii.Features(["at"])
    rows = [features(pii.tokens(t)) for t in ("a 12 at b", "x@ 3 .", "at")]
    ids = np.unique(np.concatenate(rows))
    return rows, pii.CRF(features, ids, rng.normal(size=(len(ids), 9)).astype(np.float32),
                         rng.normal(size=(9, 9)) + pii._allowed(), 0.3)


def test_decoding_and_expectations_equal_enumeration():
    rows, field = small_model(np.random.default_rng(3))
    start = [pii.BLOCKED if x[0] == "I" else 0.0 for x in pii.LABELS]
    for r, got in zip(rows, field.decode(rows)):
        emit = field.scores(r).astype(float)
        paths = list(itertools.product(range(9), repeat=len(r)))
        value = np.array([start[p[0]] + sum(emit[t, y] for t, y in enumerate(p))
                          + sum(field.move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert paths[int(value.argmax())] == tuple(got)
        share = np.exp(value - value.max())
        share /= share.sum()
        seen, moved = pii._expected(emit[None], field.move, np.array(start), np.array([len(r)]))
        for t in range(len(r)):
            want = np.bincount([p[t] for p in paths], share, 9)
            assert np.allclose(seen[0, t], want, atol=1e-6)
        want = np.zeros((9, 9))
        for p, s in zip(paths, share):
            for a, b in zip(p, p[1:]):
                want[a, b] += s
        assert np.allclose(moved, want, atol=1e-6)


def test_padding_changes_nothing(model):
    parts = ["call (743) 555-3824", "x", "", "host 1 dot 2 dot 3 dot 4 and more words behind it", "12 " * 50]
    rows = [model.features(pii.tokens(p)) for p in parts]
    together = model.decode(rows)
    assert all((a == b).all() for r, a in zip(rows, together) for b in [model.decode([r])[0]])


def test_windows_cover_every_anchor():
    rng = random.Random(6)
    text = "".join(rng.choice("ab 1\n") if rng.random() < 0.5 else "word " * 30 for _ in range(3000))
    pieces = list(pii.windows(text))
    owned = [0] * len(text)
    for a, z, core, end in pieces:
        assert a <= core < end <= z and z - a <= pii.CORE + 2 * pii.REACH
        for i in range(core, end):
            owned[i] += 1
    assert max(owned) == 1 and all(owned[m.start()] for m in re.finditer("[0-9]", text))


def test_rows_of_odd_texts(spark, model):
    pairs = [*ODD, (30, "reach me: a.b@c.de or +49 (30) 123-45678, 10.0.0.1; 4785380592391139"),
             (30, "reach me: a.b@c.de or +49 (30) 123-45678, 10.0.0.1; 4785380592391139"), (31, "w " * 1_000_000 + "a@b.cd")]
    got = pii.personal_data(texts(spark, pairs, extra=True), model).collect()
    assert len(got) == len(pairs)
    want = sorted((str(i), pii.render(base(t or ""))) for i, t in pairs)
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got if not r["n_added"]) == want
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got if r["doc_id"] == 30] == [(1, 1, 1, 1)] * 2
    assert pii.personal_data(texts(spark, []), model).count() == 0


def test_table_without_carriers(spark):
    assert pii.carriers(texts(spark, ODD)) == []
    assert pii.find_spans(pii.train(pii.labelled_table([], 300), steps=10), "a 1 b")[0] == []


def test_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op11_personal_data(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = base(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_email", "n_ip", "n_card", "n_phone")) == \
            tuple(sum(k == kind for _, k, _ in spans) for kind in range(4))
        assert r["base_sha256"] == hashlib.sha256(pii.render(spans).encode()).hexdigest()
        assert set(filter(None, pii.render(spans).split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_added"] for r in got) <= 0.01 * len(docs)


def test_redaction():
    text = "a@b.cd calls +1 (743) 555-3824."
    assert pii.redact(text, pii.render(pii.base_spans(text))) == "[email] calls [phone]."
    assert pii.redact(None, "") is None and pii.redact("x", "") == "x"
