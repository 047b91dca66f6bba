"""Conversation repair against a shortest-path search over (cost, audit), and whole tables against plain Python."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
from llm_helpers import SF001

from loadlens.llm import conversations as cv
from loadlens.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(roles, kinds):
    """(cost, least audit) by Dijkstra; roles are initials."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, end = heapq.heappop(heap)
        if (i, end) in done:
            continue
        done.add((i, end))
        if i == len(roles) and end in ("", "a"):
            return cost, audit
        moves = [(2, "I", i, STEP.get((end, c))) for c in "ua"]
        if i < len(roles):
            moves.append((3, "D", i + 1, end))
            if kinds[i] not in ("b", "d"):
                more = kinds[i] == "t"
                moves.append((more, "K", i + 1, STEP.get((end, roles[i]))))
                moves += [(2 + more, "R", i + 1, STEP.get((end, c))) for c in "ua"]
        for price, letter, j, to in moves:
            if to is not None:
                heapq.heappush(heap, (cost + price, audit + letter, j, to))


def expected(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(initials, kinds)
    fixed, end, it = [], "", iter(rows)
    for letter in audit:
        want = "a" if end == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        if letter == "I":
            fixed.append((name, ""))
            end = want
            continue
        _, role, text = next(it)
        if letter != "D":
            fixed.append((name if letter == "R" else role, text))
            end = want if letter == "R" else role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()), fixed


def damaged(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = by[conv]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
            for c, r in by.items()}


def compare(df):
    want = {c: expected(r) for c, r in damaged(df.select("conv_id", "turn", "role", "text").collect()).items()}
    hurt = cv.damage(df)
    got = cv.repair(hurt).collect()
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()}
    fixed = collections.defaultdict(list)
    for r in cv.repaired_rows(hurt).orderBy("pos").collect():
        fixed[r["conv_id"]].append((r["role"], r["text"]))
    assert fixed == {c: w[1] for c, w in want.items() if w[1]}


def test_programs_of_random_symbols():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = "".join(rng.choice("uuaaasoxUASO") * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(0, 8)))
        kinds = ["b" if c == "x" else "t" if c.isupper() else "" for c in symbols]
        assert cv.solve(symbols) == cheapest(symbols.lower(), kinds), symbols


def test_powers_and_pieces_agree():
    """A long string solved in pieces, each with the costs to go behind it, gives the same edits as in one."""
    rng = random.Random(4)
    symbols = "".join(rng.choice("uuaasoxUA") * rng.choice([1, 2, 300]) for _ in range(60))
    cost, audit = cv.solve(symbols)
    cuts = [0, 1, 70, 71, 900, len(symbols)]
    parts = [symbols[a:z] for a, z in zip(cuts, cuts[1:])]
    behind = [cv.END]
    for p in reversed(parts):
        behind.append(cv.product(cv.matrix(p), behind[-1][:, None])[:, 0])
    assert behind[-1][cv.START] == cost
    out, state = "", cv.START
    for p, v in zip(parts, behind[-2::-1]):
        piece, state = cv.unroll(p, state, v)
        out += piece
    assert out + cv.closing(state) == audit
    step = np.where(np.eye(4, dtype=bool), 0, cv.FAR)
    for _ in range(13):
        step = cv.product(step, cv.power("a", 0))
    assert (cv.matrix("a" * 13) == step).all()


def test_query_on_the_table(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    compare(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF001).collect()}
    assert got == {c: expected(r)[0] for c, r in damaged(df.collect()).items()}


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "?"),
            (5, None, "user", "a"), (5, None, "user", "a"), (5, -3, "assistant", "\x0b\n"), (5, 2**40, "system", "x!"),
            (6, 1, "", "no role."), (6, 2, "Übung", "other."), (6, 3, "tool", "é…"), (7, 1, "user", " "),
            (7, 2, "assistant", "long " * 2_000_000 + ".")]
    rows += [(rng.randint(10, 60), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "x"]),
              rng.choice(["a.", "b", "", " ", None, "c? "])) for _ in range(600)]
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", seq long, edit string, piece binary")
    compare(df.repartition(7))
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair(cv.damage(empty)).count() == 0 and cv.repaired_rows(cv.damage(empty)).count() == 0


def test_conversation_over_many_pieces(spark):
    """One conversation with most rows, split over tasks and pieces: same repair as its symbols solved in one."""
    rng = random.Random(12)
    n = 3 * cv.PIECE_ROWS + 77
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "same.", ""]))
            for t in range(n)]
    rows += [(c, t, "user", f"{c}.") for c in (0, 2) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: r for r in cv.repair(df).collect()}
    assert sorted(got) == [0, 1, 2] and got[2]["audit"] == expected([r[1:] for r in rows[-3:]])[0][6]
    seen, kinds = set(), []
    for _, _, role, text in rows[:n]:
        kinds.append(cv.fault(text.encode(), (role, text) in seen))
        seen.add((role, text))
    cost, audit = cv.solve("".join(cv.symbol_of(r[2].encode(), k) for r, k in zip(rows, kinds)))
    r = got[1]
    assert (r["cost"], r["audit"], r["gaps"], r["blank"], r["duplicate"], r["truncated"]) == \
        (cost, audit, 0, kinds.count("b"), kinds.count("d"), kinds.count("t"))
    fixed = list(cv.apply(audit, [(t, a.encode(), x.encode()) for _, t, a, x in rows[:n]]))
    assert r["repaired_sha256"] == hashlib.sha256(b"\n".join(a + b":" + x for _, _, a, x in fixed)).hexdigest()
    assert cv.repaired_rows(df).where("conv_id = 1").count() == len(fixed)
