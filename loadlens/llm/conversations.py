"""Repair of conversation structure by a run-length dynamic program over role and fault symbols.

A conversation's rows are ordered by turn (nulls first; rows of one turn by role, then text). Each row has at most one
fault: blank (nothing but white space), duplicate (role and text seen earlier in the conversation) or truncated (its last
visible character is none of ``.!?``). Edits make the initials of the roles match ``(s?(ua)+)?``: keep a row (0), change
its role to user or assistant (2), delete it (3, required for blank and duplicate rows), insert an empty row (2); a
truncated row that stays costs 1 more. Of all cheapest repairs the one whose string of edit initials is ASCII-least counts.

The program has four states (nothing yet, behind s, behind u, behind a). A row's symbol is its role's initial and its
fault, and a symbol is a 4 x 4 min-plus matrix. Equal consecutive symbols are one run, which is passed at once by the
binary powers of its matrix (kept between runs); the costs to go inside a run come from the same powers, doubled block
by block, and the edits are read off forwards: letter by letter the least one that keeps the cheapest total.

Rows are dealt by range of (conversation, turn, role, text), so a conversation of any size is split over tasks. One that
lies inside a task's range and within ``PIECE_ROWS`` rows and ``PIECE_BYTES`` bytes is repaired there. Others are written
as pieces: duplicates are found by digest over the pieces, each piece becomes one matrix, the costs to go behind each
piece are handed backwards along them, and a forward pass reads off the edits piece by piece. That pass and its digest
are sequential in a conversation by their nature; a task holds one piece (and the conversation's audit) at a time.

Edge cases: a null conversation id is a conversation of its own; a null role or text is one space (such a role is none of
s, u, a); an empty role cannot be kept either. Null turns come first and do not count as gaps. Repeated rows are
duplicates. A conversation without rows has no edits, an empty audit and the digest of the empty text. An empty table
gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import column, give_back
from loadlens.llm.blocks import pack
from loadlens.llm.tables import materialise

PIECE_ROWS = 16384
PIECE_BYTES = 4 << 20
#: Repairs of whole symbol strings kept by a worker, and the longest string kept.
MEMO = 20_000
MEMO_ROWS = 64

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = np.int64(1) << 40
LEGAL = (b"su", b"ua", b"au")
#: State behind an inserted or rerolled row: the role that the pattern asks for next.
ASKED = (USER, USER, ASSISTANT, USER)
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None),
        "o": (None, None, None, None), "x": (None, None, None, None)}
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


# ---------------------------------------------------------------- the program

def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of (.., 4, 4) with (.., 4, k)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _inserts() -> np.ndarray:
    """Cheapest insertions from state to state."""
    out = np.full((4, 4), FAR)
    for p in range(4):
        q, cost = p, 0
        while out[p, q] > cost:
            out[p, q] = cost
            q, cost = ASKED[q], cost + INSERT
    return out


INSERTS = _inserts()
#: Cost to end: accepted are nothing at all, and an assistant's row.
END = np.minimum(INSERTS[:, START], INSERTS[:, ASSISTANT])


def edits(symbol: str) -> dict[str, tuple[int, tuple]]:
    """D, K and R of a row as (cost, state behind it by state before). Upper case: truncated; x: must go."""
    role, more = symbol.lower(), TRUNCATED * symbol.isupper()
    out = {"D": (DELETE, (START, SYSTEM, USER, ASSISTANT)), "K": (more, KEPT[role])}
    return out if role == "x" else out | {"R": (REROLE + more, ASKED)}


@lru_cache(maxsize=None)  # 9 symbols, 63 powers at most
def power(symbol: str, k: int) -> np.ndarray:
    """The matrix of 2^k rows of one symbol."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    row = np.full((4, 4), FAR)
    for cost, to in edits(symbol).values():
        for p, q in enumerate(to):
            if q is not None:
                row[p, q] = min(row[p, q], cost)
    return product(INSERTS, row)


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix(symbols: str) -> np.ndarray:
    """The matrix of a whole string of rows."""
    out = np.where(np.eye(4, dtype=bool), np.int64(0), FAR)
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = product(out, power(symbol, k))
    return out


def _inside(symbol: str, n: int, behind: np.ndarray) -> np.ndarray:
    """Costs to go before the last 0 .. n rows of a run, as (n + 1) x 4."""
    out = behind[None, :]
    k = 0
    while len(out) <= n:
        out = np.concatenate([out, product(power(symbol, k)[None], out[:, :, None])[:, :, 0]])
        k += 1
    return out[:n + 1]


def unroll(symbols: str, state: int, behind: np.ndarray) -> tuple[str, int]:
    """The least cheapest edits of these rows from ``state`` on, and the state behind them; ``behind`` holds the costs
    to go after the rows. Insertions are read off before the row that follows them."""
    parts, ahead = runs(symbols), [behind]
    for symbol, n in reversed(parts):
        v = ahead[-1]
        for k in range(n.bit_length()):
            if n >> k & 1:
                v = product(power(symbol, k), v[:, None])[:, 0]
        ahead.append(v)
    out = []
    for at, (symbol, n) in enumerate(parts):
        togo = _inside(symbol, n, ahead[len(parts) - 1 - at]).tolist()
        choices = edits(symbol)
        for left in range(n, 0, -1):
            here, after = togo[left], togo[left - 1]
            while True:
                best = here[state]
                letter = next((c for c in "DIKR" if _fits(c, choices, state, best, here, after)))
                out.append(letter)
                if letter != "I":
                    state = choices[letter][1][state]
                    break
                state = ASKED[state]
    return "".join(out), state


def _fits(letter: str, choices: dict, state: int, best: int, here: list, after: list) -> bool:
    if letter == "I":
        return INSERT + here[ASKED[state]] == best
    cost, to = choices.get(letter, (0, KEPT["x"]))
    return to[state] is not None and cost + after[to[state]] == best


def closing(state: int) -> str:
    """The insertions that end a conversation."""
    return "I" * (int(END[state]) // INSERT)


def _solve(symbols: str) -> tuple[int, str]:
    audit, state = unroll(symbols, START, END)
    cost = int(product(matrix(symbols), END[:, None])[START, 0]) if symbols else 0
    return cost, audit + closing(state)


_remembered = lru_cache(maxsize=MEMO)(_solve)


def solve(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given as a symbol per row."""
    return _remembered(symbols) if len(symbols) <= MEMO_ROWS else _solve(symbols)


# ---------------------------------------------------------------- rows

def fault(text: bytes, seen: bool) -> str:
    """b, d, t or nothing for blank, duplicate, truncated and sound rows."""
    solid = text.strip()  # exactly the six ASCII spaces
    return "b" if not solid else "d" if seen else "" if solid[-1:] in b".!?" else "t"


def symbol_of(role: bytes, kind: str) -> str:
    if kind in ("b", "d"):
        return "x"
    first = role[:1].decode("latin-1")
    name = first if first and first in "sua" else "o"
    return name.upper() if kind == "t" else name


def _illegal(initials: list[bytes]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _initial(role: bytes) -> bytes:
    return role.decode()[:1].encode()


def apply(audit: str, rows: Iterable[tuple], state: int = START) -> Iterator[tuple]:
    """(edit, turn, role, text) of every row that is there after the edits."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            state = ASKED[state]
            yield letter, None, ROLE[state], b""
            continue
        turn, role, text = next(rows)
        if letter == "R":
            state = ASKED[state]
            yield letter, turn, ROLE[state], text
        elif letter == "K":
            state = KEPT[role[:1].decode("latin-1")][state]
            yield letter, turn, role, text


class Summary:
    """What is reported of a conversation, gathered over its pieces in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = None
        self.turns = 0
        self.last: bytes | None = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.size = 0

    def rows(self, rows: list[tuple], kinds: list[str]) -> None:
        for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            self.counts[name] += kinds.count(letter)
        initials = [_initial(role) for _, role, _ in rows]
        self.counts["illegal"] += _illegal(([self.last] if self.last is not None else []) + initials)
        if initials:
            self.last = initials[-1]
        for turn in (t for t, _, _ in rows if t is not None):
            if self.high is None or turn > self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1

    def repaired(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.size else b"") + role + b":" + text)
        self.size += 1

    def result(self) -> tuple:
        self.counts["gaps"] = self.high - self.low + 1 - self.turns if self.turns else 0
        return (*self.counts.values(), "".join(self.audit), self.hash.hexdigest())


SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
REPAIRED = "pos long, edit string, turn long, role string, text string"
PIECE = "seq long, piece binary"


def _frame(conv: pa.DataType, schema: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """Rows (conv_id, ...) as an Arrow batch of the schema."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    fields = [("conv_id", conv), *((n, kinds[t.replace("array<long>", "longs")])
                                   for n, t in (f.split() for f in schema.split(",")))]

    def build(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(fields)
        # byte strings become text by a cast, which copies them as they are
        arrays = [pa.array(c, pa.binary()).cast(t) if t == pa.string() and any(isinstance(x, bytes) for x in c)
                  else pa.array(c, t) for c, (_, t) in zip(cols, fields)]
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])
    return build


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by range; the range's key is a prefix of the order, so equal rows stay together and hot ones are split."""
    turn = F.col("turn").asc_nulls_first()
    return rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), turn, "role", F.left("text", F.lit(32))) \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), turn, "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], bool, bool]]:
    """(conv_id, rows, whole, first or last of the partition) in order; a long one comes in several parts."""
    key, rows, size, parts, first = None, [], 0, 0, True
    started = False
    for b in batches:
        ids, turns = column(b, "conv_id").to_pylist(), column(b, "turn").to_pylist()
        roles = column(b, "role").cast(pa.binary()).to_pylist()
        texts = column(b, "text").cast(pa.binary()).to_pylist()
        for i, turn, role, text in zip(ids, turns, roles, texts):
            if started and i != key:
                yield key, rows, not parts, first
                rows, size, parts, first = [], 0, 0, False
            key, started = i, True
            if role is None:  # only holds the conversation's place
                continue
            if rows and (len(rows) >= PIECE_ROWS or size + len(text) > PIECE_BYTES):
                yield key, rows, False, first
                rows, size, parts = [], 0, parts + 1
            rows.append((turn, role, text))
            size += len(role) + len(text)
    if started:
        yield key, rows, not parts, True


def _kinds(rows: list[tuple]) -> list[str]:
    seen: set[tuple] = set()
    out = []
    for _, role, text in rows:
        out.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    return out


def _emit(conv, summary: Summary, audit: str, rows: list[tuple], state: int, whole_rows: bool) -> list[tuple]:
    """Feed the repaired rows to the summary; with ``whole_rows`` they are also returned."""
    out = []
    for edit, turn, role, text in apply(audit, rows, state):
        if whole_rows:
            out.append((conv, summary.size, edit, turn, role, text))
        summary.repaired(role, text)
    summary.audit.append(audit)
    return out


def _pieces_table(rows: list[tuple]) -> bytes:
    turn, role, text = zip(*rows) if rows else ((), (), ())
    return pack(pa.table({"turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.binary()),
                          "text": pa.array(text, pa.binary())}))


def _rows_of(piece: bytes) -> list[tuple]:
    t = pa.ipc.open_stream(piece).read_all()
    return list(zip(*(t.column(c).to_pylist() for c in ("turn", "role", "text"))))


def _first_pass(conv: pa.DataType, whole_rows: bool) -> Callable:
    """Repair what lies inside the partition, pack the rest as pieces."""
    build = _frame(conv, f"{REPAIRED if whole_rows else SUMMARY}, {PIECE}")
    gap = (None,) * (5 if whole_rows else 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, out, size = TaskContext.get().partitionId() << 33, [], 0
        for key, rows, whole, edge in _conversations(batches):
            if not whole or edge:
                out.append((key, *gap, seq, _pieces_table(rows)))
                seq += 1
                size += len(out[-1][-1])
            else:
                summary, kinds = Summary(), _kinds(rows)
                summary.rows(rows, kinds)
                summary.counts["cost"], audit = solve("".join(symbol_of(r, k) for (_, r, _), k in zip(rows, kinds)))
                fixed = _emit(key, summary, audit, rows, START, whole_rows)
                out += [(*r, None, None) for r in fixed] if whole_rows else [(key, *summary.result(), None, None)]
                size += sum(len(r[-1]) for r in fixed) + 200
            if size > PIECE_BYTES:
                yield build(out)
                out, size = [], 0
        if out:
            yield build(out)
        give_back()
    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every row of the pieces, with its place."""
    for b in batches:
        for key, seq, piece in zip(*(column(b, c).to_pylist() for c in ("conv_id", "seq", "piece"))):
            lead = repr(key).encode() + b"\0"
            marks = [hashlib.blake2b(lead + b"%d:" % len(role) + role + text, digest_size=16).digest()
                     for _, role, text in _rows_of(piece)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array([seq] * len(marks), pa.int64()),
                                              pa.array(range(len(marks)), pa.int64())], ["mark", "seq", "row"])


def _later(pieces: DataFrame) -> DataFrame:
    """seq and the places of its rows that repeat an earlier row of their conversation."""
    marks = pieces.mapInArrow(_marks, "mark binary, seq long, row long")
    place = F.struct("seq", "row")
    first = marks.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = marks.join(first, "mark").where(place != F.col("first"))
    return again.groupBy("seq").agg(F.collect_list("row").alias("later"))  # within one piece's rows


def _piece_rows(piece: bytes, later: list | None) -> tuple[list[tuple], list[str], str]:
    rows, again = _rows_of(piece), set(later or ())
    kinds = [fault(text, i in again) for i, (_, _, text) in enumerate(rows)]
    return rows, kinds, "".join(symbol_of(r, k) for (_, r, _), k in zip(rows, kinds))


def _matrices(conv: pa.DataType) -> Callable:
    build = _frame(conv, "seq long, costs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (column(b, c).to_pylist() for c in ("conv_id", "seq", "piece", "later"))
            yield build([(key, seq, matrix(_piece_rows(piece, later)[2]).ravel().tolist())
                         for key, seq, piece, later in zip(*cols)])
    return run


def _backward(conv: pa.DataType) -> Callable:
    """Costs to go behind each piece; rows come by conversation, last piece first."""
    build = _frame(conv, "seq long, behind array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, behind = object(), END
        for b in batches:
            out = []
            for key, seq, costs in zip(*(column(b, c).to_pylist() for c in ("conv_id", "seq", "costs"))):
                if key != now:
                    now, behind = key, END
                out.append((key, seq, behind.tolist()))
                behind = product(np.array(costs, np.int64).reshape(4, 4), behind[:, None])[:, 0]
            yield build(out)
    return run


def _forward(conv: pa.DataType, whole_rows: bool) -> Callable:
    """Read off the edits piece by piece; rows come by conversation, first piece first."""
    build = _frame(conv, REPAIRED if whole_rows else SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary, state = object(), None, START

        def close() -> list[tuple]:
            tail = _emit(now, summary, closing(state), [], state, whole_rows)
            return tail if whole_rows else [(now, *summary.result())]

        for b in batches:
            cols = (column(b, c).to_pylist() for c in ("conv_id", "piece", "later", "behind"))
            for key, piece, later, behind in zip(*cols):
                if summary is None or key != now:
                    if summary is not None:
                        yield build(close())
                    now, summary, state = key, Summary(), START
                rows, kinds, symbols = _piece_rows(piece, later)
                behind = np.array(behind, np.int64)
                if not summary.audit:
                    summary.counts["cost"] = int(product(matrix(symbols), behind[:, None])[START, 0])
                summary.rows(rows, kinds)
                audit, after = unroll(symbols, state, behind)
                fixed = _emit(key, summary, audit, rows, state, whole_rows)
                state = after
                if fixed:
                    yield build(fixed)
        if summary is not None:
            yield build(close())
        give_back()
    return run


# ---------------------------------------------------------------- the operator

def _repair(rows: DataFrame, whole_rows: bool) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv = pa.string() if kind == "string" else pa.int64()
    rows = rows if kind == "string" else rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    key = "conv_id " + ("string" if kind == "string" else "long")
    schema = REPAIRED if whole_rows else SUMMARY
    done = materialise(_ordered(rows).mapInArrow(_first_pass(conv, whole_rows), f"{key}, {schema}, {PIECE}"),
                       "op12-first")
    names = [f.split()[0] for f in f"{key}, {schema}".split(", ")]
    inside = done.where("seq is null").select(*names)
    pieces = done.where("seq is not null").select("conv_id", "seq", "piece")
    if not pieces.limit(1).count():
        return inside
    later = materialise(_later(pieces), "op12-later")
    marked = pieces.join(later, "seq", "left")
    costs = marked.mapInArrow(_matrices(conv), f"{key}, seq long, costs array<long>")
    behind = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq")) \
        .mapInArrow(_backward(conv), f"{key}, seq long, behind array<long>")
    ready = marked.join(behind.drop("conv_id"), "seq")
    across = ready.repartition("conv_id").sortWithinPartitions("conv_id", "seq") \
        .mapInArrow(_forward(conv, whole_rows), f"{key}, {schema}")
    return inside.unionByName(across)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps, fault counts, illegal neighbours, cost, audit and
    the digest of the repaired conversation. A row with a null role has no other meaning than that its conversation
    is reported."""
    return _repair(rows, False)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, pos (from 0), edit (K, R or I), turn, role, text."""
    return _repair(rows, True)


def damage(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """Deterministic damage by crc32(``conv_id:turn``) % modulus: 0 loses the row (its place stays, with a null role and
    text), 1 empties the text, 2 takes its sentence marks, 3 repeats the row, 4 makes it the user's."""
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"]).cast("binary")) % modulus
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(known["text"], "[.!?]", "")) \
        .otherwise(known["text"])
    times = F.when(code == 3, F.lit(2)).otherwise(F.lit(1))
    return conversations.select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).when(code != 0, known["role"]).alias("role"),
        F.when(code != 0, text).alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
