"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base patterns (``base_spans``) give e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers written in
their usual form. The field (``CRF``) labels tokens O, B-kind or I-kind from word shapes: a token is a run of letters, a
run of digits or one mark; its features are its shape, the shapes around it, pairs of neighbours, known words, and the
digits of the number it stands in. It is trained on a small labelled table (``labelled_table``, at most ``LABELLED``
rows) by maximum likelihood and decoded by Viterbi, many sequences at a time. What it finds must also be well formed
(``plausible``: digit counts, checksum, address parts) and must not overlap a base span.

Sequences are windows of ``REACH`` characters around anchors, the places a span of these kinds cannot do without (digits,
at signs, and at and dot as words); every text is searched for anchors as a whole. A window longer than ``CORE``
characters is cut into cores with ``REACH`` characters of context on either side; a span belongs to the core in which it
starts. So memory is bounded by the batch, and a text is judged alike whatever stands beside it in the table.

Edge cases: a null or empty text has no spans. Repeated rows are judged alike. Without usable training text (an empty
table) the field is trained on its own carrier words. A very long text goes alone in its batch. Spans of one start are
ordered by kind as listed. Empty tables give an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import byte_batches, column

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 160
CORE = 2000
#: Rows of the labelled table.
LABELLED = 2000
CARRIER_CHARS = 200
CONTEXT = 48
#: Tokens decoded together.
DECODE_TOKENS = 1 << 16


# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with the local part before it; matches never overlap, and each character is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in order; each pattern is linear in the text."""
    out = [(a, 0, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:  # 19 digits with 18 separators at most
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


# ---------------------------------------------------------------- tokens and features

SPACE, LETTER, DIGIT, MARK = range(4)
_CLASS = np.full(0x250, LETTER, np.uint8)
_CLASS[:0x80] = MARK
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0]] = SPACE
for _a, _z, _c in ((48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER)):
    _CLASS[_a:_z] = _c
_CLASS[0x80:0x85] = _CLASS[0x86:0xA0] = _CLASS[0xA1:0xC0] = MARK
_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)

_LENGTH = np.array([0, 0, 1, 2, 3, 4, 4, 4, 4, 5])  # letters: 1, 2, 3, 4, 5-8, more
LETTER_SHAPES, DIGIT_SHAPES, MARK_SHAPES, GAPS = 5 * 6, 24, 129, 4
ATOMS = (LETTER_SHAPES + DIGIT_SHAPES + MARK_SHAPES) * GAPS + 1
PAD = ATOMS - 1
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
CHAINS = 23 * 2 * 3


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    atom: np.ndarray
    chain: np.ndarray
    word: list[str]


def _classes(code: np.ndarray) -> np.ndarray:
    kind = np.where(code < 0x250, _CLASS[np.minimum(code, 0x24F)], LETTER)
    kind[(code >= 0x2010) & (code < 0x2070)] = MARK
    kind[np.isin(code, _SPACES)] = SPACE
    return kind


def tokens(text: str) -> Tokens:
    """Runs of letters, runs of digits and single marks of a window, with their shapes."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _classes(code)
    head = np.ones(len(code), dtype=bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(code))
    solid = kind[start] != SPACE
    gap = np.zeros(len(start), np.int64)  # no space, one, more, or a line break before the token
    if len(start):
        blank = ~solid[:-1]
        breaks = np.add.reduceat((code == 0x0A).astype(np.int64), start)[:-1] > 0
        gap[1:] = np.where(blank, np.where(breaks, 3, np.minimum(end[:-1] - start[:-1], 2)), 0)
    start, end, gap = start[solid], end[solid], gap[solid]
    first, size, of = code[start], end - start, kind[start]
    upper = np.concatenate([[0], np.cumsum((code >= 65) & (code <= 90))])
    plain = np.concatenate([[0], np.cumsum(code < 0x80)])
    ups = upper[end] - upper[start]
    case = np.select([plain[end] - plain[start] < size, ups == 0, ups == size, (ups == 1) & (first <= 90)],
                     [4, 0, 1, 2], 3)
    shape = case * 6 + _LENGTH[np.minimum(size, 9)]
    digits = of == DIGIT
    shape[digits] = LETTER_SHAPES + np.minimum(size[digits], 21)
    for i in np.flatnonzero(digits & (size == 3)):
        if int(text[start[i]:end[i]]) <= 255:
            shape[i] = LETTER_SHAPES + 22
    marks = of == MARK
    shape[marks] = LETTER_SHAPES + DIGIT_SHAPES + np.minimum(first[marks], 128)
    word = [text[a:z].lower() if k == LETTER else "" for a, z, k in zip(start.tolist(), end.tolist(), of.tolist())]
    return Tokens(start, end, shape * GAPS + gap, _chains(text, start, end, digits), word)


def _chains(text: str, start: np.ndarray, end: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """For each token of a number, runs of digits with marks or single spaces between: its digits, checksum, groups."""
    out = np.zeros(len(start), np.int64)
    at = np.flatnonzero(digits)
    if not len(at):
        return out
    cut = np.flatnonzero((np.diff(at) > 3) | (start[at[1:]] - end[at[:-1]] > 3)) + 1
    for group in np.split(at, cut):
        number = "".join(text[start[i]:end[i]] for i in group)
        n = min(len(number), 21)
        value = (n * 2 + (12 <= n <= 19 and luhn(number))) * 3 + (min(len(group), 3) - 1)
        out[group[0]:group[-1] + 1] = value + 1
    return np.minimum(out, CHAINS - 1)


def _beside(atom: np.ndarray, k: int) -> np.ndarray:
    """The atoms k places further on, PAD beyond the window."""
    at = np.arange(len(atom)) + k
    inside = (at >= 0) & (at < len(atom))
    out = np.full(len(atom), PAD)
    out[inside] = atom[at[inside]]
    return out


class Features:
    """Columns of feature ids per token; ids index one weight table."""

    def __init__(self, words: list[str]):
        self.words = {w: i + 1 for i, w in enumerate(words)}
        single, pair, word = len(OFFSETS) * ATOMS, ATOMS * ATOMS, len(words) + 1
        sizes = [*[ATOMS] * len(OFFSETS), pair, pair, CHAINS, CHAINS, *[word] * 5]
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.size = int(self.base[-1])
        assert single == self.base[len(OFFSETS)]

    def __call__(self, t: Tokens) -> np.ndarray:
        around = {k: _beside(t.atom, k) for k in OFFSETS}
        known = np.array([self.words.get(w, 0) for w in t.word], np.int64)
        chain_before = np.concatenate([[0], t.chain[:-1]])[:len(t.chain)]
        words = []
        for k in (-2, -1, 0, 1, 2):
            shifted = _beside(known, k)
            words.append(np.where(shifted == PAD, 0, shifted))
        cols = [*around.values(), around[-1] * ATOMS + around[0], around[0] * ATOMS + around[1], t.chain, chain_before,
                *words]
        return np.stack(cols, axis=1) + self.base[:-1]


# ---------------------------------------------------------------- the field

BLOCKED = -1e4


def _allowed() -> np.ndarray:
    """Transitions: a kind goes on only behind its own start or inside."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, was in enumerate(LABELS):
                if was[2:] != to[2:]:
                    ok[i, j] = BLOCKED
    return ok


def _batch(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded (rows, longest, ..) and the lengths."""
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(n.max()), *rows[0].shape[1:]), rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out, n


@dataclass
class CRF:
    """Weights of the features (compact: only ids seen in training), transitions and what a start costs."""

    features: Features
    ids: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    bias: float = 0.0

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Emission scores of tokens x labels; features not seen in training count nothing."""
        at = np.searchsorted(self.ids, feats)
        at[at == len(self.ids)] = 0
        out = np.zeros((len(feats), len(LABELS)), np.float32)
        for c in range(feats.shape[1]):
            hit = self.ids[at[:, c]] == feats[:, c]
            out[hit] += self.weight[at[hit, c]]
        out[:, 0] += self.bias
        return out

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence (feature ids per token): Viterbi over padded batches of like length."""
        out: list = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        while order:
            take = max(1, DECODE_TOKENS // len(rows[order[-1]]))
            part, order = order[-take:], order[:-take]
            flat = self.scores(np.concatenate([rows[i] for i in part]))
            scores, n = _batch(np.split(flat, np.cumsum([len(rows[i]) for i in part])[:-1]))
            for i, path, k in zip(part, self._viterbi(scores, n), n):
                out[i] = path[:k]
        return out

    def _viterbi(self, scores: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows, steps, _ = scores.shape
        start = np.array([BLOCKED if x[0] == "I" else 0 for x in LABELS], np.float32)
        move = self.move.astype(np.float32)
        best, back = scores[:, 0] + start, np.zeros((steps, rows, len(LABELS)), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + move
            back[t] = way.argmax(axis=1)
            best = np.where((t < n)[:, None], way.max(axis=1) + scores[:, t], best)
        path = np.zeros((rows, steps), np.int64)
        label = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            label = np.where(t == n - 1, best.argmax(axis=1), label)
            path[:, t] = label
            label = np.where(t < n, back[t, np.arange(rows), label], label)
        return path

    @classmethod
    def train(cls, features: Features, rows: list[np.ndarray], labels: list[np.ndarray], steps: int = 80,
              rate: float = 0.15, penalty: float = 2e-3) -> "CRF":
        """Maximum likelihood with a quadratic penalty, by Adam over all rows."""
        feats, n = _batch(rows)
        truth, _ = _batch(labels)
        live = np.arange(feats.shape[1]) < n[:, None]
        ids, at = np.unique(feats[live], return_inverse=True)
        at = at.reshape(-1, feats.shape[2])
        weight, move = np.zeros((len(ids), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
        allowed, start = _allowed(), np.array([BLOCKED if x[0] == "I" else 0.0 for x in LABELS])
        moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
        true_moves = np.zeros_like(move)
        both = live[:, 1:]
        np.add.at(true_moves, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        want = np.eye(len(LABELS))[truth[live]]
        for step in range(1, steps + 1):
            emit = np.zeros((*live.shape, len(LABELS)))
            emit[live] = weight[at].sum(axis=1)
            seen, moved = _expected(emit, move + allowed, start, n)
            slope = seen[live] - want
            g_weight = np.stack([np.bincount(at.ravel(), np.repeat(slope[:, y], at.shape[1]), len(ids))
                                 for y in range(len(LABELS))], axis=1) / len(rows) + penalty * weight
            g_move = (moved - true_moves) / len(rows) + penalty * move
            for i, (x, g) in enumerate(((weight, g_weight), (move, g_move))):
                m, v = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        return cls(features, ids, weight.astype(np.float32), move + allowed)


def _expected(emit: np.ndarray, move: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every token and expected transitions, by the forward and backward recursions; the
    forward values are scaled to sum to one at every token."""
    rows, steps, k = emit.shape
    way, value = np.exp(move), np.exp(emit - emit.max(axis=2, keepdims=True))
    ahead, behind, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((rows, steps, 1))
    now = value[:, 0] * np.exp(start)
    for t in range(steps):
        if t:
            now = np.where((t < n)[:, None], (now @ way) * value[:, t], now)
        scale[:, t] = now.sum(axis=1, keepdims=True)
        ahead[:, t] = now = now / scale[:, t]
    moved = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        on = (t + 1 < n)[:, None]
        later = value[:, t + 1] * behind[:, t + 1] / scale[:, t + 1] * on
        behind[:, t] = np.where(on, later @ way.T, 1)
        moved += way * (ahead[:, t].T @ later)
    return ahead * behind, moved


# ---------------------------------------------------------------- windows, spans

_ANCHOR = re.compile(r"[0-9@]+|\b[Dd](?:ot|OT)\b|\bDOT\b|[\[({<]\s?(?:[Aa]t|AT)\s?[\])}>]"
                     r"|\b(?:[Aa]t|AT) [A-Za-z0-9-]+\.[A-Za-z]")
_HINT = re.compile(r"[0-9@]|\b(?:[Dd]ot|DOT)\b|[\[({<]\s?(?:[Aa]t|AT)\b|\b(?:[Aa]t|AT) [A-Za-z0-9-]+\.[A-Za-z]")


def windows(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, core start, core end): the text around anchors, in pieces of at most CORE characters and context."""
    merged: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, z = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = z
        else:
            merged.append([a, z])
    for a, z in merged:
        for c in range(a, z, CORE):
            end = min(c + CORE, z)
            yield max(a, c - REACH), min(z, end + REACH), c, end


def plausible(kind: int, text: str) -> bool:
    """Whether a decoded span is well formed for its kind."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        words = re.findall(r"[^\W_]+", text)
        return len(words) >= 3 and bool(re.search(r"@|\bat\b", text, re.I)) and \
            bool(re.search(r"\.|\bdot\b", text, re.I)) and words[-1].isalpha() and len(words[-1]) >= 2
    if kind == 1:
        if ":" in text:
            try:
                return bool(ip_address(text.strip()))
            except ValueError:
                return False
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 9 <= len(digits) <= 15 and len(set(digits)) > 2


def _whole(text: str, a: int, z: int) -> bool:
    """No letter or digit goes on beyond the span's edges."""
    return not (text[a].isalnum() and text[a - 1:a].isalnum()) and not (text[z - 1].isalnum() and text[z:z + 1].isalnum())


def _spans(labels: np.ndarray, t: Tokens) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) inside a window of what the labels mark."""
    begin = np.flatnonzero(labels % 2 == 1)
    for i in begin.tolist():
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        yield int(t.start[i]), int(labels[i] - 1) // 2, int(t.end[j - 1])


def _decoded(model: CRF, texts: list[str]) -> Iterator[tuple[int, int, int, int, Tokens, np.ndarray]]:
    """(text, window start, core start, core end, tokens, labels) of all windows; bounded numbers are decoded together."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a, z, core, end in windows(text):
            t = tokens(text[a:z])
            held.append((i, a, core, end, t))
            size += len(t.start)
            if size >= DECODE_TOKENS:
                yield from ((*h, y) for h, y in zip(held, model.decode([model.features(h[4]) for h in held])))
                held, size = [], 0
    yield from ((*h, y) for h, y in zip(held, model.decode([model.features(h[4]) for h in held])))


def added_spans(model: CRF, texts: list[tuple[str, list[tuple[int, int, int]]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each (text, base spans)."""
    out: list[set] = [set() for _ in texts]
    ends = [np.maximum.accumulate([z for _, _, z in base]) if base else np.zeros(0) for _, base in texts]
    starts = [np.array([a for a, _, _ in base]) for _, base in texts]
    for i, a, core, end, t, labels in _decoded(model, [text for text, _ in texts]):
        text = texts[i][0]
        for s, kind, e in _spans(labels, t):
            s, e = s + a, e + a
            before = int(np.searchsorted(starts[i], e))  # base spans that start before this one ends
            free = not before or ends[i][before - 1] <= s
            if core <= s < end and free and _whole(text, s, e) and plausible(kind, text[s:e]):
                out[i].add((s, kind, e))
    return [sorted(x) for x in out]


def find_spans(model: CRF, text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(model, [(text, base)])[0])


# ---------------------------------------------------------------- the labelled table

#: Carrier words where the table gives none.
WORDS = "the of and in is on by with it that are as was for this or from not but have".split()
HOSTS = ("example", "mail", "post", "server", "office", "web")
ENDS = ("com", "org", "net", "de", "fr", "es", "edu", "info")


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, [rng.integers(1, 10), *rng.integers(0, 10, n - 1)]))


def _card(rng: np.random.Generator, n: int, good: bool = True) -> str:
    body = str(rng.choice(["4", "51", "37", "6011", "2123"]))
    body += _digits(rng, n - 1 - len(body))
    check = next(d for d in "0123456789" if luhn(body + d))
    return body + (check if good else str((int(check) + int(rng.integers(1, 10))) % 10))


def _email(rng: np.random.Generator, word) -> str:
    name = str(rng.choice([f"{word()}.{word()}", word(), f"{word()}{rng.integers(1, 99)}", f"{word()}_{word()}",
                           f"{word()}.{rng.integers(10, 99)}"]))
    host = [str(rng.choice(HOSTS)) + str(rng.choice(["", "", f"{rng.integers(1, 20)}"])), str(rng.choice(ENDS))]
    if rng.random() < 0.4:
        host.insert(1, str(rng.choice(HOSTS)))
    form = int(rng.integers(0, 9))
    if form == 0:  # letters outside the pattern
        return f"{name}é@{'.'.join(host)}" if rng.random() < 0.5 else f"{name}@{host[0]}ü.{'.'.join(host[1:])}"
    if form == 1:
        return f"{name} @ {' . '.join(host)}" if rng.random() < 0.5 else f"{name} @ {'.'.join(host)}"
    left, right = (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"), ("", ""))[int(rng.integers(0, 5))]
    at, dot = (("at", "dot"), ("AT", "DOT"), ("At", "Dot"))[int(rng.integers(0, 3))]
    at, dot = f"{left}{at}{right}", f"{left}{dot}{right}"
    gap = " " if not left or rng.random() < 0.7 else ""
    join = f"{gap}{dot}{gap}" if rng.random() < 0.75 else "."
    if join == "." and not left:
        at = "at"
    return f"{name.replace('.', join) if rng.random() < 0.5 else name}{gap}{at}{gap}{join.join(host)}"


def _ip(rng: np.random.Generator) -> str:
    parts = [str(x) for x in rng.integers(0, 256, 4)]
    form = int(rng.integers(0, 6))
    if form == 0:
        return ":".join(f"{x:x}" for x in rng.integers(1, 65536, 8))
    return ("[.]", "(.)", " . ", " dot ", "[dot]")[form - 1].join(parts)


def _phone(rng: np.random.Generator) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    form = int(rng.integers(0, 10))
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{_digits(rng, 2)} {a} {b}{c}",
            f"+1/{a}/{b}/{c}", f"0{_digits(rng, 3)}/{b}{c}", f"+{_digits(rng, 2)} {a}/{b}{c}", f"+ 1 ({a}) {b}-{c}",
            f"0{_digits(rng, 2)} {b} {c}")[form]


def _card_form(rng: np.random.Generator) -> str:
    number = _card(rng, int(rng.choice([13, 15, 16, 16, 16, 19])))
    join = str(rng.choice([".", "/", "  ", " - ", "–", " ", "_"]))
    return join.join(number[i:i + 4] for i in range(0, len(number), 4))


def _plain(rng: np.random.Generator) -> str:
    """Numbers and words that look like personal data and are none."""
    d = lambda n: _digits(rng, n)
    hexed = hashlib.sha1(d(9).encode()).hexdigest()
    return (f"{d(4)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", f"{rng.integers(10, 24)}:{d(2)}:{d(2)}",
            f"{rng.integers(1, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 99)}", f"{d(2)}.{d(2)}", f"{d(3)},{d(3)},{d(3)}",
            f'token = "{hexed}"', hexed, d(int(rng.integers(1, 9))), _card(rng, 16, good=False), f"({d(4)})", f"{d(2)}%",
            f"v{rng.integers(1, 9)}.{rng.integers(0, 30)}", f"§ {d(3)} {d(4)}", f"{d(5)}-{d(5)}", f"at {d(2)} dot {d(2)}",
            f"{d(3)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)} {d(3)}", f"ISBN {d(3)}-{d(1)}-{d(5)}",
            "a dot on the line", "meet at noon", f"looked at the dot {d(1)}", f"{d(12)}", f"{d(20)}{d(6)}", f"{d(3)}.{d(3)}",
            f"{d(4)} {d(4)}", f"@ {d(2)}", f"p. {d(3)}-{d(3)}", f"{d(2)}.{d(2)}.{d(4)}")[int(rng.integers(0, 29))]


def labelled_table(carriers: list[str], rows: int = LABELLED, seed: int = 11) -> list[tuple[str, list]]:
    """(text, spans) rows: personal data in many written forms, set into lines of the corpus, beside numbers and words
    that are none; half of the rows have personal data."""
    rng = np.random.default_rng(seed)
    pool = [w for line in carriers for w in re.findall(r"[^\W\d_]{2,12}", line)] or WORDS
    word = lambda: str(rng.choice(pool)).lower()
    makers = (lambda: _email(rng, word), lambda: _ip(rng), lambda: _card_form(rng), lambda: _phone(rng))
    plain = (lambda: f"{word()}.{rng.integers(10, 99)}@mail{rng.integers(1, 9)}.example.com",
             lambda: ".".join(map(str, rng.integers(0, 256, 4))), lambda: _card(rng, 16),
             lambda: f"+1 ({_digits(rng, 3)}) 555-{_digits(rng, 4)}")
    out = []
    for i in range(rows):
        line = carriers[int(rng.integers(len(carriers)))] if carriers else " ".join(word() for _ in range(20))
        cut = [m.end() for m in re.finditer(r"\s", line)] or [0]
        spot = int(rng.choice(cut))
        before, after = line[max(0, spot - CONTEXT):spot], line[spot:spot + CONTEXT]
        spans = []
        junk = str(rng.choice(["", "", "", "###", "%%%", "&&&", "$$$", "***", ".", ",", "!!", ")"]))
        roll = rng.random()
        if roll < 0.5:
            kind = int(rng.integers(0, 4))
            # a usual form behind or before another number is what the base patterns lose
            usual = rng.random() < 0.35
            piece = plain[kind]() if usual else makers[kind]()
            a = len(before)
            text = before + piece + junk + " "
            spans.append((a, kind, a + len(piece)))
            if kind >= 2 and usual and rng.random() < 0.7:
                text = before + piece + " " + _digits(rng, int(rng.integers(1, 5)))
            text += ("" if text.endswith(" ") else " ") + after
        else:
            text = before + _plain(rng) + junk + " " + (_plain(rng) + " " if roll > 0.8 else "") + after
        out.append((text, spans))
    return out


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 80) -> CRF:
    """Fit on four fifths of the rows; the last fifth sets the bias towards O: the least (of 0, 0.5, .. 6) at which none
    of its rows without personal data gets a span."""
    toks = [tokens(text) for text, _ in labelled]
    counts: dict[str, int] = {}
    for t, (_, spans) in zip(toks, labelled):
        for w, s in zip(t.word, t.start):
            if w and any(a <= s < z for a, _, z in spans):
                counts[w] = counts.get(w, 0) + 1
    features = Features(sorted(w for w, c in counts.items() if c >= 15))
    rows = [features(t) for t in toks]
    labels = []
    for t, (_, spans) in zip(toks, labelled):
        y = np.zeros(len(t.start), np.int64)
        for a, kind, z in spans:
            inside = np.flatnonzero((t.start >= a) & (t.start < z))
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
        labels.append(y)
    used = [i for i in range(len(rows)) if len(rows[i])]
    fit, held = [i for i in used if i % 5], [i for i in used if i % 5 == 0 and not labelled[i][1]]
    model = CRF.train(features, [rows[i] for i in fit], [labels[i] for i in fit], steps)
    for bias in np.arange(0, 6.5, 0.5):
        model.bias = float(bias)
        found = model.decode([rows[i] for i in held])
        if not any(plausible(k, labelled[i][0][a:z]) for i, y in zip(held, found) for a, k, z in _spans(y, toks[i])):
            break
    return model


def carriers(docs: DataFrame, rows: int = 400) -> list[str]:
    """Lines of the corpus for the labelled table: a line without digits of each of the ``rows`` documents with the
    smallest hash. A bounded training sample; what is searched is every text."""
    line = F.regexp_extract("text", r"(?m)^([^0-9@\n]{40,%d})" % CARRIER_CHARS, 1)
    # only the short lines take part in the top-k, never whole texts
    found = docs.where("doc_id is not null").select("doc_id", line.alias("line")).where("line != ''") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "line").limit(rows).select("line")
    return sorted({r[0] for r in found.collect()})


def fit(docs: DataFrame, rows: int = LABELLED) -> CRF:
    return train(labelled_table(carriers(docs), rows))


# ---------------------------------------------------------------- the operator

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def personal_data(docs: DataFrame, model: CRF) -> DataFrame:
    """Per document: counts of the base spans by kind, their digest, all spans (code points, end exclusive) and how many
    of them the field added. The field's weights are broadcast; they are bounded by the labelled table."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in byte_batches(batches):
            texts = [t or "" for t in column(b, "text").to_pylist()]
            base = [base_spans(t) for t in texts]
            open_ = [i for i, t in enumerate(texts) if _HINT.search(t)]
            extra: list[list] = [[] for _ in texts]
            for i, spans in zip(open_, added_spans(field, [(texts[i], base[i]) for i in open_])):
                extra[i] = spans
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(render(s).encode()).hexdigest() for s in base]),
                 pa.array([render(sorted(s + e)) for s, e in zip(base, extra)], pa.string()),
                 pa.array([len(e) for e in extra], pa.int64())],
                [f.split()[0] for f in SCHEMA.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for span in spans.split(","):
        kind, a, z = span.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind}]"]
            at = int(z)
    return "".join(out) + text[at:]
