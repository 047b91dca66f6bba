"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

Encoding. The merges of a pre-token fix one token sequence for each of its prefixes; two neighbouring tokens can stand
in such a sequence exactly if no merge would have joined them at their common edge (``Merges.compatible``). The last
token of each prefix is therefore the one suffix in the vocabulary that is compatible with the last token of the
prefix before it. A later token starts within the last ``longest`` symbols, so what all those live positions share is
stable and is emitted; ``Merges.lookahead`` bounds from the merge list alone how far a symbol can influence what stands
before it. Memory is bounded by those two numbers, however long the pre-token is.

Decoding. Ids become their byte strings one after another; ``TextDecoder`` turns them into characters, holding back at
most the bytes of one incomplete character.

Edge cases: a null or empty text, or one of white space only, has no tokens and decodes to the empty text; repeated
rows are encoded one by one; an empty table gives an empty result; null ids stay null.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loadlens.llm.arrays import byte_batches, column, raw, tidy
from loadlens.llm.tokens import library_tokenizer
from loadlens.llm.units import UnitEncoder

BPE_BATCH_BYTES = 1 << 20
NEVER = 1 << 60
MEMO_PAIRS = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list in order of priority, as relations between symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank: dict[tuple[str, str], int] = {}
        self.born: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), r)
            if a + b not in self.born:
                self.born[a + b] = r
                self.parts[a + b] = (a, b)
        self.longest = max(map(len, vocab))
        self.lookahead = self._lookahead(merges)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._sound: dict[str, bool] = {}
        #: The tokens that the merges can build.
        self.tokens = {t: i for t, i in vocab.items() if self.sound(t)}

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after which nothing to the left can change any more.

        A merge (u, v) fails only if an earlier merge takes a symbol on the right edge of v as its left part; that one
        in turn needs its own right part. So the reach of (u, v) is len(v) plus the longest reach among earlier merges
        whose left part lies on the right edge of v.
        """
        reach: dict[str, int] = {}
        most = 1
        for u, v in merges:
            edge, best = v, reach.get(v, 0)
            while edge in self.parts:
                edge = self.parts[edge][1]
                best = max(best, reach.get(edge, 0))
            reach[u] = max(reach.get(u, 0), len(v) + best)
            most = max(most, reach[u])
        return most + self.longest

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges leave ``left`` and ``right`` as neighbours."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._apart(left, right, NEVER, NEVER)
        return known

    def _apart(self, a: str, b: str, a_until: int, b_until: int) -> bool:
        """Go back in time along the common edge; the pair is refuted by a merge that would have come first there.

        ``a`` and ``b`` meet until one is used up by its own side's merge (``a_until``, ``b_until``). Of equal merges
        the left one comes first.
        """
        while True:
            r = self.rank.get((a, b), NEVER)
            if r < a_until and r <= b_until and r < NEVER:
                return False
            born_a, born_b = self.born.get(a, -1), self.born.get(b, -1)
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                a_until, a = born_a, self.parts[a][1]
            else:
                b_until, b = born_b, self.parts[b][0]

    def sound(self, token: str) -> bool:
        """Whether the merges build this token from its own symbols."""
        known = self._sound.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b = self.parts[token]
                r = self.born[token]
                known = self.sound(a) and self.sound(b) and self._apart_before(a, b, r)
            self._sound[token] = known
        return known

    def _apart_before(self, a: str, b: str, r: int) -> bool:
        """No merge before rank ``r`` joins across the edge of a and b."""
        born_a, born_b = self.born.get(a, -1), self.born.get(b, -1)
        if born_a < 0 and born_b < 0:
            return True
        if born_a > born_b:
            return self._apart(self.parts[a][1], b, born_a, r)
        return self._apart(a, self.parts[b][0], r, born_b)


class Transducer:
    """Streams the symbols of one pre-token and yields ids as soon as they are stable."""

    def __init__(self, merges: Merges, suffix: str = ""):
        self.m = merges
        self.suffix = suffix
        self.flush = 2 * (merges.lookahead + merges.longest)
        self.most_held = 0

    def run(self, symbols: str) -> list[int]:
        """Ids of one pre-token; within the window of the stream all of it is held at once."""
        if len(symbols) > self.flush:
            return list(self.stream(symbols))
        return next(self.run_sorted([symbols]))

    def run_sorted(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each word. The states of the prefix that a word shares with the one before it are kept."""
        tokens, pairs, compatible, longest = self.m.tokens, self.m._pairs, self.m.compatible, self.m.longest
        suffix = self.suffix
        token, start, before = [""], [0], ""
        for word in words:
            n = len(word)
            if n > self.flush:
                yield list(self.stream(word))
                continue
            i = 0
            top = min(len(token) - 1, n - 1 if suffix else n)
            while i < top and word[i] == before[i]:
                i += 1
            del token[i + 1:], start[i + 1:]
            before = word
            while i < n:
                i += 1
                end = suffix if i == n else ""
                for s in range(i - longest if i > longest else 0, i):
                    piece = word[s:i] + end if end else word[s:i]
                    if piece in tokens:
                        left = token[s]
                        if not left:
                            break
                        fits = pairs.get((left, piece))
                        if fits or fits is None and compatible(left, piece):
                            break
                else:
                    raise ValueError(f"no token of the vocabulary covers {word[i - 1]!r}")
                token.append(piece)
                start.append(s)
            yield [tokens[t] for t in self._chain(token, start, n)]
            if suffix:  # the last state stands for the end of the word, not for a prefix of the next
                token.pop()
                start.pop()

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of a pre-token of any length, each as soon as it is stable."""
        m, tokens, longest = self.m, self.m.tokens, self.m.longest
        text = ""                # symbols since the last stable edge
        token: list[str] = [""]  # token[i]: the last token of the first i held symbols, started at start[i]
        start: list[int] = [0]
        before = ""              # the token before the held part
        it = iter(symbols)
        nxt = next(it, None)
        while nxt is not None:
            symbol, nxt = nxt, next(it, None)
            end = self.suffix if nxt is None else ""
            text += symbol
            i = len(text)
            for s in range(max(0, i - longest), i):
                piece = text[s:i] + end
                if piece in tokens:
                    left = token[s] if s else before
                    if not left or m.compatible(left, piece):
                        token.append(piece)
                        start.append(s)
                        break
            else:
                raise ValueError(f"no token of the vocabulary covers {symbol!r}")
            if i >= self.flush and nxt is not None:
                edge = self._stable(start, max(0, i - longest), i)
                if edge:
                    yield from (tokens[t] for t in self._chain(token, start, edge))
                    before, text = token[edge], text[edge:]
                    token, start = [""] + token[edge + 1:], [0] + [s - edge for s in start[edge + 1:]]
            self.most_held = max(self.most_held, i)
        yield from (tokens[t] for t in self._chain(token, start, len(text)))

    @staticmethod
    def _stable(start: list[int], low: int, high: int) -> int:
        """The last edge that all live positions share."""
        live = set(range(low, high + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(start[top])
        return live.pop()

    @staticmethod
    def _chain(token: list[str], start: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(token[end])
            end = start[end]
        return out[::-1]


class Codec:
    """Encoding and decoding with one tokenizer file: special strings, normal form, pre-tokens, transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(model["vocab"], merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, known)) + ")") if known else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.symbols = byte_symbols()
        self.symbol_of = dict(enumerate(self.symbols))
        self.transducer = Transducer(self.merges, self.suffix)
        self.names = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        self.path = path
        self.encoder = UnitEncoder(self.encode_many)

    def encode(self, text: str) -> list[int]:
        """Ids of one text (in production: of one unit of it)."""
        if self.split_special and "<" in text:
            out: list[int] = []
            for part in self.split_special.split(text):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for symbols in self._pre_tokens(text):
            out += self.transducer.run(symbols)
        return out

    def _pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in byte symbols.

        Up to U+052F the Unicode tables of all versions in use agree; a text beyond takes the normal form and the
        pre-tokens of the library, whose tables decide there.
        """
        if text.isascii():
            text = text.lower()
        elif max(text) < "\u0530":
            # lower case character by character, without the final-sigma rule
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        else:
            tok = library_tokenizer(self.path)
            return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]
        return [self._in_symbols(w) for w in self.pattern.findall(text)]

    def _in_symbols(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.symbol_of)

    def encode_many(self, units: list[str]) -> list[list[int]]:
        """Ids of many units. Those that are one word of letters go through the transducer in sorted order, so that
        each starts from the state its common prefix with the one before has left."""
        out: list[list[int]] = [[]] * len(units)
        words: list[tuple[str, int]] = []
        for i, u in enumerate(units):
            low = u.lower()
            if low.isalpha() and u.isalpha() and max(u) < "\u0300":
                words.append((low if u.isascii() else self._in_symbols(low), i))
            else:
                out[i] = self.encode(u)
        words.sort()
        for (_, i), ids in zip(words, self.transducer.run_sorted([w for w, _ in words])):
            out[i] = ids
        return out

    def token_bytes(self) -> pa.Array:
        """The text of each id in the tokenizer's own notation, after a separating space."""
        top = max(self.names) + 1
        return pa.array([b" " + self.names.get(i, "").encode("utf-8") for i in range(top)], pa.large_binary())

    def decode_notation(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, n + 1 offsets) of the ids in that notation, each after a space."""
        if not hasattr(self, "_token_bytes"):
            self._token_bytes = self.token_bytes()
        return raw(self._token_bytes.take(pa.array(ids.astype(np.int64))))

    def decode_text(self, ids: Iterable[int]) -> str:
        """The plain text of ids: word ends become spaces, bytes become characters."""
        return "".join(TextDecoder(self).feed(ids, last=True)).rstrip(" ")


class TextDecoder:
    """Incremental byte-to-text state machine; its state is at most one incomplete character."""

    def __init__(self, codec: Codec):
        self.byte_of = {s: b for b, s in enumerate(codec.symbols)}
        self.names, self.suffix, self.special = codec.names, codec.suffix, set(codec.special)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> Iterator[str]:
        for i in ids:
            name = self.names[int(i)]
            if name in self.special:
                yield self.state.decode(b"", True) + name
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix)
            body = name[:len(name) - len(self.suffix)] if ends else name
            yield self.state.decode(bytes(self.byte_of[c] for c in body), ends)
            if ends:
                yield " "
        if last:
            yield self.state.decode(b"", True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 ids, n + 1 offsets) of whole texts."""
    return codec(path).encoder.batch(texts)


ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the decoded text in the tokenizer's notation; no shuffle."""
    return _apply(docs, path, ENCODED, lambda ids, text: (ids, text))


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with the SHA-256 of ids and text instead of the payloads."""
    def digest(ids: memoryview, text: memoryview) -> tuple[str, str]:
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()
    return _apply(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _apply(docs: DataFrame, path: str, schema: str, finish) -> DataFrame:
    names = [f.split()[0] for f in schema.split(",")]
    kind = pa.string() if "string" in schema else pa.large_binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BPE_BATCH_BYTES):
            ids, off = encode_column(column(b, "text"), path)
            text, at = codec(path).decode_notation(ids)
            id_view, text_view = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(text))
            first, second = [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                low = int(at[a]) + (z > a)  # without the space before the first token
                x, y = finish(id_view[4 * a:4 * z], text_view[low:int(at[z])])
                first.append(x if isinstance(x, str) else bytes(x))
                second.append(y if isinstance(y, str) else bytes(y))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(np.diff(off)),
                                              pa.array(first, kind), pa.array(second, kind)], names)
        codec.cache_clear()  # the next stage's tasks run in this worker too
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
