"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling, and each word's commoner form.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0-U+00FF), A-Z lowered. ``damaged_words`` counts them after a
deterministic loss of single letters; ``near_words`` compares words; ``word_forms`` follows each word to its root.

Two words are one edit apart exactly if their common prefix and common suffix together reach the longer length minus
one. Which words to compare: one edit touches one third of a word only, so two near words agree in two of three thirds.
Every word is dealt to the keys (length, which third is open, the letters of the other two): three as a word of its own
length, and three as the longer partner of words one letter shorter. The words of a key are laid as rows of padded
code-point matrices and compared block against block. A pair is counted under one key only, that of the third in which
its first difference lies. Keys with more than ``TILE`` words are cut into blocks, and every pair of blocks is a group
of its own, so no task holds or compares more than two blocks of a key.

Edge cases: a null or empty text has no words; rows without an id count as rows whose id is the empty text; repeated rows
count each time. Long texts are taken in slices between words, long words by narrow matrices. Ties of the commonest
near word go to the first in code-point order. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import LOWER, binary_array, byte_batches, column, give_back, raw
from loadlens.llm.tables import materialise

MIN_LENGTH = 7
MIN_COUNT = 2
DAMAGE = 31
FORM_RATIO = 10
THIRDS = 3
#: Words of one key that are compared in one piece; larger keys are compared block by block.
TILE = 2048
SLICE_BYTES = 4 << 20
PAIR_BYTES = 8 << 20
#: Longer runs get their checksum from zlib one by one.
SHORT_RUN = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[ord("a"):ord("z") + 1] = True
#: UTF-8's first byte of U+00C0-U+00FF.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_CRC = _crc_table()


def run_checksums(data: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes behind a prefix whose crc32 is ``before``."""
    out = before.astype(np.uint32)
    for i in np.flatnonzero(size > SHORT_RUN):
        out[i] = zlib.crc32(data[first[i]:first[i] + size[i]].tobytes(), int(out[i]))
    order = np.flatnonzero(size <= SHORT_RUN)
    order = order[np.argsort(-size[order], kind="stable")]
    state, at, left = out[order] ^ np.uint32(0xFFFFFFFF), first[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -j, "left")  # the runs longer than j come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def damaged_runs(data: np.ndarray, off: np.ndarray, before: np.ndarray) -> pa.Array:
    """The runs of all texts after the loss of letters, those of at least MIN_LENGTH letters; ``before``: crc32 of each
    text's prefix."""
    lead = data == _LEAD
    start = _LETTER[data] | lead
    body = start.copy()
    body[1:] |= lead[:-1]
    head, last = body.copy(), body.copy()
    head[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    head[cut] = body[cut]
    last[cut - 1] = body[cut - 1]
    first, end = np.flatnonzero(head), np.flatnonzero(last) + 1
    letters = np.concatenate([[0], np.cumsum(start)])
    count = letters[end] - letters[first]
    long = count >= MIN_LENGTH
    first, end, count = first[long], end[long], count[long]
    low = LOWER[data]
    crc = run_checksums(low, first, end - first, before[np.searchsorted(off, first, "right") - 1])
    hit = crc % DAMAGE == 0
    keep = ~hit | (count > MIN_LENGTH)
    # the byte where the lost letter starts, and its size
    nth = letters[first[hit & keep]] + (crc[hit & keep] % count[hit & keep].astype(np.uint32)).astype(np.int64)
    lost = np.flatnonzero(start)[nth]
    width = 1 + lead[lost].astype(np.int64)
    size = end - first
    size[hit & keep] -= width
    first, end, size = first[keep], end[keep], size[keep]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[end] -= 1
    taken = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    taken[lost] = False
    taken[lost[width == 2] + 1] = False
    return binary_array(low[taken], np.concatenate([[0], np.cumsum(size)]))


def _slices(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first text) of slices that end behind an ASCII byte that is no letter, or at the end."""
    a = 0
    while a < len(data):
        z = min(a + SLICE_BYTES, len(data))
        while z < len(data):
            part = data[max(a, z - 4096):z]
            free = np.flatnonzero((part < 0x80) & ~_LETTER[part])
            if len(free):
                z -= len(part) - 1 - int(free[-1])
                break
            z = min(z + SLICE_BYTES, len(data))
        doc = int(np.searchsorted(off, a, "right")) - 1
        end = int(np.searchsorted(off, z, "left"))
        yield data[a:z], np.clip(off[doc:end + 1] - a, 0, z - a), doc
        a = z


def damaged_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all whole texts after the loss of letters, with at least ``min_count`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches):
            ids = column(b, "doc_id").cast(pa.string()).fill_null("").to_pylist()
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            for data, off, doc in _slices(*raw(column(b, "text"))):
                found = pc.value_counts(damaged_runs(data, off, before[doc:doc + len(off) - 1]))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())],
                                                 ["word", "n"])
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def third_keys(words: DataFrame) -> DataFrame:
    """word, n and its keys: key (a hash), third (the open one), base (the shorter length), longer."""
    size = "char_length(word)"
    keys = []
    for longer, base in ((False, size), (True, f"({size} - 1)")):
        for s in range(THIRDS):
            rest = f"cast({base} - floor({s + 1} * {base} / {THIRDS}) as int)"
            keys.append(f"struct(xxhash64({s}, {base}, left(word, cast(floor({s} * {base} / {THIRDS}) as int)), "
                        f"right(word, {rest})) as key, {s} as third, {base} as base, {str(longer).lower()} as longer)")
    return words.selectExpr("word", "n", f"inline(array({', '.join(keys)}))") \
        .where(f"not longer or base >= {MIN_LENGTH}")


def _reach(left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns before the first difference of the rows a and b."""
    return np.argmax(left[a] != left[b], axis=1)


def _compare(group: np.ndarray, side: np.ndarray, third: np.ndarray, base: np.ndarray, longer: np.ndarray,
             text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words. Rows of a group stand together; of rows with a side of at least 0 only those with
    different sides are compared."""
    size = np.diff(off)
    width = int(size.max()) + 1
    forward = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(text)) - np.repeat(off[:-1], size)
    forward[row, col] = text
    backward = np.zeros_like(forward)
    backward[row, np.repeat(size, size) - 1 - col] = text
    step, out_a, out_b = max(1, PAIR_BYTES // width), [], []
    at = np.arange(len(group))
    for d in range(1, len(group)):  # block against the block d rows further down
        at = at[:np.searchsorted(at, len(group) - d)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        want = (third[at] == third[at + d]) & (base[at] == base[at + d]) & ~(longer[at] & longer[at + d])
        want &= (side[at] < 0) | (side[at] != side[at + d])
        for chunk in np.split(at[want], range(step, int(want.sum()), step)):
            a, b = chunk, chunk + d
            prefix = _reach(forward, a, b)
            near = prefix + _reach(backward, a, b) >= np.maximum(size[a], size[b]) - 1
            a, b, prefix, most = a[near], b[near], prefix[near], base[chunk][near]
            spot = np.minimum(prefix, most - 1)
            s = third[a].astype(np.int64)
            own = (s * most // THIRDS <= spot) & (spot < (s + 1) * most // THIRDS)
            out_a.append(a[own])
            out_b.append(b[own])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


_NEAR = "word string, n_near long, best_n long, best string"


def _near_of(rows: pa.Table) -> pa.RecordBatch:
    """Per word of these whole groups: near words found, and the commonest of them."""
    key, tile = column(rows, "key").to_numpy(), column(rows, "tile").to_numpy()
    edge = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    group = np.cumsum(edge) - 1
    alone = np.bincount(group)[group] < 2
    rows, group = rows.filter(pa.array(~alone)), group[~alone]
    word, n = column(rows, "word").cast(pa.large_binary()), column(rows, "n").to_numpy()
    third, base = column(rows, "third").to_numpy(), column(rows, "base").to_numpy().astype(np.int64)
    longer = column(rows, "longer").to_numpy(zero_copy_only=False)
    side = column(rows, "side").to_numpy()
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    bound = np.floor(np.log2(np.maximum(base, 1)) / 2)  # lengths within a factor of four share a matrix width
    for level in np.unique(bound):
        of = np.flatnonzero(bound == level)
        per = max(TILE, PAIR_BYTES // int(4 ** (level + 1)))
        cuts = np.flatnonzero(np.diff(group[of])) + 1  # groups stay whole, tiles bounded
        chunks = [0]
        for c in cuts[np.flatnonzero(np.diff(cuts // per, prepend=0))].tolist():
            chunks.append(c)
        for lo, hi in zip(chunks, [*chunks[1:], len(of)]):
            i = of[lo:hi]
            if len(i) < 2:
                continue
            text, off = raw(word.take(pa.array(i)))
            lead = text == _LEAD  # two bytes of UTF-8 to one code point of at most 0xFF
            code = text.copy()
            code[1:][lead[:-1]] += 0x40
            off = off - np.concatenate([[0], np.cumsum(lead)])[off]
            a, b = _compare(group[i], side[i], third[i], base[i], longer[i], code[~lead], off)
            pairs.append((i[a], i[b]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    to, other = np.concatenate([a, b]), np.concatenate([b, a])
    coded = word.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    place = rank[coded.indices.to_numpy()] if len(rank) else np.zeros(0, np.int64)
    order = np.lexsort((place[other], -n[other], place[to]))
    to, other = to[order], other[order]
    head = np.flatnonzero(np.concatenate([[True], place[to][1:] != place[to][:-1]])) if len(to) else to
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(to[head])).cast(pa.string()), pa.array(np.diff(np.append(head, len(to))), pa.int64()),
         pa.array(n[other[head]], pa.int64()), word.take(pa.array(other[head])).cast(pa.string())],
        ["word", "n_near", "best_n", "best"])


def _near_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_near_of`` over sorted rows; a group that goes on in the next batch waits for it."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        key, tile = column(rows, "key").to_numpy(), column(rows, "tile").to_numpy()
        same = (key == key[-1]) & (tile == tile[-1])
        cut = len(key) if not same.any() else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = rows.slice(cut)
        if cut:
            yield _near_of(rows.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield _near_of(rest)
    give_back()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best_n, best of the words (distinct, with their counts n) that have a word one edit away."""
    keyed = third_keys(words)
    hot = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    hot = materialise(hot.select("key", F.ceil(F.col("size") / tile).cast("long").alias("blocks")), "op13-hot")
    cold = keyed.join(hot, "key", "left_anti").withColumns({"tile": F.lit(0).cast("long"), "side": F.lit(-1)})
    parts = [cold.repartition("key")]
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("word", "longer"), F.col("blocks"))
        # block b meets every block: the tile of two blocks is numbered by the smaller and the larger
        tiles = keyed.join(hot, "key").withColumn("own", own) \
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
            .withColumn("tile", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")) \
            .withColumn("side", F.when(F.col("tile") == F.col("own") * (F.col("blocks") + 1), -1)
                        .otherwise(F.col("own").cast("int")))
        parts.append(tiles.select(*cold.columns).repartition("key", "tile"))
    found = [p.sortWithinPartitions("key", "tile").mapInArrow(_near_of_groups, _NEAR) for p in parts]
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")) \
        .select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows (word, form): forms are followed by doubling; counts grow along them, so they end."""
    spark_rows = materialise(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        ahead = spark_rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        spark_rows = materialise(spark_rows.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "op13-roots")
        if not spark_rows.where("moved").limit(1).count():
            return spark_rows.select("word", "root")
        spark_rows = spark_rows.drop("moved")


def word_forms(words: DataFrame, ratio: int = FORM_RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts n."""
    words = materialise(words.select("word", "n"), "op13-words")
    near = near_words(words, tile)
    taken = F.col("best_n") >= ratio * F.col("n")
    linked = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")), "op13-linked")
    ends = roots(linked.where("form is not null"))
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
