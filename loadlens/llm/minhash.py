"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Tensoring. A table key is a pair (A_i, B_j) from two collections of ``m`` half keys, each made of ``HALF`` minhashes.
That gives m^2 tables of 2 x HALF minhashes from 2 m HALF minhashes instead of 2 m^2 HALF. A pair of similarity s meets
in some table with probability (1 - (1 - s^HALF)^m)^2; m is the smallest for which a pair at the threshold is missed
with probability at most ``MISS``.

Steps, all on narrow rows keyed by id:
1. Documents with equal shingle sets form a class; its smallest id stands for it from here on.
2. Half keys that no other class shares are dropped; the remaining ones are paired into table keys.
3. Each class is verified against the bucket partner it meets in most tables, in star groups of bounded size.
4. Half keys whose holders are not all connected by then hold the only pairs still in question. Of their holders, those
   with so many shingles found nowhere else among them that no similarity can reach the threshold are out (exact).
5. What is left is compared in full: families connected by half keys, in blocks of at most ``BLOCK`` documents against
   one another, each block pair giving at most one edge per document. No pair list is ever written.

Shingles are compared by 64-bit hashes of their words. The smallest id reachable is the component.

Edge cases: without words (null, empty, white space) the set is empty and linked with nothing; with fewer words than
the width the whole sequence is one shingle. Rows without an id are linked with nothing and kept. Rows that share an
id are one document with the links of both. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import LOWER, byte_batches, column, give_back, raw, tidy, word_array
from loadlens.llm.graph import components
from loadlens.llm.tables import materialise

HALF = 4
MISS = 1e-5
STAR = 2000    # documents of a star group beside its centre
BLOCK = 1024   # documents of a block in full comparison
COLUMNS = 4096
BATCH_BYTES = 1 << 20


def half_keys_needed(threshold: float, miss: float = MISS) -> int:
    """m, so that a pair at the threshold shares no half key in one collection with probability <= miss / 2."""
    return math.ceil(math.log(miss / 2) / math.log1p(-threshold ** HALF))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingles of each text end to end, n + 1 offsets)."""
    data, off = raw(texts)
    n = len(off) - 1
    words, doc = word_array(LOWER[data], off)
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                        len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    # windows of ``width`` words; a shorter text has one window of all its words
    size = np.minimum(count, width)
    many = np.where(count > 0, count - size + 1, 0)
    owner = np.repeat(np.arange(n), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    key = np.zeros(len(at), np.uint64)
    for j in range(width):
        has = j < size[owner]
        key[has] = _mix(key[has] * np.uint64(0x9E3779B97F4A7C15) + h[at[has] + j] + np.uint64(1))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[fresh], owner[fresh]
    return key, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def half_keys(sets: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """(texts x 2 m) half keys, A then B; rows of empty sets are 0."""
    n = len(off) - 1
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((n, 2 * m), np.int64)
    if not len(full):
        return out
    rng = np.random.default_rng(11)
    factor = rng.integers(1 << 31, size=2 * m * HALF, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(1 << 32, size=2 * m * HALF, dtype=np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    starts = off[:-1][full]
    for c in range(2 * m):
        key = np.full(len(full), c, np.uint64)
        for k in range(c * HALF, (c + 1) * HALF):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15)
                       + np.minimum.reduceat(low * factor[k] + shift[k], starts).astype(np.uint64))
        out[full, c] = key.view(np.int64)
    return out


def signatures(docs: DataFrame, width: int, m: int) -> DataFrame:
    """doc_id, n_shingles, 128-bit set digest (s1, s2) and half keys of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            sets, off = shingle_sets(column(b, "text"), width)
            halves = half_keys(sets, off, m)
            digest = np.array([np.frombuffer(hashlib.blake2b(sets[a:z], digest_size=16).digest(), np.int64)
                               for a, z in zip(off[:-1].tolist(), off[1:].tolist())]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(digest[:, 0].copy()),
                 pa.array(digest[:, 1].copy()),
                 pa.ListArray.from_arrays(np.arange(len(halves) + 1, dtype=np.int32) * 2 * m, halves.ravel())],
                ["doc_id", "n_shingles", "s1", "s2", "halves"])
    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, n_shingles long, s1 long, s2 long, halves array<long>")


def _buckets(classes: DataFrame, m: int) -> DataFrame:
    """key, doc and n of every class in a table bucket that holds another class too."""
    halves = classes.select("doc", "n", F.posexplode("halves").alias("pos", "half"))
    shared = halves.groupBy("pos", "half").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    kept = halves.join(shared, ["pos", "half"], "left_semi").groupBy("doc", "n").agg(
        F.collect_list(F.when(F.col("pos") < m, F.struct("pos", "half"))).alias("a"),
        F.collect_list(F.when(F.col("pos") >= m, F.struct("pos", "half"))).alias("b"))  # at most m of each
    tables = kept.select("doc", "n", F.explode("a").alias("a"), "b").select("doc", "n", "a", F.explode("b").alias("b")) \
        .select(F.xxhash64("a.pos", "a.half", "b.pos", "b.half").alias("key"), "doc", "n")
    several = tables.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    return tables.join(several.select("key", "low"), "key")


def _partner(buckets: DataFrame) -> DataFrame:
    """doc, centre: of the smallest members of its buckets, the one that a class meets in most tables."""
    met = buckets.where("doc != low").groupBy("doc", "low").agg(F.count("*").alias("c"))
    return met.groupBy("doc").agg(F.max(F.struct("c", (-F.col("low")).alias("low"))).alias("best")) \
        .select("doc", (-F.col("best.low")).alias("centre"))


def _star_groups(buckets: DataFrame, partner: DataFrame) -> DataFrame:
    """doc, groups: every class of a bucket with the star groups in which its set is needed (maybe none). A star of
    many members is split, with its centre in every part."""
    size = partner.groupBy("centre").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    as_member = partner.join(size, "centre").select(
        "doc", F.struct("centre", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"),
                        F.lit(False).alias("central")).alias("g"))
    as_centre = size.select(F.col("centre").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
                            .alias("part")) \
        .select("doc", F.struct(F.col("doc").alias("centre"), "part", F.lit(True).alias("central")).alias("g"))
    everyone = buckets.select("doc", F.lit(None).cast("struct<centre:long,part:long,central:boolean>").alias("g"))
    return everyone.distinct().unionByName(as_member).unionByName(as_centre).groupBy("doc") \
        .agg(F.collect_list("g").alias("groups"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle set of each wanted class representative (little-endian 64-bit), with its star groups."""
    kinds = "doc long, n long, members binary, groups array<struct<centre:long,part:long,central:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            sets, off = shingle_sets(column(b, "text"), width)
            view = memoryview(sets.astype("<u8")).cast("B")
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc"), pa.array(np.diff(off)),
                 pa.array([bytes(view[8 * a:8 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary()),
                 column(b, "groups")], ["doc", "n", "members", "groups"])
    return docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc").mapInArrow(tidy(run), kinds)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, off = raw(column(table, "members"))
    return np.ascontiguousarray(data).view("<u8"), off // 8


def _similar(common: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n1 + n2 - common)


EDGE = "a long, b long"


def _verify_star(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Edges from the centre of a star group to the members that reach the threshold."""
        members, off = _unpack(group)
        doc, central = column(group, "doc").to_numpy(), column(group, "central").to_numpy(zero_copy_only=False)
        out = []
        for c in np.flatnonzero(central):  # one, unless rows share its id
            centre = members[off[c]:off[c + 1]]
            if not len(centre):
                continue
            slot = np.minimum(np.searchsorted(centre, members), len(centre) - 1)
            total = np.concatenate([[0], np.cumsum(centre[slot] == members)])
            common = total[off[1:]] - total[off[:-1]]
            hit = _similar(common, np.diff(off), len(centre), percent) & (doc != doc[c])
            out += [(int(d), int(doc[c])) for d in doc[hit]]
        if len(members) > 1 << 17:
            give_back()
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _compare_all(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Edges that connect what is similar within a group of at most two blocks, one per document at most."""
        members, off = _unpack(group)
        doc, comp = column(group, "doc").to_numpy(), column(group, "comp").to_numpy()
        n, count = np.diff(off), len(doc)
        owner = np.repeat(np.arange(count), n)
        order = np.argsort(members, kind="stable")
        value, owner = members[order], owner[order]
        run_id = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1 if len(value) else value.astype(int)
        shared = np.bincount(run_id)[run_id] > 1 if len(value) else np.zeros(0, dtype=bool)
        run_id, owner = run_id[shared], owner[shared]
        _, run_id = np.unique(run_id, return_inverse=True)
        common = np.zeros((count, count), np.float32)
        for low in range(0, int(run_id.max()) + 1 if len(run_id) else 0, COLUMNS):
            part = (run_id >= low) & (run_id < low + COLUMNS)
            block = np.zeros((count, COLUMNS), np.float32)
            block[owner[part], run_id[part] - low] = 1
            common += block @ block.T
        edges = []
        root = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for i in range(count):
            hit = np.flatnonzero(_similar(common[i, :i], n[:i], n[i], percent) & (comp[:i] != comp[i]))
            for j in hit.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((int(doc[i]), int(doc[j])))
        if count > 100:
            give_back()
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _shared_halves(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """pos, half, doc and n of the half keys of all classes in buckets: 2 m rows a class instead of its tables."""
    return classes.join(buckets.select("doc").distinct(), "doc", "left_semi") \
        .select("doc", "n", F.posexplode("halves").alias("pos", "half"))


def _open_halves(halves: DataFrame, roots: DataFrame, m: int) -> DataFrame:
    """The half keys whose holders are in more than one component, of the classes with such a half key of either
    collection. Two classes of different components that share a table are both among them, with the halves of that
    table."""
    named = halves.select("pos", "half", "doc", "n").join(roots.withColumnRenamed("node", "doc"), "doc", "left") \
        .select("pos", "half", "doc", "n", F.coalesce("root", "doc").alias("comp"))
    mixed = named.groupBy("pos", "half").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                             F.min("n").alias("least")).where("low < high").select("pos", "half", "least")
    rows = named.join(mixed, ["pos", "half"])
    both = rows.groupBy("doc").agg(F.min("pos").alias("first"), F.max("pos").alias("last")) \
        .where((F.col("first") < m) & (F.col("last") >= m)).select("doc")
    return rows.join(both, "doc", "left_semi")


def _alive(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open classes that can still reach the threshold with anything.

    With s of its n shingles shared with any other open class, and no partner smaller than ``least``, a class has at
    most s common shingles in a union of max(least, s) + n - s.
    """
    asked = open_rows.groupBy("doc").agg(F.min("least").alias("least"))
    mine = sets.select("doc", "n", "members").join(asked, "doc")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(column(b, "members"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(column(b, "doc").to_numpy(), np.diff(off) // 8)),
                 pa.array(np.ascontiguousarray(data).view("<i8"))], ["doc", "shingle"])
    rows = mine.select("doc", "members").mapInArrow(tidy(explode), "doc long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc").alias("doc")).where("c = 1") \
        .groupBy("doc").agg(F.count("*").alias("alone"))
    s = F.col("n") - F.coalesce("alone", F.lit(0))
    return mine.select("doc", "n", "least").join(single, "doc", "left") \
        .where(100 * s >= percent * (F.greatest("least", s) + F.col("n") - s)).select("doc").distinct()


def _full_comparison(open_rows: DataFrame, sets: DataFrame, percent: int, m: int) -> DataFrame:
    """Edges from comparing all that still share an open half key of the first collection."""
    first = open_rows.where(F.col("pos") < m)
    low = first.groupBy("pos", "half").agg(F.min("doc").alias("low"))
    family = components(first.join(low, ["pos", "half"]).select(F.col("doc").alias("a"), F.col("low").alias("b")))
    member = open_rows.select("doc", "comp").distinct().join(family.withColumnRenamed("node", "doc"), "doc", "left") \
        .select("doc", "comp", F.coalesce("root", "doc").alias("family"))
    size = member.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    mine = F.pmod(F.xxhash64("doc"), F.col("parts"))
    placed = member.join(size, "family").withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("doc", "comp", "family", F.least("mine", "other").alias("p1"), F.greatest("mine", "other").alias("p2"))
    return placed.join(sets.select("doc", "members"), "doc").groupBy("family", "p1", "p2") \
        .applyInArrow(_compare_all(percent), EDGE)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Links documents whose sets of ``width``-word shingles have 100 |A and B| >= ``percent`` |A or B|.
    """
    m = half_keys_needed(percent / 100)
    table = materialise(signatures(docs, width, m), "signatures")
    named = table.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"),
                                            F.first("halves").alias("halves"))
    # rows that share an id link the classes they are in
    same_id = named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").drop("c").join(named, "doc_id") \
        .join(classes.select("s1", "s2", "doc"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    buckets = materialise(_buckets(classes.select("doc", "n", "halves"), m), "buckets")
    wanted = _star_groups(buckets, _partner(buckets))
    sets = materialise(_sets(docs, wanted, width), "sets")
    stars = sets.select("doc", "members", F.explode("groups").alias("g")) \
        .select("doc", "members", "g.centre", "g.part", "g.central") \
        .groupBy("centre", "part").applyInArrow(_verify_star(percent), EDGE)
    edges = materialise(stars.unionByName(same_id), "links")
    roots = components(edges)
    halves = _shared_halves(classes.select("doc", "n", "halves"), buckets)
    open_rows = materialise(_open_halves(halves, roots, m), "open")
    if not open_rows.isEmpty():
        alive = _alive(open_rows, sets, percent)
        open_rows = materialise(_open_halves(open_rows.join(alive, "doc", "left_semi"), roots, m), "open")
    if not open_rows.isEmpty():
        more = _full_comparison(open_rows, sets, percent, m)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    final = classes.select("s1", "s2", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left") \
        .select("s1", "s2", F.coalesce("root", "doc").alias("component"))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = table.select("doc_id", "n_shingles", F.when(linked, F.col("s1")).alias("s1"), F.when(linked, F.col("s2"))
                       .alias("s2")).join(final, ["s1", "s2"], "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest id), all columns unchanged. Of rows that share an id and are kept all
    stay; rows without an id stay."""
    drop = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
