"""Exact substring deduplication with suffix arrays: of equal strings of ``LENGTH`` bytes only the earliest stays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or same document and
earlier start), judged on the input. Strings never cross documents.

1. The least hash of the GRAM-byte grams in a window of LENGTH bytes is its anchor. Equal windows have equal anchors,
   so an anchor that occurs once in the corpus rules out its windows (exact). Anchors are counted by block.
2. Runs of windows with a repeated anchor, as byte regions, go to the shard of their anchor: equal windows always meet.
3. A shard first drops regions that equal an earlier one as a whole. Of the rest, anchors with several regions are put
   into suffix arrays of about ``RUN_BYTES``: sorted by 8 bytes, then refined group by group by the rank of the
   suffix further on with doubled depth (Larsson-Sadakane) to LENGTH bytes. Common prefixes of neighbours follow
   Kasai's rule: along a diagonal of neighbour pairs the prefix shrinks by one per byte, so only the head of each
   diagonal is compared.
4. An anchor whose regions might exceed ``RUN_BYTES`` (a passage that many documents share in different contexts) goes
   to no single shard: its distinct windows of each block are dealt by a hash of their LENGTH bytes, and compared there.
5. Back in the blocks the removed windows are united into byte spans.

The blocks are dealt by hash; one query, whose text exchange is shared by the steps. A region or a spread window that
very many documents share is one row per block before it reaches its shard.

Edge cases: a null or empty text, or one shorter than LENGTH, loses nothing. Rows without an id come after all others;
rows that share an id count as several documents, in a fixed order. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.llm.arrays import binary_array, column, raw, tidy_cogroup, tidy_group
from loadlens.llm.blocks import block_count, dealt, documents, pack, packed, unpack

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1       # grams in a window
#: Texts that a worker goes over at a time: each byte takes some 60 in the arrays of hashes beside it.
CHUNK_BYTES = 1 << 19
RUN_BYTES = 3 << 19
#: Pairs of suffixes whose bytes are compared at a time.
COMPARED = 1 << 17
BLOCK_BYTES = 8 << 20
SHARDS_PER_BLOCK = 2
#: Shards of the windows that are dealt one by one: each byte of a block is at most one window.
SPREAD_PER_BLOCK = 8
LAST = (1 << 63) - 1
_BYTE = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 8 bytes from each position on, by doubling."""
    h, w, eight = _BYTE[data], 1, None
    while w < 16:
        if w == 8:
            eight = h
        h = h[:-w] * np.uint64(0x9E3779B97F4A7C15 + 2 * w) + h[w:]
        w *= 2
    h = h[:-8] * np.uint64(0xD6E8FEB86659FD93) + eight[16:len(h) + 8]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, size: int, reduce) -> np.ndarray:
    """reduce over each ``size`` neighbours, by doubling."""
    w = 1
    while 2 * w <= size:
        x = reduce(x[:-w], x[w:])
        w *= 2
    return reduce(x[:len(x) - (size - w)], x[size - w:]) if size > w else x


def _chunks(off: np.ndarray):
    """Row ranges of about CHUNK_BYTES."""
    cuts = np.flatnonzero(np.diff(off[1:] // CHUNK_BYTES)) + 1
    edges = [0, *cuts.tolist(), len(off) - 1]
    return zip(edges, edges[1:])


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of the window at each position, whether the window lies in one text, gram hashes)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, dtype=bool), np.zeros(0, np.uint64)
    grams = gram_hashes(data)
    anchor = _sliding(grams, SPAN, np.minimum)
    inside = np.ones(len(anchor), dtype=bool)
    for z in off[1:-1].tolist():
        inside[max(0, z - LENGTH + 1):z] = False
    return anchor, inside, grams


def _anchor_counts(pieces: pa.Table) -> pa.Table:
    """The anchors of a block, with the number of positions at which each is the least of a window."""
    data, off = raw(column(documents(pieces), "text"))
    found = []
    for a, z in _chunks(off):
        part = data[off[a]:off[z]]
        anchor, inside, grams = windows(part, off[a:z + 1] - off[a])
        if not len(anchor):
            continue
        # the anchors of the windows that hold a gram are at most its hash, and equal it if it is one of them
        reach = np.zeros(len(grams) + SPAN - 1, np.uint64)
        reach[SPAN - 1:SPAN - 1 + len(anchor)] = np.where(inside, anchor, 0)
        best = _sliding(reach, SPAN, np.maximum)[:len(grams)]
        found.append(grams[(best == grams) & (grams > 0)])
    value, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return pa.table({"block": pa.array(np.full(len(value), column(pieces, "block")[0].as_py(), np.int32)),
                     "anchor": pa.array(value.view(np.int64)), "n": pa.array(count)})


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size) + np.repeat(start, size)


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes from each position on, put together from the powers of two in LENGTH."""
    part, w, out, have = _BYTE[data], 1, None, 0
    while True:
        if LENGTH & w:
            out = part if out is None else out[:len(part) - have] * np.uint64(0xD6E8FEB86659FD93 + 2 * w) + part[have:]
            have += w
        if have == LENGTH:
            break
        part = part[:-w] * np.uint64(0x9E3779B97F4A7C15 + 2 * w) + part[w:]
        w *= 2
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _runs(region: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, start, count) of each run of successive windows of one region."""
    cut = np.ones(len(start), dtype=bool)
    cut[1:] = (region[1:] != region[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(cut)
    return region[head], start[head], np.diff(np.append(head, len(start)))


def _spread(content: pa.Array, n: np.ndarray, row: np.ndarray, start: np.ndarray, key: np.ndarray, block: int,
            shards: int, spread: int) -> list[tuple[int, bytes]]:
    """The distinct windows of a block's regions (in their order), packed by shards from ``shards`` on that a hash of
    the whole window gives. Windows that are the block's second are removed here."""
    data, off = raw(content)
    region = np.repeat(np.arange(len(n)), n)
    inner = _ranges(np.zeros(len(n), np.int64), n)
    place = off[:-1][region] + inner
    h = np.empty(len(place), np.uint64)
    at = 0
    for a, z in _chunks(off):
        count = int(n[a:z].sum())
        if count:
            h[at:at + count] = _window_hashes(data[off[a]:off[z]])[place[at:at + count] - off[a]]
        at += count
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    by = np.argsort(h, kind="stable")
    twice = np.flatnonzero(h[by][1:] == h[by][:-1])
    again = np.zeros(len(place), dtype=bool)
    for a in range(0, len(twice), 1 << 15):
        some = twice[a:a + (1 << 15)]
        again[by[some + 1]] = (view[place[by[some + 1]]] == view[place[by[some]]]).all(axis=1)
    out = []
    if again.any():
        gone, first, count = _runs(region[again], inner[again])
        out.append((-1 - block, pack(_removed(row[gone], start[gone] + first, count))))
    lead = np.flatnonzero(~again)
    shard = (h[lead] % np.uint64(spread)).astype(np.int64) + shards
    lead, shard = lead[np.argsort(shard, kind="stable")], np.sort(shard)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, z in zip(first, np.append(first[1:], len(shard))):
        pick = lead[a:z]
        which = region[pick]
        out.append((int(shard[a]), pack(pa.table({
            "window": binary_array(view[place[pick]].ravel(), np.arange(len(pick) + 1) * LENGTH),
            "block": pa.array(np.full(len(pick), block, np.int32)), "row": pa.array(row[which].astype(np.int32)),
            "key": pa.array(key[which]), "start": pa.array(start[which] + inner[pick])}))))
    return out


def _merge_windows(pieces: pa.Table) -> pa.Table:
    """Which of a shard's windows have an earlier equal, packed by block."""
    table = unpack(pieces)
    block, row, key, start = (column(table, c).to_numpy() for c in ("block", "row", "key", "start"))
    same = column(table, "window").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    del table
    by = np.lexsort((start, row, block, key, same))
    gone = by[1:][same[by[1:]] == same[by[:-1]]]
    gone = gone[np.lexsort((start[gone], row[gone], block[gone]))]
    # windows of one row that follow each other
    home = block[gone].astype(np.int64) << 32 | row[gone]
    home, begin, count = _runs(home, start[gone])
    row, home = home & 0xFFFFFFFF, home >> 32
    edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else home
    return _pieces("block", [(int(home[a]), pack(_removed(row[a:z], begin[a:z], count[a:z])))
                             for a, z in zip(edges, np.append(edges[1:], len(home)))])


def _regions(shards: int, spread: int):
    def run(pieces: pa.Table, repeated: pa.Table) -> pa.Table:
        """The regions of a block's windows with repeated anchors, packed by shard. Equal regions of a block are sent
        once, with the first place; the others are removed here (a piece for shard -1, the block itself). Regions of
        ``wide`` anchors are sent window by window."""
        out: list[tuple[int, bytes]] = []
        if not repeated.num_rows or not pieces.num_rows:
            return _pieces("shard", out)
        known = column(repeated, "anchor").to_numpy().view(np.uint64)
        wide = column(repeated, "wide").to_numpy(zero_copy_only=False)[np.argsort(known)]
        known = np.sort(known)
        docs = documents(pieces)
        block = column(pieces, "block")[0].as_py()
        key = column(docs, "doc_id").fill_null(LAST).to_numpy()
        data, off = raw(column(docs, "text"))
        places, sizes, anchors, contents = [], [], [], []
        for a, z in _chunks(off):
            base = int(off[a])
            anchor, inside, _ = windows(data[base:off[z]], off[a:z + 1] - base)
            if not len(anchor):
                continue
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
            new[off[a:z] [off[a:z] - base < len(anchor)] - base] = True
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(anchor)))
            use = inside[first]
            slot = np.minimum(np.searchsorted(known, anchor[first]), len(known) - 1)
            use &= known[slot] == anchor[first]
            first, n, h = first[use], n[use], anchor[first[use]]
            parts = -(-n // SPAN)  # long runs (periodic text) in pieces
            index = np.repeat(np.arange(len(n)), parts)
            step = _ranges(np.zeros(len(n), np.int64), parts) * SPAN
            first, n, h = first[index] + step, np.minimum(n[index] - step, SPAN), h[index]
            places.append(first + base)
            sizes.append(n)
            anchors.append(h)
            size = n + LENGTH - 1
            contents.append(binary_array(data[_ranges(first + base, size)], np.concatenate([[0], np.cumsum(size)])))
        if not places:
            return _pieces("shard", out)
        place, n, h = np.concatenate(places), np.concatenate(sizes), np.concatenate(anchors)
        row = np.searchsorted(off, place, "right") - 1
        content = pa.concat_arrays(contents)
        del contents
        code = content.dictionary_encode()
        ids = code.indices.to_numpy(zero_copy_only=False)
        lead = np.full(len(code.dictionary), -1, np.int64)
        lead[ids[::-1]] = np.arange(len(ids))[::-1]  # places ascend with (doc_id, start): the first one leads
        again = lead[ids] != np.arange(len(ids))
        if again.any():
            out.append((-1 - block, pack(_removed(row[again], place[again] - off[row[again]], n[again]))))
        lead = np.flatnonzero(~again)
        many = wide[np.searchsorted(known, h[lead])]
        if many.any():
            pick = lead[many]
            out += _spread(content.take(pa.array(pick)), n[pick], row[pick], place[pick] - off[row[pick]],
                           key[row[pick]], block, shards, spread)
            lead = lead[~many]
        shard = (h[lead] % np.uint64(shards)).astype(np.int64)
        order = lead[np.argsort(shard, kind="stable")]
        shard = np.sort(shard)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else shard
        for a, z in zip(first, np.append(first[1:], len(shard))):
            pick = order[a:z]
            out.append((int(shard[a]), pack(pa.table({
                "anchor": pa.array(h[pick].view(np.int64)), "block": pa.array(np.full(z - a, block, np.int32)),
                "row": pa.array(row[pick].astype(np.int32)), "key": pa.array(key[row[pick]]),
                "start": pa.array(place[pick] - off[row[pick]]), "n": pa.array(n[pick].astype(np.int32)),
                "content": content.take(pa.array(pick))}))))
        return _pieces("shard", out)
    return run


def _removed(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"row": pa.array(row.astype(np.int32)), "start": pa.array(start.astype(np.int64)),
                     "n": pa.array(n.astype(np.int64))})


def _pieces(key: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({key: pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([r[1] for r in rows], pa.binary())})


def suffix_array(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions of ``text`` in the order of their next ``length`` bytes (a shorter rest is followed by zeros); equal
    ones in order of position."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    code = np.zeros(n, np.uint64)
    for j in range(8):
        code = (code << np.uint64(8)) | wide[j:n + j]
    place = np.int32 if n + length < 1 << 31 else np.int64
    order = np.argsort(code, kind="stable").astype(place)
    head = np.ones(n, dtype=bool)
    head[1:] = code[order[1:]] != code[order[:-1]]
    del code, wide
    depth = 8
    rank = np.zeros(n + length, place)  # 0 beyond the end; else 1 + the place of the group's head
    while True:
        start = np.maximum.accumulate(np.where(head, np.arange(n, dtype=place), place(0)))
        rank[order] = start + 1
        if depth >= length:
            return order
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_)  # members of groups that are not settled
        if not len(at):
            return order
        step = min(depth, length - depth)
        members = order[at]
        key = (start[at].astype(np.int64) << 32) | rank[members + step]
        del start
        by = np.argsort(key, kind="stable")
        order[at] = members[by]
        key = key[by]
        head[at[1:]] |= key[1:] != key[:-1]
        depth += step


def common_prefixes(text: np.ndarray, order: np.ndarray, heads: np.ndarray, most: int = 2 * LENGTH) -> np.ndarray:
    """For each position, the bytes (at most ``most``) it has in common with its predecessor in ``order``.

    Kasai's rule along diagonals: if the predecessor of i is one after that of i - 1 and those two have something in
    common, i has one byte less. Only where that says nothing (a diagonal begins, or its last prefix has ended), and at
    ``heads`` (where the text's parts begin), bytes are compared, eight at a time.
    """
    n = len(text)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[1:] < 0) | (before[:-1] < 0)
    fresh[heads] = True
    wide = np.zeros(n + most + 8, np.uint8)
    wide[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    at = np.flatnonzero(fresh)
    ends = np.append(at[1:], n)  # of each diagonal
    at, ends = at[before[at] >= 0], ends[before[at] >= 0]
    common = np.zeros(n, order.dtype)
    while len(at):
        fresh[at] = True
        for first in range(0, len(at), COMPARED):
            live = at[first:first + COMPARED]
            for depth in range(0, most, 8):
                a, b = live + depth, before[live] + depth
                same = (words[a] == words[b]).all(axis=1)
                part = live[~same]
                if len(part):
                    common[part] = depth + np.argmin(words[a[~same]] == words[b[~same]], axis=1)
                live = live[same]
                common[live] = depth + 8
                if not len(live):
                    break
        # the byte after a prefix differs; a prefix cut at ``most`` is taken up again while it still counts
        at = at + np.where(common[at] < most, common[at] + 1, most - LENGTH)
        at, ends = at[at < ends], ends[at < ends]
    del before
    position = np.arange(n, dtype=order.dtype)
    source = np.maximum.accumulate(np.where(fresh, position, order.dtype.type(0)))
    return np.maximum(common[source] - (position - source), 0)


def _classes(content: pa.Array, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every window of the regions (region by region): whether an equal window has a smaller order."""
    data, off = raw(content)
    size = np.diff(off)
    text = np.zeros(len(data) + len(n), np.uint8)
    at = off[:-1] + np.arange(len(n))  # each region is followed by a byte that UTF-8 does not use
    text[_ranges(at, size)] = data
    text[at + size] = 0xFF
    order = suffix_array(text)
    common = common_prefixes(text, order, at)
    place = _ranges(at, n)
    rank_of = np.full(len(text), -1, np.int64)
    rank_of[place] = (np.repeat(rank, n) << 8) + _ranges(np.zeros(len(n), np.int64), n)
    # neighbours that agree on LENGTH bytes are equal, whether or not each is the start of a window
    joined = common[order] >= LENGTH
    joined[0] = False
    group = np.cumsum(~joined, dtype=order.dtype) - 1
    del common, joined
    own = rank_of[order]
    del rank_of
    is_window = own >= 0
    group, own, order = group[is_window], own[is_window], order[is_window]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, LAST, np.int64)
    np.minimum.at(least, group, own)
    removed = np.zeros(len(text), dtype=bool)
    removed[order[own != least[group]]] = True
    return removed[place]


def _merge_shard(pieces: pa.Table) -> pa.Table:
    """Which windows of a shard's regions have an earlier equal, packed by block."""
    table = unpack(pieces)
    out: list[tuple[int, bytes]] = []
    anchor, block, row, key, start, n = (column(table, c).to_numpy() for c in
                                         ("anchor", "block", "row", "key", "start", "n"))
    code = column(table, "content").dictionary_encode()
    same = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.lexsort((start, row, block, key))
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))  # place of each region in the order of documents and positions
    first = np.full(len(code.dictionary), len(place), np.int64)
    np.minimum.at(first, same, order)
    lead = np.flatnonzero(first[same] == order)
    again = np.flatnonzero(first[same] != order)
    # anchors with several distinct regions
    lead = lead[np.lexsort((order[lead], anchor[lead]))]
    own = anchor[lead]
    change = np.concatenate([[True], own[1:] != own[:-1]])
    group = np.cumsum(change) - 1
    several = (np.bincount(group)[group] > 1) | (_periodic(code.dictionary, same[lead], n[lead]))
    lead, group = lead[several], group[several]
    parts = [(again, start[again], n[again].astype(np.int64))]
    if len(lead):
        size = n[lead].astype(np.int64) + LENGTH
        # an anchor's regions stay in one run; those of an anchor that reaches a shard are at most RUN_BYTES
        begin = np.concatenate([[True], group[1:] != group[:-1]])
        run = (np.cumsum(size) // RUN_BYTES)[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        flags = np.zeros(int(n[lead].sum()), dtype=bool)
        offsets = np.concatenate([[0], np.cumsum(n[lead].astype(np.int64))])
        edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        for a, z in zip(edges, np.append(edges[1:], len(lead))):
            pick = lead[a:z]
            content = code.dictionary.take(pa.array(same[pick]))
            flags[offsets[a]:offsets[z]] = _classes(content, n[pick].astype(np.int64), order[pick])
        gone = np.flatnonzero(flags)
        if len(gone):
            region, first, count = _runs(np.searchsorted(offsets, gone, "right") - 1, gone)
            which = lead[region]
            parts.append((which, start[which] + first - offsets[region], count))
    which = np.concatenate([p[0] for p in parts])
    begins, counts = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    by = np.argsort(block[which], kind="stable")
    which, begins, counts = which[by], begins[by], counts[by]
    home = block[which]
    edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else home
    for a, z in zip(edges, np.append(edges[1:], len(home))):
        out.append((int(home[a]), pack(_removed(row[which[a:z]], begins[a:z], counts[a:z]))))
    return _pieces("block", out)


def _periodic(contents: pa.Array, which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Regions that may repeat one of their own windows: some byte pattern of a period below n fills a window."""
    data, off = raw(contents)
    out = np.zeros(len(which), dtype=bool)
    size = off[which + 1] - off[which]
    probe = 8
    start = off[which]
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(probe, np.uint8)), probe)
    # a period d makes the bytes at LENGTH - 8 recur d further on, for windows that begin at 0; any window of the
    # region that recurs inside it holds the byte run [n - 1, LENGTH), which then recurs at a distance below n
    anchor_at = np.minimum(n - 1, LENGTH - probe)
    key = words[start + anchor_at]
    for d in range(1, int(n.max()) if len(n) else 0):
        open_ = np.flatnonzero(~out & (n > d) & (anchor_at + d + probe <= size))
        if not len(open_):
            continue
        out[open_] = (words[start[open_] + anchor_at[open_] + d] == key[open_]).all(axis=1)
    return out


def _finish(digest: bool):
    def run(pieces: pa.Table, removed: pa.Table) -> pa.Table:
        """The spans of each document of a block, and what is left of its text."""
        docs = documents(pieces)
        data, off = raw(column(docs, "text"))
        n = len(off) - 1
        gone = unpack(removed) if removed.num_rows else None
        row = column(gone, "row").to_numpy() if gone is not None else np.zeros(0, np.int32)
        by = np.argsort(row, kind="stable")
        row = row[by]
        begin = off[row] + (column(gone, "start").to_numpy()[by] if gone is not None else 0)
        size = column(gone, "n").to_numpy()[by] + LENGTH - 1 if gone is not None else row
        firsts, lasts, kept = [], [], []
        for a, z in _chunks(off):
            base, end = int(off[a]), int(off[z])
            mine = slice(*np.searchsorted(row, [a, z]))
            cover = np.zeros(end - base + 1, np.int64)
            np.add.at(cover, begin[mine] - base, 1)
            np.add.at(cover, begin[mine] - base + size[mine], -1)
            out = np.cumsum(cover[:-1]) > 0
            if digest:
                kept.append(data[base:end][~out])
            edge = np.concatenate([[False], out, [False]])
            first, last = np.flatnonzero(edge[1:-1] & ~edge[:-2]), np.flatnonzero(edge[1:-1] & ~edge[2:]) + 1
            # a run over a text's end is two spans
            inner = off[a + 1:z] - base
            inner = np.unique(inner[(inner > 0) & (inner < end - base)])
            inner = inner[out[inner] & out[inner - 1]]
            firsts.append(np.sort(np.concatenate([first, inner])) + base)
            lasts.append(np.sort(np.concatenate([last, inner])) + base)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        owner = np.searchsorted(off, first, "right") - 1
        n_spans = np.bincount(owner, minlength=n)
        n_removed = np.bincount(owner, last - first, n).astype(np.int64)
        table = {"doc_id": column(docs, "doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(n_removed),
                 "n_spans": pa.array(n_spans)}
        if digest:
            left = np.concatenate([[0], np.cumsum(np.diff(off) - n_removed)])
            view = memoryview(np.concatenate(kept))
            table["kept_sha256"] = pa.array([hashlib.sha256(view[a:z]).hexdigest()
                                             for a, z in zip(left[:-1].tolist(), left[1:].tolist())], pa.string())
        else:
            at = pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32))
            table["starts"] = pa.ListArray.from_arrays(at, pa.array(first - off[owner]))
            table["ends"] = pa.ListArray.from_arrays(at, pa.array(last - off[owner]))
            table["text"] = _texts(column(docs, "text"), data, off, first, last)
            if "rest" in docs.column_names:
                table["rest"] = column(docs, "rest")
        return pa.table(table)
    return run


def _texts(texts: pa.Array, data: np.ndarray, off: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The texts without their spans, each cut down to whole characters; a null stays null."""
    parts = []
    for a, z in _chunks(off):
        base, end = int(off[a]), int(off[z])
        mine = slice(*np.searchsorted(first, [base, end]))
        begin, stop = first[mine] - base, last[mine] - base
        part = data[base:end]
        tail = np.append((part & 0xC0) == 0x80, False)  # not the first byte of a character
        for _ in range(3):
            begin = begin + tail[begin]
            stop = stop - tail[stop]
        keep = np.zeros(len(part) + 1, np.int32)
        real = stop > begin
        np.add.at(keep, begin[real], 1)
        np.add.at(keep, stop[real], -1)
        keep = np.cumsum(keep[:-1], dtype=np.int32) == 0
        left = np.concatenate([[0], np.cumsum(keep)])[off[a:z + 1] - base]
        parts.append(binary_array(part[keep], left).cast(pa.string()))
    return pc.if_else(texts.is_valid(), pa.concat_arrays(parts), pa.scalar(None, pa.string()))


def _solve(docs: DataFrame, digest: bool, schema: str | T.StructType) -> DataFrame:
    n = block_count(docs, BLOCK_BYTES)
    shards = SHARDS_PER_BLOCK * n
    # an anchor has at most one region of SPAN windows for each of its positions
    most = max(1, RUN_BYTES // (SPAN + LENGTH))
    pieces = packed(dealt(docs, n, rest=not digest))
    # an anchor is one row per block, so a window partition has at most as many rows as there are blocks
    counted = pieces.groupBy("block").applyInArrow(tidy_group(_anchor_counts), "block int, anchor long, n long") \
        .withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).where("total > 1") \
        .select("block", "anchor", (F.col("total") > most).alias("wide"))
    regions = pieces.groupBy("block").cogroup(counted.groupBy("block")) \
        .applyInArrow(tidy_cogroup(_regions(shards, SPREAD_PER_BLOCK * n)), "shard int, piece binary")
    merged = regions.groupBy("shard").applyInArrow(tidy_group(_merge_or_pass(shards)), "block int, piece binary")
    return pieces.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(tidy_cogroup(_finish(digest)), schema)


def _merge_or_pass(shards: int):
    def run(pieces: pa.Table) -> pa.Table:
        """A shard's regions, or its windows (from ``shards`` on), are merged; what a block has settled by itself (shard
        -1 - block) goes back to it."""
        shard = column(pieces, "shard")[0].as_py()
        if shard < 0:
            return pa.table({"block": pa.array([-1 - shard] * pieces.num_rows, pa.int32()),
                             "piece": column(pieces, "piece")})
        return _merge_shard(pieces) if shard < shards else _merge_windows(pieces)
    return run


def repeated_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of each text."""
    return _solve(docs, True, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the spans to remove (byte starts and ends), the text without them (a
    character that a span covers in part stays) and the other columns of the document in ``rest``."""
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
                         + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]
                         + [T.StructField("text", T.StringType())])
    return _solve(docs, False, kinds.add("rest", T.StructType(rest)) if rest else kinds)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out and ``n_chars`` (if they have it) brought up to date; other columns
    unchanged, no row dropped."""
    found = repeated_spans(docs)
    columns = []
    for c in docs.columns:
        col = F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`")
        if c == "n_chars":
            col = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(col).cast(docs.schema[c].dataType)
        columns.append(col.cast(docs.schema[c].dataType).alias(c))
    return found.select(columns)
