"""Quality rules: an isolation forest over rule statistics, with its threshold calibrated on labelled rows.

Rule statistics are plain counts of a whole text (words, symbols, repeated lines, ...), taken as rates. Each rate
counts only beyond a limit calibrated on labelled good rows, so ordinary variation is not an anomaly. An isolation
forest (random splits on bounded subsamples) gives each document a path length over these excesses; short paths are
anomalies. The cut-off is the score that rejects most labelled poor documents while it loses at most
``max_clean_loss`` of the labelled good ones.

Limits and cut-off are exact order statistics of all labelled rows (``order_statistics``); the trees draw their
subsamples from all of them. Only bounded things reach the driver: a table of counts per selection step, and the
``trees`` x ``sample`` rows that the trees are grown on.

Edge cases: a null or empty text has no words and fails the base rule (``n_words < 10``). Repeated rows are judged
alike. With no usable labels (none, or one class only) there is nothing to calibrate on and only the base rule
rejects. A null label, or a label of an unknown document, is not used; of several labels of one document the
smallest (poorest) counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.arrays import SPACE, binary_array, byte_batches, column, mask_counts, per_doc, raw, tidy, word_array
from loadlens.llm.tables import materialise

WINDOW = 5
#: Texts that a worker counts at a time: each byte takes some 25 beside it.
BATCH_BYTES = 1 << 20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits",
         "n_lines", "n_distinct")
FEATURES = ("symbol_rate", "upper_rate", "mark_rate", "digit_rate", "dup_line_rate", "repeat_rate")


def rule_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each whole text, vectorised over the batch."""
    data, off = raw(texts)
    n = len(off) - 1
    words, doc = word_array(data, off)
    code = words.dictionary_encode()
    ids = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    space = SPACE[data]
    n_words = per_doc(doc, n)
    distinct = np.unique(doc * (len(code.dictionary) + 1) + ids)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    mark = (data == ord("!")) | (data == ord("?"))
    lines, dups = _lines(data, off, space)
    return {"n_words": n_words, "word_chars": mask_counts(~space & ((data & 0xC0) != 0x80), off),
            "n_symbols": mask_counts(SYMBOLS[data], off), "n_dup_lines": dups,
            "n_repeat_words": _repeat_words(ids, doc, n), "n_upper": mask_counts(upper, off),
            "n_marks": mask_counts(mark, off), "n_digits": mask_counts(digit, off), "n_lines": lines,
            "n_distinct": per_doc(distinct // (len(code.dictionary) + 1), n)}


def _lines(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the text."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # a line starts at each text's first byte and after each break; it ends at a break or at the text's end
    doc_of_break = np.searchsorted(off, breaks, "right") - 1
    first = np.concatenate([off[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), doc_of_break])
    order = np.lexsort((first, doc))
    first, doc = first[order], doc[order]
    last = np.empty_like(first)
    last[:-1] = np.where(doc[1:] == doc[:-1], first[1:] - 1, off[doc[:-1] + 1])
    if len(last):
        last[-1] = off[-1]
    solid = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(~space, out=solid[1:])
    full = solid[last] > solid[first]
    del solid
    keep = np.concatenate([[0], np.cumsum(last - first)])
    compact = binary_array(data[data != 0x0A], keep)
    ids = compact.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    doc = doc[full]
    total = per_doc(doc, n)
    pairs = np.unique(doc * (len(keep) + 1) + ids)
    return total, total - per_doc(pairs // (len(keep) + 1), n)


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words inside five-word windows that occur at least twice in their text."""
    m = len(ids) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    inside = doc[WINDOW - 1:] == doc[:m]
    at = np.flatnonzero(inside)
    key = (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(WINDOW):
        key ^= ids[at + j].astype(np.uint64)
        key *= np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    twin = key[order[1:]] == key[order[:-1]]
    a, b = a[twin], b[twin]
    same = doc[a] == doc[b]  # equal keys are confirmed on the words themselves
    for j in range(WINDOW):
        same &= ids[a + j] == ids[b + j]
    hit = np.unique(np.concatenate([a[same], b[same]]))
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[hit] += 1
    cover[hit + WINDOW] -= 1
    return per_doc(doc[np.cumsum(cover[:-1]) > 0], n)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free rates (rows x FEATURES), so that length alone is never an anomaly."""
    chars, words = np.maximum(s["word_chars"], 1), np.maximum(s["n_words"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.stack([s["n_symbols"] / chars, s["n_upper"] / chars, s["n_marks"] / chars, s["n_digits"] / chars,
                     s["n_dup_lines"] / lines, s["n_repeat_words"] / words], axis=1)


def excess(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How far each rate lies beyond its limit (0 below it)."""
    return np.maximum(x - limit, 0)


@dataclass
class IsolationForest:
    """``trees`` complete binary trees in arrays: feature, split value and, at leaves, the expected path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    sample: int

    @staticmethod
    def _average_path(n: np.ndarray) -> np.ndarray:
        """Mean path of an unsuccessful search in a binary tree of n rows."""
        n = np.maximum(np.asarray(n, float), 1)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7,
            draws: list[np.ndarray] | None = None) -> "IsolationForest":
        """``draws``: the rows of ``x`` that each tree is grown on; by default they are drawn here."""
        rng = np.random.default_rng(seed)
        sample = len(draws[0]) if draws else min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1, np.int16)
        split = np.zeros((trees, nodes))
        length = np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[draws[t] if draws else rng.choice(len(x), sample, replace=False)])]
            while todo:
                node, level, rows = todo.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                free = np.flatnonzero(high > low)
                if level == depth or not len(free):
                    length[t, node] = level + cls._average_path(np.array([len(rows)]))[0]
                    continue
                f = int(rng.choice(free))
                v = rng.uniform(low[f], high[f])
                feature[t, node], split[t, node] = f, v
                left = rows[:, f] <= v
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
        return cls(feature, split, length, depth, sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]; higher is stranger."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > self.split[t, node]))
            total += self.length[t, node]
        scale = max(float(self._average_path(np.array([self.sample]))[0]), 1e-9)
        return 2.0 ** (-total / len(self.feature) / scale)


def calibrate(scores: np.ndarray, good: np.ndarray, max_clean_loss: float) -> float:
    """The cut-off: the score that at most ``max_clean_loss`` of the good rows exceed (ties stay on the kept side).

    Infinite (nothing is rejected) unless both classes are present.
    """
    if not good.any() or good.all():
        return float("inf")
    clean = np.sort(scores[good])
    return float(clean[len(clean) - 1 - int(max_clean_loss * len(clean))])


@dataclass
class QualityModel:
    forest: IsolationForest | None
    cut: float
    limit: np.ndarray | None = None

    def rejects(self, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(anomaly score, verdict) of each row."""
        if self.forest is None:
            zero = np.zeros(len(stats["n_words"]))
            return zero, zero.astype(bool)
        score = self.forest.score(excess(features(stats), self.limit))
        return score, score > self.cut


def _fields(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


STAT_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            s = rule_statistics(column(b, "text"))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()),
                                              *(pa.array(s[c], pa.int64()) for c in STATS)], ["doc_id", *STATS])
    return docs.select("doc_id", "text").mapInArrow(tidy(run), STAT_SCHEMA)


RATES = [f"r{i}" for i in range(len(FEATURES))]
#: Bits that one step of ``order_statistics`` settles; a step counts at most 2 ** STEP_BITS values per column.
STEP_BITS = 13


def _bits(x: np.ndarray) -> np.ndarray:
    """Doubles of 0 and more as whole numbers of the same order, and back by ``view``."""
    return (np.asarray(x, np.float64) + 0.0).view(np.int64)


def order_statistics(df: DataFrame, ranks: dict[str, int]) -> dict[str, int]:
    """The value of each rank (from 0) among all values of a column of longs of 0 and more; exact at any size.

    Five steps, each with one partial aggregate over all columns: the first counts values by their uppermost bits, the
    next ones by the bits that follow among the values that agree with what is settled.
    """
    found, left = dict.fromkeys(ranks, 0), dict(ranks)
    names = list(ranks)
    for shift in range(63 - 63 % STEP_BITS, -1, -STEP_BITS):
        parts = [F.struct(F.lit(i).alias("i"), F.shiftright(c, shift).alias("v"),
                          (F.lit(True) if shift + STEP_BITS > 63 else
                           F.shiftright(c, shift + STEP_BITS) == F.lit(found[c]).cast("long")).alias("on"))
                 for i, c in enumerate(names)]
        rows = df.select(F.explode(F.array(*parts)).alias("p")).where("p.on").groupBy("p.i", "p.v") \
            .agg(F.count(F.lit(1)).alias("n")).orderBy("i", "v").collect()
        for i, c in enumerate(names):
            for r in rows:
                if r["i"] == i:
                    if left[c] < r["n"]:
                        found[c] = r["v"]
                        break
                    left[c] -= r["n"]
    return found


def fit(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, max_clean_loss: float = 0.001,
        seed: int = 7) -> QualityModel:
    """Limits, forest and cut-off from all labelled documents that pass the base rule.

    The texts are read where they are; what is joined with the labels is counts.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id") \
        .agg(F.min("quality").alias("quality"))
    rows = materialise(_rates(document_statistics(docs).join(marked, "doc_id")), "quality-rates")
    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return QualityModel(None, float("inf"))
    rank = int(np.ceil((n[True] - 1) * (1 - max_clean_loss)))
    limits = order_statistics(rows.where("good"), dict.fromkeys(RATES, rank))
    limit = np.array([limits[c] for c in RATES], np.int64).view(np.float64)
    forest = _grown(rows, n[True] + n[False], limit, trees, sample, seed)
    scores = materialise(_scores(rows.where("good"), forest, limit), "quality-scores")
    cut = order_statistics(scores, {"score": n[True] - 1 - int(max_clean_loss * n[True])})["score"]
    return QualityModel(forest, float(np.int64(cut).view(np.float64)), limit)


def _rates(stats: DataFrame) -> DataFrame:
    """doc_id, statistics, good, and the rates as ordered bits, of labelled rows that pass the base rule."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = {c: column(b, c).to_numpy() for c in STATS}
            out = pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *(column(b, c) for c in STATS), pa.array(column(b, "quality").to_numpy() > 0),
                 *(pa.array(_bits(x)) for x in features(s).T)], ["doc_id", *STATS, "good", *RATES])
            yield out.filter(pa.array(~base_failed(s["n_words"], s["n_repeat_words"])))
    return stats.mapInArrow(tidy(run), STAT_SCHEMA + ", good boolean, " + ", ".join(f"{c} long" for c in RATES))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([column(b, c).to_numpy().view(np.float64) for c in RATES], axis=1)


def _grown(rows: DataFrame, n: int, limit: np.ndarray, trees: int, sample: int, seed: int) -> IsolationForest:
    """The forest, each tree on rows drawn from all ``n``. The rows are numbered in the order of their ids and counts, so
    a draw depends on nothing else; those that some tree draws come to the driver, at most ``trees`` x ``sample``."""
    order = ("doc_id", *STATS)
    if n <= trees * sample:
        x = rows.select(*order, *RATES).orderBy(*order).toArrow().combine_chunks()
        return IsolationForest.fit(excess(_matrix(x), limit), trees, sample, seed)
    held = materialise(rows.select(*order, *RATES).repartitionByRange(*order).sortWithinPartitions(*order)
                       .select(F.monotonically_increasing_id().alias("place"), *RATES), "quality-numbered")
    # places count on within a partition and leap from one to the next: one row per partition tells where each begins
    spans = held.groupBy(F.shiftright("place", 33).alias("part")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).orderBy("part").toPandas()
    start = np.cumsum(spans["n"].to_numpy()) - spans["n"].to_numpy()
    rng = np.random.default_rng(seed)
    draws = [rng.choice(n, sample, replace=False) for _ in range(trees)]
    drawn = np.unique(np.concatenate(draws))
    part = np.searchsorted(start, drawn, "right") - 1
    places = spans["first"].to_numpy()[part] + drawn - start[part]
    picked = rows.sparkSession.createDataFrame([(int(p),) for p in places], "place long")
    x = held.join(F.broadcast(picked), "place").orderBy("place").toArrow().combine_chunks()
    return IsolationForest.fit(excess(_matrix(x), limit), trees, sample, seed, [np.searchsorted(drawn, d) for d in draws])


def _scores(rows: DataFrame, forest: IsolationForest, limit: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(forest.score(excess(_matrix(b), limit))))], ["score"])
    return rows.select(*RATES).mapInArrow(tidy(run), "score long")


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


SCORE_SCHEMA = STAT_SCHEMA + ", base_failed boolean, anomaly double, kept boolean"


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Statistics, anomaly score and verdict of every document, in one pass over the texts.

    The fitted trees travel in the task closure: ``trees`` x (2 x ``sample``) nodes, well under 1 MB.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            s = rule_statistics(column(b, "text"))
            base = base_failed(s["n_words"], s["n_repeat_words"])
            score, bad = model.rejects(s)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), *(pa.array(s[c], pa.int64()) for c in STATS), pa.array(base),
                 pa.array(score), pa.array(~base & ~bad)], _fields(SCORE_SCHEMA))
    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCORE_SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that the rules keep, all columns unchanged; each row is judged on its own text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_batches(batches, limit=BATCH_BYTES):
            s = rule_statistics(column(b, "text"))
            keep = ~base_failed(s["n_words"], s["n_repeat_words"]) & ~model.rejects(s)[1]
            yield b.filter(pa.array(keep)).select(names)
    return docs.mapInArrow(tidy(run), docs.schema)
