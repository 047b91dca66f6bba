"""Spark's random-forest regression grown over cells instead of rows.

The forest's own binning (at most ``MAX_BINS`` bins of a numeric feature, one category of a text feature) gives each row a
cell. All that a tree asks of its rows is the sums of weight, weighted label and weighted squared label per cell: they are
taken once, each row drawing its weight in each tree, and every level of a tree is grown on them. The number of cells is
bounded by the product of the bins, so the cost per level stops growing with the rows; a row costs one draw per tree.

Cells are used where the rows are at least ``ROWS_PER_CELL`` times as many (``plan`` returns None otherwise, and the
caller fits Spark's forest on the rows). Splits, gains, ties and leaves follow Spark's rules, thresholds come from a sample
of as many rows as Spark takes, and the trees are handed over as a ``RandomForestRegressionModel``.

A row's weight in a tree is a Poisson(1) number from its hash, so the result depends neither on partitions nor on their
order. Rows are dealt by cell, those of a cell with more than a task's share over several tasks. A task holds a block of
rows times trees; a task that grows a tree holds the sums of all cells (at most ``MAX_CELLS``).

Edge cases: a missing or infinite label is an error, as in Spark. A feature with one value has no bin edge and never splits.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.encoding import BROADCAST_BYTES
from loadlens.session import checkpoint_dir

MAX_BINS = 32
SAMPLE_ROWS = 10_000            # for thresholds; Spark's max(bins^2, 10,000)
ROWS_PER_CELL = 16
MAX_CELLS = 1 << 20
TASK_ROWS = 250_000             # and no more of one cell
BLOCK = 1 << 18                 # rows x trees drawn at a time
HELD = 1 << 20                  # cells x trees kept before they are handed on
NODES_AT_ONCE = 1 << 14         # of a level, in a table of nodes and bins
CELL_BYTES = 64                 # of a cell and its prediction in a broadcast
HASH_BITS = 60
EPSILON = 2.0 ** -52
SUMS = "tree int, cell binary, w binary, wy binary, wyy binary"
NODES = ("tree int, id int, prediction double, impurity double, w double, wy double, wyy double, gain double, "
         "below int, feature int, threshold double, category double")


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between the sampled values of a feature: all midpoints, or those nearest to equal shares (Spark's rule)."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0 + 0.0      # no negative zero
    if len(middle) < bins:
        return np.unique(middle)
    upto = np.cumsum(counts)
    stride = len(values) / bins
    target, edges = stride, []
    for i in range(len(middle)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            edges.append(middle[i])
            target += stride
    return np.unique(edges)


@dataclass
class Cells:
    """How a cell's number is made of bins and categories (the last one fastest), and the training rows as (cell, y, hash)."""

    edges: list[np.ndarray]     # per numeric feature
    sizes: list[int]            # categories of each text feature
    n_rows: int = 0
    rows: DataFrame | None = None
    hot: dict[int, int] = field(default_factory=dict)   # cells of more than a task's rows: over how many tasks

    @property
    def radix(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [s + 1 for s in self.sizes]

    def marked(self, rows: DataFrame, numeric: Sequence[Column], slots: Sequence[str]) -> DataFrame:
        """The rows with their cell, whether training has it or not, and their numeric features as ``__v0``, ``__v1`` ..."""
        rows = rows.withColumns({f"__v{j}": c for j, c in enumerate(numeric)})
        cut = [j for j, e in enumerate(self.edges) if len(e)]
        if cut:     # a bucket has its lower end, a bin its upper one: the negated value's bucket, counted from above
            rows = rows.withColumns({f"__minus{j}": -F.col(f"__v{j}") for j in cut})
            rows = Bucketizer(splitsArray=[[-math.inf, *(-self.edges[j][::-1]).tolist(), math.inf] for j in cut],
                              inputCols=[f"__minus{j}" for j in cut], outputCols=[f"__bin{j}" for j in cut]).transform(rows)
        bins = [F.lit(len(e)) - F.col(f"__bin{j}").cast("long") if len(e) else F.lit(0) for j, e in enumerate(self.edges)]
        cell = F.lit(0).cast("long")
        for p, r in zip([*bins, *[F.col(c).cast("long") for c in slots]], self.radix):
            cell = cell * F.lit(r) + p
        return rows.withColumn("__cell", cell)

    def split(self, cell: np.ndarray) -> list[np.ndarray]:
        """Bin or category of each cell, per column."""
        out = []
        for r in reversed(self.radix):
            out.append((cell % r).astype(np.int64))
            cell = cell // r
        return out[::-1]


def plan(rows: DataFrame, label: str, numeric: Sequence[Column], sizes: Mapping[str, int], row_hash: str,
         n_rows: int) -> Cells | None:
    """The cells of encoded training rows, or None where they would not be far fewer than the rows.

    ``numeric``: the numeric features; ``sizes``: the columns with the slots of text features and their numbers of
    categories; ``row_hash``: a number of HASH_BITS bits."""
    edges = []
    if numeric:
        share = min(1.0, max(MAX_BINS * MAX_BINS, SAMPLE_ROWS) / n_rows)
        some = rows.filter(F.col(row_hash) < int(share * (1 << HASH_BITS)))
        sample = some.select(*[c.alias(f"v{j}") for j, c in enumerate(numeric)]).toPandas()     # bounded: SAMPLE_ROWS or so
        if sample.isna().to_numpy().any():      # an infinite value leaves no deviation to scale by
            return None
        edges = [thresholds(sample[f"v{j}"].to_numpy(float), min(MAX_BINS, n_rows)) for j in range(len(numeric))]
    out = Cells(edges, list(sizes.values()), n_rows)
    if math.prod(out.radix) >= 1 << 62:
        return None
    y = F.col(label).cast("double")
    wrong = F.raise_error(F.lit("Labels MUST NOT be Null, NaN or Infinity")).cast("double")
    out.rows = out.marked(rows, numeric, list(sizes)) \
        .select(F.col("__cell").alias("cell"), F.when(y.isNull() | F.isnan(y) | (F.abs(y) == math.inf), wrong).otherwise(y).alias("y"),
                F.col(row_hash).alias("hash"))
    counts = out.rows.groupBy("cell").agg(F.count("y").alias("n"))
    busy = F.when(F.col("n") > TASK_ROWS, F.struct("cell", "n"))
    found = counts.agg(F.count(F.lit(1)).alias("cells"), F.collect_list(busy).alias("hot")).first()   # hot: at most n_rows / TASK_ROWS
    if found["cells"] > MAX_CELLS or found["cells"] * ROWS_PER_CELL > n_rows:
        return None
    out.hot = {h["cell"]: -(-h["n"] // TASK_ROWS) for h in found["hot"]}
    return out


def _mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, in place."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


@cache
def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Limits of a 32-bit draw, and the number by its upper 16 bits (255: a limit lies among the lower ones)."""
    shares = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(13)])
    limits = np.minimum(np.round(shares * 2.0 ** 32), 2.0 ** 32 - 1).astype(np.uint32)
    low = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
    a, b = (np.searchsorted(limits, x, "right") for x in (low, low | np.uint32(0xFFFF)))
    return limits, np.where(a == b, a, 255).astype(np.uint8)


def poisson_weights(row_hash: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers, rows x trees, from the rows' hashes: two 32-bit draws from each word of a counter."""
    limits, table = _poisson_table()
    with np.errstate(over="ignore"):
        start = _mixed(row_hash.astype(np.uint64) + _mixed(np.array([seed], np.uint64)))
        steps = np.arange(1, -(-trees // 2) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        draws = _mixed(start[:, None] + steps[None, :]).view(np.uint32).ravel()
    out = table[draws >> np.uint32(16)]
    odd = np.flatnonzero(out == 255)
    out[odd] = np.searchsorted(limits, draws[odd], "right")
    return out.reshape(len(row_hash), 2 * len(steps))[:, :trees]


def _sums(cell: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct cells of a sorted array and their sums of the rows of each part."""
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], *[np.add.reduceat(p, first, axis=0) for p in parts]


def _bagged(batches: Iterator[pa.RecordBatch], trees: int, seed: int, bootstrap: bool) -> Iterator[pa.RecordBatch]:
    """Per tree the sums of a task's cells."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        cell, *sums = _sums(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        w, wy, wyy = (np.ascontiguousarray(s.T) for s in sums)
        some = [np.flatnonzero(x) for x in w]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(trees), pa.int32()), pa.array([cell[s].tobytes() for s in some], pa.binary()),
             *[pa.array([x[s].tobytes() for x, s in zip(m, some)], pa.binary()) for m in (w, wy, wyy)]],
            names=[c.split()[0] for c in SUMS.split(", ")])

    rows = [[b.column(c).to_numpy() for c in ("cell", "y", "hash")] for b in batches]
    if not rows:
        return
    cells, ys, hashes = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((ys, hashes, cells))      # rows come in any order
    step = max(1, BLOCK // trees)
    for at in range(0, len(order), step):
        cell, y, h = (a[order[at:at + step]] for a in (cells, ys, hashes))
        w = poisson_weights(h, trees, seed).astype(float) if bootstrap else np.ones((len(cell), trees))
        wy = w * y[:, None]
        held.append(_sums(cell, w, wy, wy * y[:, None]))
        if sum(len(x[0]) for x in held) * trees > HELD:
            yield from flush()
    yield from flush()


def _histogram(key: np.ndarray, size: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, in order, and the sums (3 x keys)."""
    if size <= 8 * len(key) + 1024:
        found, at = np.arange(size), key
    else:
        found, at = np.unique(key, return_inverse=True)
    return found, np.stack([np.bincount(at, s, len(found)) for s in sums])


def _variance(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] > 0, (s[2] - s[1] * s[1] / s[0]) / s[0], 0.0)


def _gain(total: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Spark's gain of splits; -inf where a side has no row or the gain is negative."""
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _variance(total) - left[0] / total[0] * _variance(left) - right[0] / total[0] * _variance(right)
    return np.where((left[0] >= 1) & (right[0] >= 1) & (gain >= 0), gain, -np.inf)


def grow(cells: Cells, cell: np.ndarray, sums: np.ndarray, max_depth: int) -> pd.DataFrame:
    """One tree from the sums (3 x cells) of distinct cells, level by level. A node's children follow each other (``below``
    is the left one's number); a split has a threshold, or the category (0: not this slot, 1: this slot) that goes left."""
    columns = cells.split(cell)
    n_numeric = len(cells.edges)
    starts = n_numeric + np.concatenate([[0], np.cumsum(cells.sizes)]).astype(int)
    out = []
    totals = sums.sum(axis=1)[:, None]
    node = np.zeros(len(cell), np.int64)    # among the nodes of the level
    open_ = np.array([True])
    first = 0
    for depth in range(max_depth + 1):
        n = totals.shape[1]
        impurity = _variance(totals)
        gain, column, at = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        kept = np.flatnonzero(open_[node]) if depth < max_depth else np.array([], int)
        node, sums, columns = node[kept], sums[:, kept], [c[kept] for c in columns]
        for j, values in enumerate(columns):
            r = cells.radix[j]
            if r < 2 or not len(node):
                continue
            key, hist = _histogram(node * r + values, n * r, sums)
            if j < n_numeric:
                best, place = np.full(n, -np.inf), np.zeros(n, np.int64)
                for low in range(0, n, NODES_AT_ONCE):
                    some = slice(low, min(n, low + NODES_AT_ONCE))
                    mine = (key >= low * r) & (key < some.stop * r)
                    dense = np.zeros((3, (some.stop - low) * r))
                    dense[:, key[mine] - low * r] = hist[:, mine]
                    left = np.cumsum(dense.reshape(3, -1, r), axis=2)[:, :, :-1]
                    found = _gain(totals[:, some, None], left)
                    place[some] = found.argmax(axis=1)
                    best[some] = found.max(axis=1)
            else:
                real = key % r < r - 1      # the last one is that of unseen categories: no slot
                key, hist = key[real], hist[:, real]
                owner = key // r
                rest = totals[:, owner] - hist
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = _gain(totals[:, owner], np.where(hist[1] / hist[0] < rest[1] / rest[0], hist, rest))
                order = np.lexsort((key, -found, owner))
                lead = order[np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))] if len(order) else order
                best, place = np.full(n, -np.inf), np.zeros(n, np.int64)
                best[owner[lead]], place[owner[lead]] = found[lead], key[lead] % r
            better = best > gain
            gain[better], column[better], at[better] = best[better], j, place[better]
        inner = open_ & (gain > 0)
        # sums of the side that the split's own test gives (bins up to the edge, or this slot)
        test = np.zeros(len(node), bool)
        for j, values in enumerate(columns):
            mine = column[node] == j
            test[mine] = values[mine] <= at[node[mine]] if j < n_numeric else values[mine] == at[node[mine]]
        yes = np.stack([np.bincount(node[test], s[test], n) for s in sums])
        no = totals - yes
        with np.errstate(divide="ignore", invalid="ignore"):
            # of a slot the category with the smaller mean goes left; equal means: the rows without it
            slot_left = (column >= n_numeric) & (yes[1] / yes[0] < no[1] / no[0])
            swap = (column >= n_numeric) & ~slot_left
            prediction = np.where(totals[0] > 0, totals[1] / totals[0], 0.0)
        left, right = np.where(swap, no, yes), np.where(swap, yes, no)
        goes_left = test != swap[node]
        below = np.full(n, -1)
        below[inner] = first + n + 2 * np.arange(inner.sum())
        numeric_split = inner & (column < n_numeric)
        edge = np.zeros(n)
        edge[numeric_split] = [cells.edges[c][a] for c, a in zip(column[numeric_split], at[numeric_split])]
        slot = np.where(column >= n_numeric, starts[np.maximum(column - n_numeric, 0)] + at, column)
        out.append(pd.DataFrame({
            "id": np.arange(first, first + n), "prediction": prediction, "impurity": impurity, "w": totals[0], "wy": totals[1],
            "wyy": totals[2], "gain": np.where(inner, gain, -1.0), "below": below, "feature": np.where(inner, slot, -1),
            "threshold": edge, "category": np.where(inner & ~numeric_split, np.where(slot_left, 1.0, 0.0), -1.0)}))
        first += n
        if not inner.any():
            break
        # cells of split nodes move to the children
        rank = np.cumsum(inner) - 1
        moved = inner[node]
        node, goes_left, sums, columns = node[moved], goes_left[moved], sums[:, moved], [c[moved] for c in columns]
        node = 2 * rank[node] + ~goes_left
        totals = np.stack([left[:, inner], right[:, inner]], axis=2).reshape(3, -1)
        open_ = np.abs(_variance(totals)) >= EPSILON
    return pd.concat(out, ignore_index=True)


def _tree(parts: pd.DataFrame, cells: Cells, max_depth: int) -> pd.DataFrame:
    cell = np.concatenate([np.frombuffer(x, np.int64) for x in parts["cell"]])
    sums = [np.concatenate([np.frombuffer(x) for x in parts[c]]) for c in ("w", "wy", "wyy")]
    order = np.lexsort((sums[2], sums[1], sums[0], cell))       # parts of a cell come in any order
    cell, *sums = _sums(cell[order], *[s[order] for s in sums])
    nodes = grow(cells, cell, np.stack(sums), max_depth)
    nodes.insert(0, "tree", parts["tree"].iloc[0])
    return nodes


def fit(cells: Cells, learner: RandomForestRegressor, n_features: int) -> RandomForestRegressionModel:
    """The forest that ``learner`` describes (variance, all features, its bootstrap and seed) on the rows of the cells."""
    trees, depth, seed = learner.getNumTrees(), learner.getMaxDepth(), learner.getSeed()
    bootstrap = learner.getBootstrap()
    shape = Cells(cells.edges, cells.sizes)
    tasks = -(-cells.n_rows // TASK_ROWS)
    salt = F.lit(0)
    if cells.hot:
        over = F.create_map(*[F.lit(x) for pair in cells.hot.items() for x in pair])
        salt = F.pmod(F.xxhash64("hash"), F.coalesce(over[F.col("cell")], F.lit(1)))
    dealt = cells.rows.repartition(tasks, "cell", salt)
    sums = dealt.mapInArrow(lambda batches: _bagged(batches, trees, seed, bootstrap), SUMS)
    nodes = sums.groupBy("tree").applyInPandas(lambda parts: _tree(parts, shape, depth), NODES)
    return _model(nodes, learner, n_features)


def predict(cells: Cells, rows: DataFrame, numeric: Sequence[Column], slots: Sequence[str], vector: str,
            model: PipelineModel) -> tuple[DataFrame, bool]:
    """The rows with their prediction, and whether they stayed where they were. All rows of a cell have the same one, since
    trees split at its edges: ``model`` (from the vector ``vector`` of numeric features and the slots on) sees one row a cell.
    """
    marked = cells.marked(rows, numeric, slots)
    one = marked.groupBy("__cell").agg(*[F.max(c).alias(c) for c in [*[f"__v{j}" for j in range(len(numeric))], *slots]])
    if numeric:
        one = one.withColumn(vector, array_to_vector(F.array(*[F.col(f"__v{j}") for j in range(len(numeric))])))
        one = VectorSizeHint(inputCol=vector, size=len(numeric), handleInvalid="optimistic").transform(one)
    values = model.transform(one).select("__cell", "prediction").checkpoint()
    small = values.count() * CELL_BYTES <= BROADCAST_BYTES
    return marked.join(F.broadcast(values) if small else values, "__cell").drop("__cell"), small


def _model(nodes: DataFrame, learner: RandomForestRegressor, n_features: int) -> RandomForestRegressionModel:
    """Spark's model of grown trees, by the form in which Spark saves one."""
    spark = nodes.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/cell-forest-{uuid.uuid4().hex}"
    edge = F.when(F.col("feature") < 0, F.array().cast("array<double>")) \
        .otherwise(F.array(F.when(F.col("category") < 0, F.col("threshold")).otherwise(F.col("category"))))
    right = F.when(F.col("below") < 0, -1).otherwise(F.col("below") + 1)
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.array("w", "wy", "wyy").alias("impurityStats"), F.col("w").cast("long").alias("rawCount"),
        "gain", F.col("below").alias("leftChild"), right.alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), edge.alias("leftCategoriesOrThreshold"),
                 F.when(F.col("category") < 0, -1).otherwise(2).alias("numCategories")).alias("split")).alias("nodeData")) \
        .write.parquet(f"{folder}/data")

    def described(kind: str, uid: str, without: Sequence[str] = (), **more) -> str:
        maps = [{p.name: v for p, v in m.items() if p.name not in without} for m in (learner._paramMap, learner._defaultParamMap)]
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": uid, "paramMap": maps[0], "defaultParamMap": maps[1], **more})

    n = learner.getNumTrees()
    own = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")    # the forest's, not a tree's
    one = [described("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", own) for _ in range(n)]
    by_tree = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("_1"),
                                             F.get(F.array(*map(F.lit, one)), F.col("id")).alias("_2"), F.lit(1.0).alias("_3"))
    by_tree.write.parquet(f"{folder}/treesMetadata")
    whole = described("RandomForestRegressionModel", learner.uid, numFeatures=n_features, numTrees=n)
    spark.range(0, 1, 1, 1).select(F.lit(whole).alias("value")).write.text(f"{folder}/metadata")
    return RandomForestRegressionModel.load(folder)
