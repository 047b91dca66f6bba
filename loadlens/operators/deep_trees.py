"""Trees without a depth limit: a forest grown level by level to a cut is grown on until its leaves are pure.

The cut forest gives each training row its leaf in each tree. A leaf whose rows differ in the label is open. Open nodes of
up to ``NODE_ROWS`` rows are dealt to tasks, one group each, and finished there: the best split over all features at every
node, until the labels are equal or no feature tells the rows apart. Larger nodes are first split by level, all at once:
candidate thresholds from mergeable quantiles of the node's own values, sums per (node, feature, bin) as a partial
aggregate, the best bin edge per node. So no task holds more than ``NODE_ROWS`` rows, whatever one node holds; a large node
that no feature splits (copies that differ in the label) ends with the mean of an aggregate.

Below the cut a row's weight in a tree is a Poisson(1) number from its hash and the tree's number (1 if the
forest was fitted without bootstrap), so the result does not depend on partitions. Features are taken as sparse vectors: a value that is not listed is 0.

Not finished: splitting large nodes by level and several trees are not covered by a test yet; ``regression`` does not use this
module.

Edge cases: pure leaves, and leaves that no weighted row reaches, keep the cut forest's value. Without open leaves the
forest stays as it is. An empty frame to predict gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.session import checkpoint_dir

NODE_ROWS = 50_000
BINS = 32
SUBTREE = "node string, feature array<int>, threshold array<double>, below array<int>, value array<double>, gain array<double>"


def poisson_weight(row_hash: Column, tree: Column, seed: int) -> Column:
    """A Poisson(1) number from a hash of seed, tree and row."""
    u = F.pmod(F.xxhash64(F.lit(seed), tree, row_hash), F.lit(1 << 52)) / F.lit(float(1 << 52))
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]).tolist()
    out = F.when(u < edges[0], 0.0)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(u < edge, float(k))
    return out.otherwise(float(len(edges)))


def _value_at(x: str, position: Column) -> Column:
    """The value of a sparse or dense vector (an unwrapped struct) at a position."""
    listed = F.get(F.col(f"{x}.values"), F.array_position(f"{x}.indices", position).cast("int") - 1)
    return F.when(F.col(f"{x}.indices").isNull(), F.get(F.col(f"{x}.values"), position)).otherwise(F.coalesce(listed, F.lit(0.0)))


def _in_leaves(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    """A row per row and tree: the columns, ``x`` (the features), tree and node."""
    leafed = model.copy({model.leafCol: "__leaves"}).transform(rows)
    return leafed.select(*columns, F.unwrap_udt("features").alias("x"),
                         F.posexplode(vector_to_array("__leaves")).alias("tree", "leaf")) \
        .withColumn("node", F.concat("tree", F.lit(":"), F.col("leaf").cast("int"))).drop("leaf")


def _best_splits(rows: DataFrame) -> DataFrame:
    """node, feature, threshold, gain of each node that some feature splits; the smallest feature and threshold of equals."""
    at = F.when(F.col("x.indices").isNull(), F.sequence(F.lit(0), F.size("x.values") - 1)).otherwise(F.col("x.indices"))
    entries = rows.select("node", "w", (F.col("w") * F.col("y")).alias("wy"),
                          F.inline(F.arrays_zip(at.alias("feature"), F.col("x.values").alias("v"))))
    shares = [i / BINS for i in range(1, BINS)]
    cuts = entries.groupBy("node", "feature").agg(F.array_sort(F.array_distinct(F.concat(
        F.percentile_approx("v", shares), F.array(F.min("v"), F.lit(0.0))))).alias("cuts"))
    binned = entries.join(cuts, ["node", "feature"]) \
        .withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v")))) \
        .groupBy("node", "feature", "cuts", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    totals = rows.groupBy("node").agg(F.sum("w").alias("tw"), F.sum(F.col("w") * F.col("y")).alias("twy"))
    rest = binned.groupBy("node", "feature", "cuts").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).join(totals, "node") \
        .filter(F.col("tw") > F.col("w")).select(
            "node", "feature", "cuts", F.size(F.filter("cuts", lambda c: c < 0.0)).alias("bin"),
            (F.col("tw") - F.col("w")).alias("w"), (F.col("twy") - F.col("wy")).alias("wy"))
    bins = binned.unionByName(rest).groupBy("node", "feature", "cuts", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    up_to = Window.partitionBy("node", "feature").orderBy("bin")     # at most BINS + 2 rows
    left = bins.join(totals, "node").withColumn("lw", F.sum("w").over(up_to)).withColumn("lwy", F.sum("wy").over(up_to))
    rw, rwy = F.col("tw") - F.col("lw"), F.col("twy") - F.col("lwy")
    gain = F.col("lwy") * F.col("lwy") / F.col("lw") + rwy * rwy / rw - F.col("twy") * F.col("twy") / F.col("tw")
    found = left.filter((F.col("lw") > 0) & (rw > 0)).select(
        "node", "feature", F.get(F.col("cuts"), F.col("bin")).alias("threshold"), gain.alias("gain"))
    best = F.max_by(F.struct("feature", "threshold", "gain"), F.struct(F.col("gain"), -F.col("feature"), -F.col("threshold")))
    return found.groupBy("node").agg(best.alias("s")).select("node", "s.*")


def _descend(rows: DataFrame, splits: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of split nodes one level down; with a left join, the others stay."""
    side = F.when(_value_at("x", F.col("feature")) <= F.col("threshold"), "L").otherwise("R")
    return rows.join(splits.select("node", "feature", "threshold"), "node", how) \
        .withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat("node", side))).drop("feature", "threshold")


def _entries(x: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of all listed values."""
    values = [np.asarray(r["values"], float) for r in x]
    places = [np.arange(len(v)) if r["indices"] is None else np.asarray(r["indices"], int) for r, v in zip(x, values)]
    row = np.repeat(np.arange(len(x)), [len(v) for v in values])
    return row, np.concatenate(places) if len(x) else row, np.concatenate(values) if len(x) else row.astype(float)


def _cut(w, wy, row, col, val) -> tuple[int, float, float] | None:
    """The best (gain, feature, threshold) of a node; entries in order of feature and value. None: nothing splits it."""
    tw, twy = w.sum(), wy.sum()
    live = np.flatnonzero(w > 0)
    if not len(col) or len(live) < 2:
        return None
    ew, ewy = w[row], wy[row]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    rest = tw - np.add.reduceat(ew, first)
    open_ = rest > 0
    if open_.any():     # rows that do not list the feature have 0
        rest_y = twy - np.add.reduceat(ewy, first)
        c = np.concatenate([col, col[first[open_]]])
        v = np.concatenate([val, np.zeros(open_.sum())])
        order = np.lexsort((v, c))
        col, val = c[order], v[order]
        ew = np.concatenate([ew, rest[open_]])[order]
        ewy = np.concatenate([ewy, rest_y[open_]])[order]
        first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    lw, ly = np.cumsum(ew), np.cumsum(ewy)
    size = np.diff(np.append(first, len(col)))
    lw = lw - np.repeat(lw[first] - ew[first], size)
    ly = ly - np.repeat(ly[first] - ewy[first], size)
    at = np.flatnonzero((col[1:] == col[:-1]) & (val[1:] > val[:-1]))
    if not len(at):
        return None
    gain = ly[at] ** 2 / lw[at] + (twy - ly[at]) ** 2 / (tw - lw[at]) - twy ** 2 / tw
    best = int(np.argmax(gain))
    low, high = val[at[best]], val[at[best] + 1]
    middle = low + (high - low) / 2
    return float(gain[best]), int(col[at[best]]), float(middle if middle < high else low)


def finish_subtree(w: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> list[list]:
    """feature (-1: a leaf), threshold, below (the left child; the right one follows it), value and gain of each node."""
    mean = float(np.average(y, weights=w))
    y = y - mean
    order = np.lexsort((row, val, col))
    out = [[-1, 0.0, -1, 0.0, 0.0]]
    todo = [(0, np.arange(len(y)), row[order], col[order], val[order])]
    side = np.zeros(len(y), bool)
    place = np.zeros(len(y), np.int64)
    while todo:
        k, rows, r, c, v = todo.pop()
        nw, ny = w[rows], y[rows]
        out[k][3] = mean + float((nw * ny).sum() / nw.sum())
        if ny.min() == ny.max():
            out[k][3] = mean + float(ny[0])
            continue
        place[rows] = np.arange(len(rows))
        found = _cut(nw, nw * ny, place[r], c, v)
        if found is None:
            continue
        gain, feature, threshold = found
        side[rows] = 0.0 <= threshold
        own = c == feature
        side[r[own]] = v[own] <= threshold
        out[k][:3], out[k][4] = [feature, threshold, len(out)], gain
        for keep in (True, False):
            mine = side[r] == keep
            todo.append((len(out), rows[side[rows] == keep], r[mine], c[mine], v[mine]))
            out.append([-1, 0.0, -1, 0.0, 0.0])
    return out


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["k1", "k2"], kind="stable", ignore_index=True)
    nodes = finish_subtree(rows["w"].to_numpy(), rows["y"].to_numpy(), *_entries(rows["x"]))
    return pd.DataFrame([[rows["node"][0], *[list(x) for x in zip(*nodes)]]], columns=[c.split()[0] for c in SUBTREE.split(", ")])


def walk(tree: dict, x: pd.Series) -> np.ndarray:
    """The value of each row's leaf in a finished subtree."""
    row, col, val = _entries(x)
    width = int(max(col.max(initial=0), max(tree["feature"]))) + 1
    key = row * width + col
    order = np.argsort(key)
    key, val = key[order], val[order]
    feature, threshold, below, value = (np.asarray(tree[c]) for c in ("feature", "threshold", "below", "value"))
    at = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        wanted = inner * width + feature[at[inner]]
        found = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        v = np.where(key[found] == wanted, val[found], 0.0) if len(key) else np.zeros(len(inner))
        at[inner] = below[at[inner]] + (v > threshold[at[inner]])
    return value[at]


def _walk(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    out = rows[["k1", "k2", "tree"]].copy()
    out["value"] = walk(trees.iloc[0], rows["x"]) if len(rows) else np.zeros(0)
    return out


@dataclass
class DeepForest:
    """A cut forest and what grew below its leaves; all tables stand in the shared folder."""

    model: object
    leaves: DataFrame           # node, value: the cut forest's leaves
    levels: list[DataFrame]     # node, feature, threshold, gain of large nodes, by level
    ends: DataFrame | None      # node, value: nodes that ended while nodes were split by level
    subtrees: DataFrame         # SUBTREE: one row per node finished in a task
    gains: DataFrame            # tree, feature, gain

    def predict(self, rows: DataFrame, keys: tuple[str, str]) -> DataFrame:
        """k1, k2 and prediction: the mean over the trees. Rows are told apart by two 64-bit columns."""
        state = _in_leaves(rows, self.model, [F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2")])
        ended = self.leaves if self.ends is None else self.leaves.unionByName(self.ends)
        for splits in self.levels:
            state = _descend(state, splits, "left")
        state = state.checkpoint()
        # a node's rows go to as many groups as their number asks for, each with the subtree
        sizes = state.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(NODE_ROWS)).cast("int").alias("parts"))
        trees = self.subtrees.join(sizes, "node") \
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        deep = state.join(self.subtrees.select("node"), "node", "left_semi").join(sizes, "node") \
            .withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.col("parts")).cast("int"))
        walked = deep.groupBy("node", "part").cogroup(trees.groupBy("node", "part")) \
            .applyInPandas(_walk, "k1 long, k2 long, tree int, value double")
        flat = state.join(self.subtrees.select("node"), "node", "left_anti").join(ended, "node")
        values = walked.unionByName(flat.select("k1", "k2", "tree", "value"))
        listed = F.array_sort(F.collect_list(F.struct("tree", "value")))     # one entry a tree
        total = F.aggregate(listed, F.lit(0.0), lambda a, t: a + t["value"])
        return values.groupBy("k1", "k2").agg((total / F.size(listed)).alias("prediction"))

    def importances(self) -> DataFrame:
        """position, importance: gains by tree, each tree's sum 1, then over all trees."""
        by_tree = self.gains.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        whole = by_tree.groupBy("tree").agg(F.sum("gain").alias("whole")).filter("whole > 0")
        shares = by_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
        trees = whole.agg(F.count(F.lit(1)).cast("double")).scalar()
        return shares.select(F.col("feature").alias("position"), (F.col("share") / trees).alias("importance"))


def grow_out(rows: DataFrame, label: str, model, keys: tuple[str, str], seed: int = 42,
             node_rows: int = NODE_ROWS) -> DeepForest:
    """Grow a fitted forest on until its leaves are pure. ``rows``: the training rows with ``features``, the label and two
    64-bit columns that tell rows apart (copies of a row too)."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    # leaves are numbered from left to right, as are the nodes of the saved forest; a tree has at most 2^cut of them
    left_first = Window.partitionBy("treeID").orderBy("id")
    leaves = nodes.filter("leftChild < 0").select(
        F.concat("treeID", F.lit(":"), F.row_number().over(left_first) - 1).alias("node"), F.col("prediction").alias("value"))
    gains = nodes.filter("leftChild >= 0").select(
        F.col("treeID").alias("tree"), F.col("split.featureIndex").alias("feature"),
        (F.col("gain") * F.col("impurityStats")[0]).alias("gain"))
    weight = poisson_weight(F.col("k1"), F.col("tree"), seed) if model.getBootstrap() else F.lit(1.0)
    dealt = _in_leaves(rows, model, [F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2"),
                                     F.col(label).cast("double").alias("y")]).withColumn("w", weight).filter("w > 0")

    def sized(some: DataFrame) -> DataFrame:
        return some.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))

    open_ = sized(dealt).filter("low < high").select("node", "n")
    state = dealt.join(open_, "node").checkpoint()
    ready, levels, ends = [], [], []
    while True:
        ready.append(state.filter(F.col("n") <= node_rows))
        big = state.filter(F.col("n") > node_rows).drop("n")
        if big.isEmpty():
            break
        splits = _best_splits(big).checkpoint()
        levels.append(splits)
        stuck = big.join(splits.select("node"), "node", "left_anti")
        ends.append(stuck.groupBy("node").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value")))
        moved = _descend(big, splits)
        sizes = sized(moved).checkpoint()
        ends.append(sizes.filter("low >= high").select("node", F.col("low").alias("value")))
        state = moved.join(sizes.filter("low < high").select("node", "n"), "node").checkpoint()
    small = ready[0]
    for more in ready[1:]:
        small = small.unionByName(more)
    subtrees = small.select("node", "k1", "k2", "y", "w", "x").groupBy("node").applyInPandas(_finish, SUBTREE).checkpoint()
    ended = None
    for e in ends:
        ended = e if ended is None else ended.unionByName(e)
    tree = F.split_part("node", F.lit(":"), F.lit(1)).cast("int")
    gains = gains.unionByName(subtrees.select(tree.alias("tree"), F.inline(F.arrays_zip("feature", "gain"))).filter("feature >= 0"))
    for splits in levels:
        gains = gains.unionByName(splits.select(tree.alias("tree"), "feature", "gain"))
    return DeepForest(model, leaves.checkpoint(), levels, None if ended is None else ended.checkpoint(), subtrees, gains)
