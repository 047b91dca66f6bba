"""Trees grown on below their cut: purity, gains, best split. Splitting large nodes by level has no test yet."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from loadlens.operators import deep_trees
from loadlens.operators.deep_trees import grow_out

KEYS = ("k1", "k2")


def frame(spark, x, y, parts=3):
    """Rows (k1, k2, y, features) of numpy arrays."""
    df = spark.createDataFrame([(i, 7, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))],
                               ["k1", "k2", "y", *[f"x{j}" for j in range(x.shape[1])]]).repartition(parts)
    return VectorAssembler(inputCols=[f"x{j}" for j in range(x.shape[1])], outputCol="features").transform(df)


def fit(rows, depth=3, trees=1):
    return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=1,
                                 featureSubsetStrategy="all", bootstrap=trees > 1).fit(rows)


def predicted(grown, rows):
    return {r["k1"]: r["prediction"] for r in grown.predict(rows, KEYS).collect()}


@pytest.fixture(scope="module")
def steps(spark):
    """A target that takes another value at each of 1,500 places: more than ten levels."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.permutation(1500), rng.integers(0, 3, 1500)])
    y = np.round(rng.normal(size=1500)[x[:, 0]] * 100)
    return x, y


def test_one_tree_is_fitted_to_purity(spark, steps):
    x, y = steps
    rows = frame(spark, x, y)
    grown = grow_out(rows, "y", fit(rows), KEYS)
    assert not grown.levels
    got = predicted(grown, rows)
    assert len(got) == 1500 and all(got[i] == pytest.approx(y[i], abs=1e-9) for i in range(1500))
    imp = {r["position"]: r["importance"] for r in grown.importances().collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp[0] > 0.9
    # the gains of a tree with pure leaves are the target's whole squared deviation
    assert grown.gains.agg(F.sum("gain")).first()[0] == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9)
    depth, at = 0, {0: 0}
    for r in grown.subtrees.collect():
        for k, b in enumerate(r["below"]):
            at = {0: 0} if k == 0 else at
            if b >= 0:
                at[b] = at[b + 1] = at[k] + 1
        depth = max(depth, max(at.values()))
    assert 3 + depth > 10


def test_best_split_by_brute_force():
    """The best split of a node equals that of all (feature, edge) pairs on the dense matrix."""
    rng = np.random.default_rng(9)
    x = np.where(rng.random((120, 30)) < 0.1, rng.integers(-3, 4, (120, 30)), 0).astype(float)
    y = rng.normal(size=120)
    w = rng.integers(1, 4, 120).astype(float)
    row, col = np.nonzero(x)
    nodes = deep_trees.finish_subtree(w, y, row, col, x[row, col])
    scores = []
    for f in range(30):
        for t in np.unique(x[:, f])[:-1]:
            go = x[:, f] <= t
            scores.append((sum(w[g].sum() * np.average(y[g], weights=w[g]) ** 2 for g in (go, ~go)), f))
    assert nodes[0][4] + w.sum() * np.average(y, weights=w) ** 2 == pytest.approx(max(scores)[0]) and nodes[0][0] == max(scores)[1]
