"""The forest grown over cells: Spark's trees, the rows' own weights, hot cells, predictions by cell, and the copy keys."""

import hashlib
import math
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from loadlens.operators import cell_forest, regression

FEATURES = ["a", "b", "t", "u"]


def draw(k, n):
    return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))


def frame(spark, n=12_000):
    """Two numbers of few values, two text columns, one of them with nulls, and a noisy target whose sums are exact."""
    a, b, t = draw(1, 10).cast("double"), draw(2, 7) * 1.5 - 3, F.concat(F.lit("k"), draw(3, 3))
    y = a * b + F.when(t == "k2", 5.0).otherwise(0.0) + draw(6, 512) / 64.0
    return spark.range(n).select("id", a.alias("a"), F.when(draw(7, 50) > 0, b).alias("b"), t.alias("t"),
                                 F.when(draw(4, 3) > 0, F.concat(F.lit("u"), draw(5, 2))).alias("u"), y.cast("double").alias("y"))


def test_rows_of_few_cells_do_not_reach_the_row_learner(spark, monkeypatch):
    """Before, each row went through each tree on each level."""
    def fail(self, rows):
        raise AssertionError("fitted on rows")

    monkeypatch.setattr(RandomForestRegressor, "_fit", fail)
    run = regression.fit_forest(frame(spark, 20_000), "y", FEATURES, num_trees=20, max_depth=8)
    m = regression.metrics(run).first()
    assert m["r2"] > 0.9 and m["n_test"] + m["n_train"] == 20_000
    assert len(run.model.stages[-1].trees) == 20
    assert regression.importances(run).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_trees_equal_the_row_learners(spark, monkeypatch):
    """Without bootstrap both ways have the same rows in every tree: nodes, splits, leaves and outputs are the same."""
    monkeypatch.setattr(regression, "RandomForestRegressor", partial(RandomForestRegressor, bootstrap=False))
    out = []
    for per_cell in (1, 10**9):
        monkeypatch.setattr(cell_forest, "ROWS_PER_CELL", per_cell)
        run = regression.fit_forest(frame(spark), "y", FEATURES, num_trees=2, max_depth=7)
        out.append((run.model.stages[-1].toDebugString.split("\n")[1:], regression.importances(run, top=None).collect(),
                    regression.actual_vs_predicted_sample(run).collect()))
    cells, rows = out
    assert cells[0] == rows[0] and len(cells[0]) > 200
    assert [r["feature"] for r in cells[1]] == [r["feature"] for r in rows[1]]
    assert [r["importance"] for r in cells[1]] == pytest.approx([r["importance"] for r in rows[1]], rel=1e-9)
    assert np.allclose(cells[2], rows[2], rtol=1e-12)


def test_predictions_by_cell_equal_those_by_row(spark):
    run = regression.fit_forest(frame(spark, 20_000), "y", FEATURES, num_trees=5, max_depth=8)
    key = regression.ROW_HASH
    direct = {r[key]: r["prediction"] for r in run.model.transform(run.test).select(key, "prediction").collect()}
    assert {r[key]: r["prediction"] for r in run.predictions.select(key, "prediction").collect()} == direct


def test_tasks_and_layout_do_not_change_the_forest(spark, monkeypatch):
    """A cell of more than a task's rows goes to several; the weights come from the rows themselves."""
    df = frame(spark, 20_000).withColumn("a", F.when(F.col("id") % 10 < 7, 3.0).otherwise(F.col("a"))) \
        .withColumn("t", F.when(F.col("id") % 10 < 7, F.lit("k1")).otherwise(F.col("t")))
    got = []
    for task_rows, rows in ((cell_forest.TASK_ROWS, df), (500, df.repartition(6))):
        monkeypatch.setattr(cell_forest, "TASK_ROWS", task_rows)
        run = regression.fit_forest(rows, "y", FEATURES, num_trees=6, max_depth=6)
        got.append(sorted(tuple(r) for r in run.predictions.select(regression.ROW_HASH, "prediction").collect()))
    assert [h for h, _ in got[0]] == [h for h, _ in got[1]]
    assert np.allclose([p for _, p in got[0]], [p for _, p in got[1]], rtol=1e-9)


def test_rows_that_share_no_cells_are_fitted_as_rows(spark):
    encoded = frame(spark, 2000).select((F.col("id") * 1.0).alias("x"), "y", F.xxhash64("id").alias("h"),
                                        F.lit(0).alias("i"))
    key = F.pmod("h", F.lit(1 << 60))
    rows = encoded.withColumn("h", key)
    assert cell_forest.plan(rows, "y", [F.col("x")], {"i": 1}, "h", 2000) is not None      # 32 bins
    wide = [F.pmod(F.xxhash64("x", F.lit(k)), F.lit(1000)) * 1.0 for k in range(4)]
    assert cell_forest.plan(rows, "y", wide, {}, "h", 2000) is None
    assert cell_forest.plan(rows, "y", [F.col("x")] * 13, {}, "h", 2000) is None           # numbers beyond 62 bits


def test_a_missing_label_is_an_error(spark):
    df = frame(spark, 3000).withColumn("y", F.when(F.col("id") % 100 > 0, F.col("y")).otherwise(float("nan")))
    with pytest.raises(Exception, match="Labels MUST NOT be"):
        regression.fit_forest(df, "y", FEATURES, num_trees=2, max_depth=3)


def test_weights_are_poisson_numbers_of_the_row():
    h = np.random.default_rng(1).integers(0, 1 << 60, 20_000)
    w = cell_forest.poisson_weights(h, 51, 42)
    assert w.shape == (20_000, 51)
    shares = np.bincount(w.ravel(), minlength=12) / w.size
    for k in range(6):
        assert shares[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.002)
    assert np.abs(np.corrcoef(w.T) - np.eye(51)).max() < 0.04
    assert np.array_equal(cell_forest.poisson_weights(h[::-1], 51, 42), w[::-1])
    assert not np.array_equal(cell_forest.poisson_weights(h, 51, 43), w)


def test_edges_bound_the_bins_and_keep_values_apart():
    assert cell_forest.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert cell_forest.thresholds(np.array([5.0]), 32).tolist() == []
    many = cell_forest.thresholds(np.random.default_rng(2).normal(size=10_000), 32)
    assert len(many) == 31 and (np.diff(many) > 0).all()


def test_bins_have_their_upper_edge(spark):
    """A value on an edge goes left, as in a tree's test."""
    cells = cell_forest.Cells([np.array([-1.5, 0.0, 2.0])], [])
    values = [-9.0, -1.5, -1.4, -0.0, 0.0, 1e-300, 2.0, 2.1, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    got = [r["__cell"] for r in cells.marked(df, [F.col("x")], []).collect()]
    assert got == [sum(e < v for e in (-1.5, 0.0, 2.0)) for v in values]


def test_equal_texts_share_their_copy_key(spark):
    """Separators and marks of missing values in the cells: rows of one text are numbered as copies."""
    data = [("a\x1fb", "c", 1), ("a", "b\x1fc", 1), (None, "x", 2), ("\x1e", "x", 2), ("q", None, None), ("q", None, None),
            ("s", "s", 3), ("a", "1\x1f2", 5), ("a\x1f1", "2", 5)]
    df = spark.createDataFrame(data, "s string, t string, n int").repartition(3)
    seen, want = Counter(), []
    for row in data:
        text = "\x1f".join(["42", *("\x1e" if v is None else str(v) for v in row)])
        plain = hashlib.md5(text.encode()).hexdigest()
        seen[plain] += 1
        want.append(int(hashlib.md5(f"{plain}:{seen[plain]}".encode()).hexdigest()[:15], 16))
    assert sorted(r[regression.ROW_HASH] for r in regression.with_row_hash(df).collect()) == sorted(want)
