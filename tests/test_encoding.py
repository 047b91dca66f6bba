"""The distributed dictionary of labels against the driver-side indexer."""

import random

import pytest
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import functions as F

from loadlens.operators import encoding, regression


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "a string, `b c` string, n long").repartition(parts)


def random_rows(n=3000, seed=3):
    rng = random.Random(seed)
    hot = ["hot"] * 1000
    return [(rng.choice([*hot, None, *(f"v{rng.randrange(700)}" for _ in range(1500))]),
             rng.choice(["x", "y", " ", "ü", None]), i) for i in range(n)]


def test_slots_equal_the_indexer(spark):
    df = frame(spark, random_rows())
    slots = encoding.label_slots(df, ["a", "b c"])
    got = {}
    for r in slots.collect():
        got.setdefault(r["feature"], {})[r["slot"]] = r["value"]
    for c in ("a", "b c"):
        labels = StringIndexer(inputCol=c, outputCol="i", handleInvalid="skip").fit(df).labels
        assert [got[c][i] for i in range(len(labels))] == labels and len(got[c]) == len(labels)
    assert encoding.category_counts(slots, ["a", "b c"]) == {c: len(v) for c, v in got.items()}


@pytest.mark.parametrize("small", [True, False])
def test_vectors_equal_the_indexer(spark, small):
    """Unknown and missing labels are all zeros; both ways of joining give the same vectors."""
    df, new = frame(spark, random_rows()), frame(spark, [("hot", "x", 1), ("never", None, 2), (None, "zz", 3)])
    slots = encoding.label_slots(df, ["a", "b c"])
    sizes = encoding.category_counts(slots, ["a", "b c"])
    mine, mine_new = (encoding.with_slots(x, slots, sizes, small=small) for x in (df, new))
    enc = OneHotEncoder(inputCols=["a__idx", "b c__idx"], outputCols=["va", "vb"], dropLast=True).fit(mine)
    got = {(r["n"], t): (r["va"], r["vb"]) for t, x in (("old", mine), ("new", mine_new)) for r in enc.transform(x).collect()}
    indexer = StringIndexer(inputCols=["a", "b c"], outputCols=["ia", "ib"], handleInvalid="keep").fit(df)
    ref = OneHotEncoder(inputCols=["ia", "ib"], outputCols=["va", "vb"], dropLast=True).fit(indexer.transform(df))
    want = {(r["n"], t): (r["va"], r["vb"]) for t, x in (("old", df), ("new", new))
            for r in ref.transform(indexer.transform(x)).collect()}
    assert got == want


def test_many_labels_are_numbered_across_ranges(spark):
    df = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id") % 60_000).alias("a"))
    slots = encoding.label_slots(df, ["a"])
    r = slots.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot")).first()
    assert tuple(r) == (60_000, 60_000, 0, 59_999)
    first = slots.where("slot < 3").orderBy("slot").select("value", "n").collect()
    assert [tuple(x) for x in first] == [("k0", 4), ("k1", 4), ("k10", 4)]


def test_no_labels(spark):
    df = frame(spark, [(None, None, 1)], 1)
    slots = encoding.label_slots(df, ["a", "b c"])
    assert slots.count() == 0 and encoding.category_counts(slots, ["a"]) == {"a": 0}
    assert encoding.with_slots(df, slots, {"a": 0}).first()["a__idx"] == 0.0


def test_forest_with_a_large_dictionary(spark, monkeypatch):
    """The shuffle join gives the same forest as the broadcast join."""
    df = spark.range(0, 900).select((F.col("id") % 30).cast("string").alias("t"), (F.col("id") % 7).cast("double").alias("x"),
                                    ((F.col("id") % 30) * 3 + F.col("id") % 7).cast("double").alias("y"))
    out = []
    for bound in (encoding.BROADCAST_BYTES, 0):
        monkeypatch.setattr(encoding, "BROADCAST_BYTES", bound)
        run = regression.fit_forest(df, "y", num_trees=3, max_depth=4)
        out.append((run.predictions.orderBy(regression.ROW_HASH).select("y", "prediction").collect(),
                    regression.importances(run, top=None).collect()))
    assert out[0] == out[1]
