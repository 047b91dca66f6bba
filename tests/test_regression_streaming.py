"""Regression job (metric bounds, determinism) and the streaming hourly trend."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from loadlens.operators import regression
from loadlens.operators.timeseries import hourly_mean
from loadlens.streaming import hourly as stream


@pytest.fixture(scope="module")
def run(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return regression.fit_forest(li, "l_extendedprice", feats, num_trees=10, max_depth=5)


def flags(df, seed=42):
    hashed = regression.with_row_hash(df, seed)
    return sorted(tuple(r) for r in hashed.select(*df.columns, regression.in_training().alias("f")).collect())


def test_split_does_not_depend_on_layout(spark):
    path = f"{SF001}/lineitem.parquet"
    li = spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = flags(li)
    assert 0.77 < sum(r[-1] for r in a) / len(a) < 0.83
    assert flags(li.repartition(7)) == a
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        assert flags(spark.read.parquet(path).select(*li.columns)) == a
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert flags(li, seed=7) != a


def test_split_divides_copies(spark):
    # one row repeated 3000 times: the copies still split about 80 / 20, in the same numbers for any layout
    df = spark.range(0, 3000, 1, 5).select(F.lit(1.0).alias("x"), F.lit("a").alias("t"))
    a = flags(df)
    assert 0.75 < sum(r[-1] for r in a) / 3000 < 0.85
    assert flags(df.repartition(3)) == a


def test_fit_does_not_depend_on_layout(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_returnflag"]
    runs = [regression.fit_forest(df, "l_extendedprice", feats, num_trees=3, max_depth=4) for df in (li, li.repartition(5))]
    a, b = (regression.metrics(r).first() for r in runs)
    assert a == b
    assert regression.fit_forest(li, "l_extendedprice", feats, num_trees=3, max_depth=4, seed=7).n_train != runs[0].n_train


def test_forest_learns_a_signal(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").withColumn("y", F.col("l_quantity") * (1 - F.col("l_discount")))
    run = regression.fit_forest(li, "y", ["l_quantity", "l_discount", "l_tax"], num_trees=10, max_depth=8)
    assert regression.metrics(run).first()["r2"] > 0.97
    assert regression.importances(run).first()["feature"] == "l_quantity"


def test_nan_is_missing_in_the_profile(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 1.0), (float("nan"), float("nan"), 2.0)], "a double, b double, c double")
    got = {r["feature"]: (r["non_null"], r["kept"]) for r in regression.feature_profile(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, False), "b": (0, False), "c": (2, True)}


def test_nothing_stays_cached(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    regression.fit_forest(li, "l_extendedprice", ["l_quantity"], num_trees=2, max_depth=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_feature_pruning(run):
    assert run.dropped == ["l_shipdate"]
    assert run.numeric == ["l_quantity", "l_discount", "l_tax"] and run.text == ["l_returnflag", "l_linestatus"]


def test_metrics_and_importances(run):
    m = regression.metrics(run).first()
    assert m["n_test"] + m["n_train"] == 6000 and m["mae"] >= 0 and m["r2"] <= 1.0
    imp = regression.importances(run).collect()
    assert 0 < len(imp) <= 10
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0, abs=1e-6)
    assert {r["feature"] for r in imp} <= {"l_quantity", "l_discount", "l_tax", "l_returnflag=N", "l_returnflag=A",
                                           "l_returnflag=R", "l_linestatus=F", "l_linestatus=O"}


def test_sample_is_bounded_and_stable(run):
    a = [tuple(r) for r in regression.actual_vs_predicted_sample(run, 50).collect()]
    b = [tuple(r) for r in regression.actual_vs_predicted_sample(run, 50).collect()]
    assert len(a) == 50 and a == b


def test_sample_trend(run):
    r = regression.sample_trend(run, 100).first()
    assert r["n_points"] == 100 and r["trend_slope"] is not None


def test_boolean_feature_passes_through(spark):
    # the id is a feature only to make the rows distinct for the learner
    df = spark.range(0, 400).select("id", (F.col("id") % 7).cast("double").alias("x"),
                                    (F.col("id") % 2 == 0).alias("b"),
                                    ((F.col("id") % 7) * 2 + (F.col("id") % 2)).cast("double").alias("y"))
    run = regression.fit_forest(df, "y", num_trees=5, max_depth=6)
    assert run.numeric == ["id", "x", "b"] and run.text == []
    assert regression.metrics(run).first()["r2"] > 0.5


def test_unseen_category_encodes_as_zeros(spark, run):
    df = spark.createDataFrame([(10.0, 0.05, 0.02, "Z", "Q")],
                               "l_quantity double, l_discount double, l_tax double, l_returnflag string, "
                               "l_linestatus string").withColumn("l_extendedprice", F.lit(1.0))
    out = run.model.transform(df).first()
    vec = out["features"].toArray()
    assert list(vec[3:]) == [0.0] * (len(vec) - 3)


def test_text_modes_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert regression.text_modes(df, ["x"]).first()["mode"] == "a"


def test_streaming_hourly_mean_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src = tmp_path / "in"
    events.repartition(3).write.parquet(str(src))
    s = stream.read_export_stream(spark, str(src), events.schema, max_files_per_trigger=1)
    name = f"hourly_{uuid.uuid4().hex[:8]}"      # fresh checkpoint: a reused name resumes the old stream
    q = stream.start(stream.hourly_mean_stream(s, "ts", "value", "2 hours"), name, output_mode="complete",
                     sink="memory", available_now=True)
    q.awaitTermination(120)
    got = {r["hour"]: r["value"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want = {r["hour"]: r["value"] for r in hourly_mean(events, "ts", "value").collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_streaming_bucket_totals(spark, tmp_path):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src = tmp_path / "in"
    events.write.parquet(str(src))
    s = stream.read_export_stream(spark, str(src), events.schema)
    name = f"bucket_{uuid.uuid4().hex[:8]}"
    q = stream.start(stream.bucket_metrics_stream(s, "ts", [("n", "count", "*")]), name,
                     output_mode="complete", sink="memory", available_now=True)
    q.awaitTermination(120)
    total = spark.sql(f"SELECT SUM(n) AS n FROM {name}").first()["n"]
    assert total == events.count()


def test_streaming_append_mode_emits_final_windows(spark, tmp_path):
    import time
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src = tmp_path / "in"
    # exports arrive in time order: one file per 10-day slice, written one after another
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")]
    for lo, hi in days:
        events.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    s = stream.read_export_stream(spark, str(src), events.schema, max_files_per_trigger=1)
    name = f"append_{uuid.uuid4().hex[:8]}"
    q = stream.start(stream.hourly_mean_stream(s, "ts", "value", "1 hour"), name, output_mode="append",
                     sink="memory", available_now=True)
    q.awaitTermination(180)
    got = {r["hour"]: (r["value"], r["n_rows"]) for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want = {r["hour"]: r["value"] for r in hourly_mean(events, "ts", "value").collect()}
    # only windows closed by the watermark are emitted, each once and final
    assert got and set(got) < set(want)
    assert all(abs(got[k][0] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("n", [999, 1001, 5000])
def test_every_category_has_its_slot(spark, n):
    df = spark.range(0, 2 * n).select((F.col("id") % n).cast("string").alias("t"), F.col("id").cast("double").alias("y"))
    run = regression.fit_forest(df, "y", num_trees=1, max_depth=1)
    seen = run.train.select("t").distinct().count()
    assert len(run.feature_names) == seen and all(x.startswith("t=") for x in run.feature_names)


def test_category_cap_on_request_makes_the_rest_unseen(spark):
    df = spark.range(0, 600).select((F.col("id") % 40).cast("string").alias("t"), (F.col("id") % 3).cast("double").alias("x"),
                                    F.col("id").cast("double").alias("y"))
    run = regression.fit_forest(df, "y", num_trees=3, max_depth=3, max_categories=5)
    assert len([n for n in run.feature_names if n.startswith("t=")]) == 5
    assert regression.metrics(run).first()["n_test"] + run.n_train == 600


def test_partitions_of_the_forest_are_bounded(spark, monkeypatch):
    """Each partition sends the statistics of all open nodes on every level, so their number stops growing with the rows."""
    monkeypatch.setattr(regression, "ROWS_PER_PARTITION", 20)
    df = spark.range(3000).selectExpr("id % 17 + 0.5 AS x", "id % 17 * 2.0 + id % 3 AS y")
    run = regression.fit_forest(df, "y", num_trees=2, max_depth=2)
    assert run.train.rdd.getNumPartitions() == regression.MAX_PARTITIONS
    assert run.n_train + run.predictions.count() == 3000
