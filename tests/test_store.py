"""Sources kept by batch and day: same rows as the operators on the whole table, from fewer files."""

import datetime as dt

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from loadlens.operators import anomaly, filters
from loadlens.sources.store import Store


@pytest.fixture(scope="module")
def events(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "ts", "event_type", "value")
    return ev.withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))


@pytest.fixture(scope="module")
def store(spark, events, tmp_path_factory):
    out = Store(spark, str(tmp_path_factory.mktemp("store")), "ts", ["value"])
    out.ingest(events.filter("event_id % 3 = 0"), "a")
    out.ingest(events.filter("event_id % 3 <> 2"), "b")
    out.ingest(events.filter("event_id % 3 <> 0"), "b")  # the batch again, corrected: it is replaced
    return out


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


@pytest.mark.parametrize("period", ["1h", "6h", "1d", "1m", "ytd", "all"])
def test_trailing_ranges(events, store, period):
    assert ids(store.trailing_range(period)) == ids(filters.trailing_range(events, "ts", period))


def test_a_range_reads_its_days_alone(spark, events, store):
    files = store.trailing_range("1d").inputFiles()
    newest = events.agg(F.max("ts")).first()[0]
    days = {f.split("__day=")[1][:10] for f in files}
    assert days == {str((newest - dt.timedelta(days=k)).date()) for k in (0, 1)}
    assert len(files) < len(store.rows().inputFiles()) / 3
    with pytest.raises(ValueError):
        store.trailing_range("2d")


@pytest.mark.parametrize("m", [1.0, 2.0, 3.0])
def test_anomalies(events, store, m):
    want = anomaly.anomalies(events, "value", m, ["value", "event_id"], "ts").collect()
    assert store.anomalies("value", m, ["value", "event_id"]).collect() == want and want
    limit, files = store.files_above("value", m)
    assert limit == pytest.approx(anomaly.anomaly_count(events, "value", m, "ts").first()["threshold"], rel=1e-12)
    rows = store.rows().select("_metadata.file_path", "value", "ts").filter(F.col("ts").isNotNull() & (F.col("value") > limit))
    assert sorted(files) == sorted(r[0] for r in rows.select("file_path").distinct().collect())


def test_few_files_hold_the_hits(spark, tmp_path):
    df = spark.range(3000).select((F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), F.lit(1.0).alias("v"), "id") \
        .withColumn("v", F.when(F.col("id") == 1234, 500.0).otherwise(F.col("v")))
    kept = Store(spark, str(tmp_path / "s"), "ts", ["v"])
    kept.ingest(df, "one")
    assert len(kept.files_above("v", 5.0)[1]) == 1 and [r["id"] for r in kept.anomalies("v", 5.0).collect()] == [1234]
    assert kept.zones().agg(F.sum("n_rows")).first()[0] == 3000


def test_odd_stores(spark, tmp_path):
    """No rows, no timestamps, texts as metric, names that clash with the zones'."""
    schema = "ts timestamp, v string, n0 int, file string, day date"
    empty = Store(spark, str(tmp_path / "empty"), "ts", ["v"])
    empty.ingest(spark.createDataFrame([(None, "1", 1, "f", None)], schema), "x")
    assert empty.files_above("v") == (None, []) and empty.anomalies("v").count() == 0
    assert empty.trailing_range("1d").count() == 0 and empty.rows().count() == 1
    rows = [(dt.datetime(2024, 1, 1, 5), x, 1, "f", None) for x in ["1", "1", "1", "bad", None, "2"] * 5 + ["90"]]
    odd = Store(spark, str(tmp_path / "odd"), "ts", ["v"])
    odd.ingest(spark.createDataFrame(rows, schema), "x")
    assert [r["v"] for r in odd.anomalies("v", 3.0).collect()] == [90.0] and odd.rows().count() == len(rows)
