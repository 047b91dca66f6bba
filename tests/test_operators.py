"""Operator properties on the shared test tables and small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from loadlens.operators import aggregates as agg
from loadlens.operators import anomaly, density, filters


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF001}/lineitem.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF001}/events.parquet")


METRICS = [("s_price", "sum", "l_extendedprice"), ("a_qty", "avg", "l_quantity"), ("n", "count", "*")]


def test_top_k_ties_break_by_key(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 5), ("d", 1)], "k string, v int")
    assert rows(agg.top_k(df, "v", "k", 2), "k") == [("a",), ("b",)]


def test_top_k_is_prefix_of_full_sort(lineitem):
    g = agg.group_metrics(lineitem, "l_suppkey", METRICS, decimal_scale=2)
    full = rows(agg.sort_by(g, "s_price", "l_suppkey"))
    assert rows(agg.top_k(g, "s_price", "l_suppkey", 7)) == full[:7]


def test_exact_aggregates_do_not_depend_on_partitioning(lineitem):
    a = agg.group_metrics(lineitem, "l_suppkey", METRICS, decimal_scale=2)
    b = agg.group_metrics(lineitem.repartition(13, "l_orderkey"), "l_suppkey", METRICS, decimal_scale=2)
    assert sorted(rows(a)) == sorted(rows(b))


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0)], "k string, v double")
    assert rows(agg.group_metrics(df, "k", [("s", "sum", "v")])) == [("a", 1.0)]


def test_hot_key_aggregates_exactly(spark):
    # one key holds most rows: the partial aggregate still gives the exact total
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).alias("k"),
                                      F.lit(0.01).alias("v"))
    g = {r["k"]: r["s"] for r in agg.group_metrics(df, "k", [("s", "sum", "v")], decimal_scale=2).collect()}
    assert g[1] == pytest.approx(100.0, abs=1e-9)


def test_shares_sum_to_one(lineitem):
    g = agg.count_by(lineitem, "l_returnflag", "n")
    s1 = sum(r["share"] for r in agg.share_of_total(g, "n").collect())
    s2 = sum(r["share"] for r in agg.share_of_small(g, "n").collect())
    assert s1 == pytest.approx(1.0) and s2 == pytest.approx(1.0)


def test_to_long(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    assert sorted(rows(agg.to_long(df, "k", ["x", "y"]))) == [("a", "x", 1.0), ("a", "y", 2.0)]


def test_positive_guards(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, v double")
    assert agg.keep_if_positive_total(df, "v").count() == 0
    assert agg.require_positive_input(df, df, "v").count() == 0
    pos = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert agg.require_positive_input(df, pos, "v").count() == 2


def test_filters_shrink(events):
    n = events.count()
    assert filters.contains_ci(events, "event_type", "CLICK").count() < n
    assert filters.in_values(events, "event_type", []).count() == n
    assert filters.in_values(events, "event_type", ["click"]).count() == \
        filters.contains_ci(events, "event_type", "click").count()


@pytest.mark.parametrize("n", [900, 1500, 5000])
def test_in_values_is_one_rule_for_any_length(spark, events, n):
    got = filters.in_values(events, "event_id", list(range(n)))
    assert got.count() == events.filter(F.col("event_id") < n).count() and got.columns == events.columns
    mixed = spark.createDataFrame([(0.5, "a"), (1.0, "b"), (7.25, "c"), (float(n + 9), "d")], "x double, s string")
    assert sorted(rows(filters.in_values(mixed, "x", [0.5, *range(n)]))) == [(0.5, "a"), (1.0, "b")]


def test_exact_sums_do_not_overflow(spark):
    big = spark.range(0, 10).select(F.lit("k").alias("k"), (F.col("id") + 10 ** 16).alias("i"),
                                    F.lit(4.0e15 + 0.25).alias("x"))
    got = agg.group_metrics(big, "k", [("s", "sum", "i"), ("a", "avg", "i"), ("x", "sum", "x")], 2).first()
    assert got["s"] == float(10 ** 17 + 45) and got["a"] == float(10 ** 17 + 45) / 10 and got["x"] == 4.0e16 + 2.5
    neg = spark.createDataFrame([("k", -0.01), ("k", -123456.78), ("k", 0.02)], "k string, x double")
    assert agg.group_metrics(neg, "k", [("s", "sum", "x")], 2).first()["s"] == -123456.77


def test_kde_of_far_apart_values_keeps_empty_points(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1000.0,)], "v double")
    out = density.kde(df, "v", bandwidth=0.5).collect()
    assert len(out) == 500 and out[250]["density"] == 0.0 and out[0]["density"] > 0


def test_restrict_to_top_frequent(events):
    top = [r[0] for r in filters.top_frequent_keys(events, "user_id", 3).collect()]
    got = {r[0] for r in filters.restrict_to_top_frequent(events, "user_id", 3).select("user_id").distinct().collect()}
    assert len(top) == 3 and got == set(top)


def test_trailing_ranges_nest(events):
    counts = [filters.trailing_range(events, "ts", p).count() for p in ("1h", "6h", "1d", "1m", "all")]
    assert counts == sorted(counts) and counts[-1] == events.count()
    with pytest.raises(ValueError):
        filters.trailing_range(events, "ts", "2w")


def test_anomaly_count_falls_as_m_rises(events):
    counts = [anomaly.anomaly_count(events, "value", m).first()["n_anomalies"] for m in (1.0, 2.0, 3.0, 5.0)]
    assert counts == sorted(counts, reverse=True)
    with pytest.raises(ValueError):
        anomaly.anomaly_count(events, "value", 0.5)
    with pytest.raises(ValueError):
        anomaly.anomaly_count(events, "value", 3.05)


def test_anomaly_matches_numpy(events):
    v = np.array([r[0] for r in events.select("value").collect()])
    thr = v.mean() + 2.0 * v.std(ddof=1)
    got = anomaly.anomalies(events, "value", 2.0, ["event_id", "value"])
    assert got.count() == int((v > thr).sum())
    vals = [r["value"] for r in got.collect()]
    assert vals == sorted(vals, reverse=True)


def test_single_row_has_no_anomaly(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert anomaly.anomalies(df, "v", 3.0).count() == 0
    ov = anomaly.anomaly_overlay(df, "v", 3.0).collect()
    assert len(ov) == 1 and ov[0]["is_anomaly"] is False


def kde_brute(values, grid=500):
    v = np.asarray(values, dtype=float)
    n, lo, hi = len(v), v.min(), v.max()
    h = v.std(ddof=1) * n ** (-0.2)
    xs = lo + np.arange(grid) * (hi - lo) / grid
    z = (xs[:, None] - v[None, :]) / h
    return xs, np.exp(-0.5 * z * z).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))


def test_kde_matches_brute_force(events):
    vals = [r[0] for r in events.select("value").collect()]
    xs, dens = kde_brute(vals)
    got = density.kde(events, "value").collect()
    assert [r["i"] for r in got] == list(range(500))
    assert np.allclose([r["x"] for r in got], xs, rtol=1e-12)
    assert np.allclose([r["density"] for r in got], dens, rtol=1e-9, atol=1e-15)


def test_kde_integrates_to_about_one(events):
    got = density.kde(events, "value").collect()
    step = got[1]["x"] - got[0]["x"]
    # the grid stops at max, so a little mass beyond both ends is missing
    assert 0.8 < sum(r["density"] for r in got) * step < 1.01


def test_kde_binned_is_close(events):
    exact = [r["density"] for r in density.kde(events, "value").collect()]
    binned = [r["density"] for r in density.kde(events, "value", bins=4096).collect()]
    assert np.max(np.abs(np.array(exact) - np.array(binned))) < 0.01 * max(exact)


def test_kde_needs_two_distinct_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert density.kde(df, "v").count() == 0


def test_spine_always_has_19_rows(spark):
    from loadlens.operators.timeseries import bucket_metrics_on_spine
    df = spark.createDataFrame([("06--07", 1.0), ("zz", 5.0), ("23--24", 2.0), (None, 3.0), ("06--07", 3.0)],
                               "TIME string, v double")
    out = bucket_metrics_on_spine(df, "TIME", [("v", "sum", "v")]).collect()
    assert len(out) == 19 and out[0]["TIME"] == "00--06" and out[-1]["TIME"] == "23--00"
    assert {r["TIME"]: r["v"] for r in out}["06--07"] == 4.0 and sum(r["v"] for r in out) == 4.0
    empty = bucket_metrics_on_spine(df.limit(0), "TIME", [("v", "sum", "v")]).collect()
    assert len(empty) == 19 and all(r["v"] == 0 for r in empty)


def test_sort_rows_splits_a_hot_tied_group(spark):
    # a third of the rows share one sort key
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # see the range partitions as planned
    try:
        def biggest(d):
            return d.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        plain = biggest(df.orderBy("k"))
        balanced_df = agg.sort_rows(df, F.col("k").asc())
        balanced = biggest(balanced_df)
        keys = [r["k"] for r in balanced_df.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert plain >= 10000 and balanced < plain
    assert keys == sorted(keys)


def test_kpis_with_missing_sources_are_zero(spark):
    from loadlens.operators.kpis import kpis
    r = kpis(spark).first()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "RESPTI double, CPUTI double, DBCALLS double")
    assert tuple(kpis(spark, hitlist=empty).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_anomalies_need_a_positive_total(spark):
    df = spark.createDataFrame([(-5.0,), (-1.0,), (0.0,), (-100.0,)], "v double")
    assert anomaly.anomalies(df, "v", 1.0).count() == 0
    assert anomaly.anomaly_overlay(df, "v", 1.0).count() == 0
    r = anomaly.anomaly_count(df, "v", 1.0).first()
    assert r["threshold"] is None and r["n_anomalies"] == 0


def test_trailing_range_on_empty_input(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, v double")
    assert filters.trailing_range(df, "ts", "1d").count() == 0
    assert filters.trailing_range(df, "ts", "ytd").count() == 0


def test_value_options_and_list_filters(spark):
    a = spark.createDataFrame([("x",), (None,), ("b",)], "k string")
    b = spark.createDataFrame([("b",), ("a",)], "acc string")
    assert [r[0] for r in filters.value_options([(a, "k"), (b, "acc")]).collect()] == ["a", "b", "x"]
    assert filters.in_values(a, "k", ["x", "x", "b"]).count() == 2          # duplicates in the list are harmless
    assert filters.exclude_value(a, "k", "x").count() == 1                  # null keys drop too, as in SQL
    s = spark.createDataFrame([("ECC-VE7-00a",), ("ecc-ve7-00",), ("other",), ("ECC.VE7-00",)], "srv string")
    assert filters.contains_ci(s, "srv", "ECC-VE7-00").count() == 2        # literal, not a regex
