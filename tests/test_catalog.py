"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as entry_mod
from loadlens.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SQL = dict(catalog.ORACLE_SQL)      # the training-data queries have tests of their own
QUERIES = dict(catalog.QUERIES)
SLOW = {"P_forest_metrics", "P12_forest_importances", "P13_forest_actual_vs_predicted_sample",
        "P14_forest_sample_trend_line"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (4, str(v))


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 10 and df.columns == ["l_suppkey", "sum_extendedprice", "sum_quantity", "sum_tax"]


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry_mod.queries()) and set(SQL) <= set(entry_mod.oracle_sql())


def test_every_query_has_an_oracle_or_is_model_based():
    assert set(QUERIES) - set(SQL) == SLOW


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_forest_queries_run(spark):
    outs = {name: QUERIES[name](spark, SF001).collect() for name in sorted(SLOW)}
    m = outs["P_forest_metrics"][0]
    assert m["n_train"] + m["n_test"] == 6000 and m["mae"] > 0 and m["r2"] > 0.95
    assert 0 < len(outs["P12_forest_importances"]) <= 10
    assert len(outs["P13_forest_actual_vs_predicted_sample"]) == 500
    assert outs["P14_forest_sample_trend_line"][0]["n_points"] == 500


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
