"""Grouped outputs of a section from one pass over its source."""

import pyarrow as pa
import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from loadlens.operators import aggregates as agg
from loadlens.operators.onepass import GroupedPass
from loadlens.plans import reports

METRICS = [("s", "sum", "value"), ("m", "avg", "value"), ("n", "count", "*"), ("k", "count", "value")]


def test_groups_equal_separate_aggregates(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn(
        "user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    once = GroupedPass(ev)
    once.by("user_id", METRICS)
    once.by("event_type", METRICS[:2])
    once.by("day", METRICS[2:], F.to_date("ts"))
    once.total(["value", "absent"])
    for key, metrics, src in (("user_id", METRICS, ev), ("event_type", METRICS[:2], ev),
                              ("day", METRICS[2:], ev.withColumn("day", F.to_date("ts")))):
        want = {r[0]: tuple(r)[1:] for r in agg.group_metrics(src, key, metrics).collect()}
        got = {r[0]: tuple(r)[1:] for r in once.groups(key, metrics).collect()}
        assert set(got) == set(want) and None not in got
        assert all(g == pytest.approx(w, rel=1e-9) for k in got for g, w in [(got[k], want[k])])
    total = ev.agg(F.sum("value")).first()[0]
    assert once.totals().select(once.metrics["sum", "value"]).first()[0] == pytest.approx(total)
    with pytest.raises(ValueError):
        once.by("other", METRICS, F.lit(1))
    once.release()


def test_guards(spark):
    df = spark.createDataFrame([("a", 1.0, -2.0), ("b", None, 1.0)], "k string, x double, y double")
    once = GroupedPass(df)
    once.by("k", [("x", "sum", "x")])
    once.total(["x", "y"])
    one = spark.range(1)
    for cols, ok in ((["x"], True), (["y"], False), (["x", "y"], False), (["none"], False)):
        assert one.filter(once.positive(cols)).count() == ok, cols
    empty = GroupedPass(df.limit(0))
    empty.total(["x"])
    assert one.filter(empty.positive(["x"])).count() == 0 and empty.totals().count() == 1


def counted(df, counter):
    """The frame behind a step that counts the rows it hands on."""
    def run(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)
    return df.mapInArrow(run, df.schema)


def test_a_section_reads_its_source_once(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("ACCOUNT"), F.col("l_partkey").cast("string").alias("REPORT"),
        F.col("l_shipdate").cast("timestamp").alias("FULL_DATETIME"),
        *[F.col("l_quantity").cast("double").alias(c) for c in (
            "CPUTI", "RESPTI", *reports.IO_COUNTS, *reports.IO_BUFFERS, *reports.COMM_METRICS)])
    counter = spark.sparkContext.accumulator(0)
    section = reports.transactions_section({"usertcode": counted(li, counter)})
    grouped = [name for name in section if name != "cpu_vs_resp_points"]
    assert len(grouped) == 7
    for name in grouped:
        assert section[name].count() > 0
    assert counter.value == li.count()
    section.release()


def test_outputs_without_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "ACCOUNT string, USEDBYTES double")
    out = reports.memory_section({"memory": df})
    assert set(out) == {"avg_usedbytes_by_account", "usedbytes_density"}
    assert rows(out["avg_usedbytes_by_account"]) == [("a", 1.0)]
    assert reports.memory_section({}) == {} and reports.tasks_section({"tasktimes": df}) == {}
