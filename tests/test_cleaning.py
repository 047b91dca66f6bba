"""Cleaning expressions on hand-made dirty values (cases of FIXTURES.md §2)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loadlens.functions import cleaning as C
from loadlens.functions.timebuckets import bucket_labels, bucket_ordinal, bucket_spine, hour_bucket


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def apply(spark, fn, values, typ="string"):
    df = one_col(spark, values, typ)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clean_string(spark):
    got = apply(spark, lambda c: C.clean_string(c, "DEF"),
                [" Société ", "A B", None, "nan", "", "é", "  ok  ", " x "])
    assert got == ["Soci t", "A B", "DEF", "DEF", "DEF", "DEF", "ok", "x"]


def test_to_double(spark):
    got = apply(spark, C.to_double, [" 12 ", "1e3", "5.", "1_000", "0x1A", "True", "1,5", "", "nan", "1d", "inf",
                                     None, "-2.5", ".5"])
    assert got[:3] == [12.0, 1000.0, 5.0]
    assert got[3:10] == [0.0] * 7
    assert math.isinf(got[10])
    assert got[11:] == [0.0, -2.5, 0.5]


def test_to_double_numeric_passthrough(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(C.to_double("x", df.schema["x"].dataType)).collect()]
    assert got == [1.5, 0.0, 0.0]


def test_eu_number(spark):
    assert apply(spark, C.eu_number, ["1.234,5", "1 234,5", "7", "abc", None]) == [1234.5, 1234.5, 7.0, 0.0, 0.0]
    df = spark.createDataFrame([(12.5,), (100.0,)], "x double")
    got = [r[0] for r in df.select(C.eu_number("x", df.schema["x"].dataType)).collect()]
    assert got == [12.5, 100.0]          # numeric input passes through (documented fix)


def test_mm_ss_seconds(spark):
    got = apply(spark, C.mm_ss_seconds, ["03:05", "90", "1.7", "1:2:3", "ab", None, "inf", "-1.5"])
    assert got == [185.0, 90.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0]


def test_mm_ss_non_text_is_zero(spark):
    df = spark.createDataFrame([(90.0,)], "x double")
    assert df.select(C.mm_ss_seconds("x", df.schema["x"].dataType)).first()[0] == 0.0


def test_compact_datetime(spark):
    df = spark.createDataFrame([("20240131", "93015"), ("20240131", "250000"), ("20240131", "1234567"),
                                ("20240131", "5"), ("2024013", "93015"), (None, "93015"), ("20240131", "121960"),
                                ("20240131", "126000")], "d string, t string")
    got = [r[0] for r in df.select(C.compact_datetime("d", "t")).collect()]
    assert got == [dt.datetime(2024, 1, 31, 9, 30, 15), None, None, dt.datetime(2024, 1, 31, 0, 0, 5), None, None,
                   None, None]
    assert df.select(C.compact_datetime("d", "t")).schema[0].dataType.simpleString() == "timestamp_ntz"


def test_compact_date(spark):
    got = apply(spark, C.compact_date, ["20240131", "00000000", "0", "20240101.0", "99991231", None])
    assert got == [dt.date(2024, 1, 31), None, None, None, dt.date(9999, 12, 31), None]


def test_parse_datetime_text(spark):
    got = apply(spark, C.parse_datetime_text, ["2024-01-31 09:30:15", "garbage"])
    assert got == [dt.datetime(2024, 1, 31, 9, 30, 15), None]


def test_short_label(spark):
    got = apply(spark, C.short_label, ["a" * 70, "b" * 71, None])
    assert got == ["a" * 70, "b" * 70 + "...", None]


def test_thousands_label(spark):
    got = apply(spark, C.thousands_label, [1234567.9, 999.0, 0.0, -1234.5], "double")
    assert got == ["1 234 567", "999", "0", "-1 234"]


def test_units(spark):
    df = spark.createDataFrame([(2500.0, 3145728.0)], "ms double, b double")
    r = df.select(C.ms_to_seconds("ms"), C.bytes_to_mib("b")).first()
    assert (r[0], r[1]) == (2.5, 3.0)


def test_column_names():
    assert C.clean_column_name(" Resp. Time (ms) ") == "Resp_Time_ms"
    assert C.clean_column_name("\x07ENDDATE") == "ENDDATE"
    assert C.clean_column_names(["a b", "c"]) == ["a_b", "c"]
    with pytest.raises(ValueError):
        C.clean_column_names(["a b", "a_b"])


def test_hour_bucket(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 30),) for h in (0, 5, 6, 22, 23)] + [(None,)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(hour_bucket("ts")).collect()]
    assert got == ["00--06", "00--06", "06--07", "22--23", "23--00", None]


def test_bucket_spine_and_order(spark):
    labels = bucket_labels()
    assert len(labels) == 19 and labels[0] == "00--06" and labels[1] == "06--07" and labels[-1] == "23--00"
    spine = bucket_spine(spark).orderBy("ord").collect()
    assert [r["TIME_RANGE"] for r in spine] == labels
    df = spark.createDataFrame([("23--00",), ("00--06",), ("zz",)], "l string")
    assert [r[0] for r in df.select(bucket_ordinal("l")).collect()] == [18, 0, 19]


def test_whitespace_sets_match_python():
    bmp = {chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF}
    assert set(C.WHITESPACE_CHARS) == {ch for ch in bmp if ch.isspace()}
