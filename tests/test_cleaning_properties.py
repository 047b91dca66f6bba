"""Property tests: Spark cleaning expressions vs the export conventions stated in plain Python."""

import datetime as dt
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from loadlens.functions import cleaning as C
from loadlens.functions.timebuckets import hour_bucket

# characters that exercise every branch: printable ASCII, Unicode and ASCII-control
# whitespace, accented letters, control characters, a non-breaking space
SPECIAL = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0      　éü€\x00\x07\x7f\x9f") + ["nan"]
TEXT = st.lists(st.one_of(st.sampled_from(SPECIAL),
                          st.characters(blacklist_categories=("Cs",), max_codepoint=0x3100)),
                max_size=12).map("".join)


def spec_clean(x, default):
    if x is None:
        return default
    s = re.sub(r"[^\x20-\x7E\s]+", " ", x.strip()).strip()
    return default if s in ("nan", "") else s


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=40))
def test_clean_string_matches_spec(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(C.clean_string("x", "D")).collect()]
    assert got == [spec_clean(v, "D") for v in values]


def spec_compact_date(s):
    if s is None or s == "00000000" or not re.fullmatch(r"[0-9]{8}", s):
        return None
    try:
        return dt.datetime.strptime(s, "%Y%m%d").date()
    except ValueError:
        return None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just("00000000"),
                          st.dates(dt.date(1, 1, 1), dt.date(9999, 12, 31)).map(lambda d: d.strftime("%Y%m%d")),
                          st.text("0123456789", min_size=7, max_size=9)), min_size=1, max_size=40))
def test_compact_date_matches_spec(spark, values):
    values = [v.zfill(8) if v and len(v) == 8 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(C.compact_date("x")).collect()]
    assert got == [spec_compact_date(v) for v in values]


def spec_datetime(d, t):
    if d is None or t is None:
        return None
    t = t if len(t) >= 6 else t.zfill(6)
    s = d + t
    if not re.fullmatch(r"[0-9]{14}", s):
        return None
    try:
        return dt.datetime.strptime(s, "%Y%m%d%H%M%S")
    except ValueError:
        return None


@settings(max_examples=15, deadline=None)
@example(pairs=[("20240131", "121960"), ("20240131", "126000"), ("20240131", "240000")])
@given(st.lists(st.tuples(st.sampled_from(["20240131", "20240229", "20230229", "2024013", None]),
                          st.one_of(st.none(), st.integers(0, 2_600_000).map(str))), min_size=1, max_size=40))
def test_compact_datetime_matches_spec(spark, pairs):
    df = spark.createDataFrame(pairs, "d string, t string")
    got = [r[0] for r in df.select(C.compact_datetime("d", "t")).collect()]
    assert got == [spec_datetime(d, t) for d, t in pairs]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2030, 1, 1)), min_size=1, max_size=40))
def test_hour_bucket_matches_spec(spark, stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = [r[0] for r in df.select(hour_bucket("ts")).collect()]
    want = ["00--06" if s.hour < 6 else f"{s.hour:02d}--{(s.hour + 1) % 24:02d}" for s in stamps]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e12, max_value=1e12)
                .map(lambda f: round(f, 2)), min_size=1, max_size=40))
def test_eu_number_round_trips(spark, values):
    # written the European way: thousands dots, decimal comma
    texts = [f"{v:,.2f}".replace(",", " ").replace(".", ",").replace(" ", ".") for v in values]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(C.eu_number("x")).collect()]
    assert got == [float(f"{v:.2f}") for v in values]


def spec_mm_ss(s):
    # the exports' MM:SS convention: two parts -> minutes * 60 + seconds, one part -> number, truncated
    if s is None:
        return 0.0
    parts = s.split(":")
    try:
        if len(parts) == 2:
            return float(int(float(parts[0]) * 60 + float(parts[1])))
        if len(parts) == 1:
            return float(int(float(parts[0])))
        return 0.0
    except (ValueError, OverflowError):
        return 0.0


NUM_TEXT = st.one_of(st.floats(-1e6, 1e6, allow_nan=False).map(lambda f: f"{f:.3f}"),
                     st.integers(-10_000, 10_000).map(str), st.integers(0, 59).map(lambda i: f"{i:02d}"),
                     st.sampled_from(["", " ", "ab", "1d", "inf", "-inf", "nan", " 7 ", ".5", "5.", "1e3", "--1"]))


@settings(max_examples=20, deadline=None)
@example(values=["03:05", "90", "1.7", "1:2:3", "ab", None, "inf", "-1.5", " 2 : 30 ", "1:", ":5"])
@given(st.lists(st.one_of(st.none(), NUM_TEXT, st.tuples(NUM_TEXT, NUM_TEXT).map(":".join),
                          st.tuples(NUM_TEXT, NUM_TEXT, NUM_TEXT).map(":".join)), min_size=1, max_size=40))
def test_mm_ss_matches_spec(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(C.mm_ss_seconds("x")).collect()]
    assert got == [spec_mm_ss(v) for v in values]


NUMBERISH = st.lists(st.sampled_from(list("0123456789") + [".", ",", "-", "+", "e", "E", " ", "d", "x", "_", "inf",
                                                               "nan", "a"]), max_size=8).map("".join)


def same_number(a, b):
    # pandas' fast float parser can be one ulp off; Java's parse is correctly rounded
    import math
    return a == b or (math.isfinite(a) and math.isfinite(b) and math.isclose(a, b, rel_tol=4e-16, abs_tol=0.0))


def spec_to_double(values):
    import pandas as pd
    s = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce").fillna(0).astype(float)
    return [float(v) for v in s]


@settings(max_examples=25, deadline=None)
@example(values=[" 12 ", "1e3", "5.", "1_000", "0x1A", "True", "1,5", "", "nan", "1d", "inf", "-2.5", ".5", "+7"])
@given(st.lists(NUMBERISH, min_size=1, max_size=40))
def test_to_double_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(C.to_double("x")).collect()]
    want = spec_to_double(values)
    assert len(got) == len(want) and all(same_number(a, b) for a, b in zip(got, want)), (got, want)


def spec_eu(values):
    cleaned = [v.replace(" ", "").replace(".", "").replace(",", ".") for v in values]
    return spec_to_double(cleaned)


@settings(max_examples=20, deadline=None)
@example(values=["1.234,5", "1 234,5", "7", "abc", "12,5", "1.000.000,25", "-3,0"])
@given(st.lists(NUMBERISH, min_size=1, max_size=40))
def test_eu_number_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(C.eu_number("x")).collect()]
    want = spec_eu(values)
    assert len(got) == len(want) and all(same_number(a, b) for a, b in zip(got, want)), (got, want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e15, 1e15, allow_nan=False), min_size=1, max_size=40))
def test_thousands_label_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(C.thousands_label("x")).collect()]
    assert got == [f"{int(v):,}".replace(",", " ") for v in values]
