"""The form of a date-time text column, found by a vote over its cells."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loadlens.functions import cleaning
from loadlens.sources.loader import clean_frame
from loadlens.sources.specs import CATALOG


def parsed(spark, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string").repartition(3)
    got = df.select("i", cleaning.parse_datetime_column(df, "t").alias("p")).collect()
    return [r["p"] for r in sorted(got)]


def stamp(*parts):
    return dt.datetime(*parts)


@pytest.mark.parametrize("cells, want", [
    (["2024-01-31 10:20:30", "31/01/2024", "2024-02-01"], [stamp(2024, 1, 31, 10, 20, 30), None, stamp(2024, 2, 1)]),
    (["03/04/2024", "04/05/2024 1:02"], [stamp(2024, 3, 4), stamp(2024, 4, 5, 1, 2)]),  # either way: month first
    (["03/04/2024", "25/05/2024 01:02:03", "26/05/2024"], [stamp(2024, 4, 3), stamp(2024, 5, 25, 1, 2, 3), stamp(2024, 5, 26)]),
    (["3.4.2024 5:06", "x", None, "", "31.12.2023"], [stamp(2024, 4, 3, 5, 6), None, None, None, stamp(2023, 12, 31)]),
    (["7 Mar 2024", " 8 mar 2024 ", "9 March 2024"], [stamp(2024, 3, 7), stamp(2024, 3, 8), None]),
    (["March 7, 2024 10:11", "June 8, 2024"], [stamp(2024, 3, 7, 10, 11), stamp(2024, 6, 8)]),
    (["31/12/99", "01/02/68", "30/06/05 7:08"], [stamp(1999, 12, 31), stamp(2068, 2, 1), stamp(2005, 6, 30, 7, 8)]),
    (["12/31/2024 11:59:58 PM", "1/2/2024 12:00:00 AM"], [stamp(2024, 12, 31, 23, 59, 58), stamp(2024, 1, 2)]),
    (["2024/3/4 5:06:07", "2024/13/4"], [stamp(2024, 3, 4, 5, 6, 7), None]),
    (["no", "dates", None], [None, None, None]),
])
def test_forms(spark, cells, want):
    assert parsed(spark, cells) == want


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "t string, n0 long, form int")
    assert df.select(cleaning.parse_datetime_column(df, "t")).count() == 0
    df = spark.createDataFrame([("13/02/2024", 5, 1)], "t string, n0 long, form int")
    assert df.select(cleaning.parse_datetime_column(df, "t").alias("t"), "n0", "form").first() == (stamp(2024, 2, 13), 5, 1)


def test_a_source_with_written_dates(spark):
    raw = spark.createDataFrame([("25.12.2024 06:07", "1", "a"), ("26.12.2024 23:59", "2", "b"), ("?", "3", "c")],
                                "FULL_DATETIME string, USEDBYTES string, ACCOUNT string")
    got = {r["ACCOUNT"]: r["FULL_DATETIME"] for r in clean_frame(raw, CATALOG["memory"]).collect()}
    assert got == {"a": stamp(2024, 12, 25, 6, 7), "b": stamp(2024, 12, 26, 23, 59), "c": None}


def test_guards_pass_all_that_a_form_parses(spark):
    rng = random.Random(4)
    pieces = ["1", "3", "12", "29", "31", "00", "05", "007", "23", "59", "99", "2024", "02024", "+12024", "-2024", "-1", "+3",
              "/", "/", ".", "-", "-", " ", " ", ":", ":", ",", ", ", "Mar", "mar", "MARCH", "May", "Sept", "AM", "pm", "x", "é"]
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 11))) for _ in range(300)}
    for d in ("1", "09", "0031"):
        for m in ("2", "12", "Mar", "jUNE"):
            for y in ("24", "2024", "02024", "+12024", "-0001"):
                for t in ("", " 7:08", " 12:08:09", " 23:59", " 7:08 am", " 12:08:09 PM"):
                    texts |= {f"{x}{t}" for s in "/.-" for x in (s.join((d, m, y)), s.join((m, d, y)), s.join((y, m, d)))}
                    texts |= {f"{d} {m} {y}{t}", f"{m} {d}, {y}{t}"}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    forms, t = [f for f in cleaning.DATETIME_FORMS if f], F.col("t")
    both = [F.struct(F.try_to_timestamp(t, F.lit(f)).isNotNull().alias("parses"),
                     (t.rlike(cleaning.form_guard(f)) & cleaning.cell_shape(t).isin(cleaning.form_shapes(f))).alias("guard"),
                     ).alias(f"f{i}") for i, f in enumerate(forms)]
    rows = df.select("t", *both).collect()
    for i, form in enumerate(forms):
        got = [(r["t"], *r[f"f{i}"]) for r in rows]
        assert any(parses for _, parses, _ in got), form
        assert not [x for x, parses, guard in got if parses and not guard], form
        assert sum(guard and not parses for _, parses, guard in got) <= 0.02 * len(got), form  # few that pass are refused
