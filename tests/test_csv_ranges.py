"""CSV by byte ranges against Spark's own multi-line reader, with quotes and line breaks on range edges."""

import random

import pyarrow as pa
import pytest

from loadlens.sources import csv_ranges, load_source
from loadlens.sources.csv_ranges import INSIDE, OUTSIDE, LineStates
from loadlens.sources.loader import read_raw


@pytest.fixture
def small_ranges(spark):
    """Ranges of 150 bytes, so that records span several of them."""
    new = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1",
           "spark.sql.files.minPartitionNum": "8"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def expected(spark, path):
    return spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=True).csv(path)


def same(spark, path):
    want, got = expected(spark, path), csv_ranges.read_quoted_csv(spark, path)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def field(rng):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(["", "abc", "x y", "d'e", "1.5", "é"])
    if kind < 0.3:
        return rng.choice(['a"b', 'a""b', 'x"'])  # quotes that open nothing
    body = "".join(rng.choice(["a", "b", ",", "\n", '""', "\r\n", "é", " ", "long" * 5, "\n\n", "\n" * 120])
                   for _ in range(rng.randint(0, 12)))
    return f'"{body}"' + rng.choice(["", "", "", "x y"])


@pytest.mark.parametrize("seed", range(12))
def test_rows_equal_the_multi_line_reader(spark, small_ranges, tmp_path, seed):
    rng = random.Random(seed)
    nl = "\r\n" if seed % 3 == 0 else "\n"
    header = rng.choice(["h1,h2,h3", 'h1,"h ""2""",h3', f'h1,"{"w" * 200} x",h3', f'h1,"two{nl}lines",h3'])
    for f in range(1 + seed % 2):
        rows = [header] + [",".join(field(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rng.randint(0, 60))]
        (tmp_path / f"p{f}.csv").write_bytes((nl.join(rows) + rng.choice(["", nl, nl * 3])).encode())
    same(spark, str(tmp_path))


def test_long_records_over_many_ranges(spark, small_ranges, tmp_path):
    path = tmp_path / "long.csv"
    inner = "\n".join(f'line {i}, with ""quotes""' for i in range(400))
    path.write_text(f'a,b\n1,"{inner}"\n2,x\n"{inner}",3\n4,"unclosed\nto the end')
    same(spark, str(path))
    assert csv_ranges.read_quoted_csv(spark, str(path)).rdd.getNumPartitions() > 50


def test_odd_files(spark, small_ranges, tmp_path):
    for name, text in (("only_header.csv", "a,b\n"), ("no_end.csv", "a,b\n1,2"), ("blank.csv", "a,b\n\n\n1,2\n\n"),
                       ("empty_fields.csv", 'a,b\n,\n"",""\n'), ("dup.csv", "a,a\n1,2\n"), ("bom.csv", "﻿a,b\n1,2\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
        same(spark, str(tmp_path / name))
    (tmp_path / "empty.csv").write_text("")
    assert csv_ranges.read_quoted_csv(spark, str(tmp_path / "empty.csv")).columns == []


def test_line_states():
    s = LineStates()
    for line, outside, inside in (("a,b", 0, 1), ('"a', 1, 0), ('a,"b', 1, 0), ('a"b', 0, 0), ('x",y', 0, 0), ('""', 0, 1),
                                  ('"a""', 1, 0), ('b","c', 1, 1), ('"a" x,"b', 1, 1), ('x""y', 0, 1), ("", 0, 1)):
        assert (s.after(line, OUTSIDE), s.after(line, INSIDE)) == (outside, inside), line


def test_small_files_take_one_scan(spark, tmp_path):
    """What fits one range needs no pass over the quotes: the multi-line reader has the same rows."""
    path = tmp_path / "small.csv"
    path.write_text('a,b\n"x\ny",1\n')
    df = read_raw(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("x\ny", "1")]
    assert "MapInArrow" not in df._jdf.queryExecution().toString()


def test_source_is_read_by_many_tasks(spark, small_ranges, tmp_path):
    path = tmp_path / "sql_trace_summary.csv"
    rows = [f'"SELECT {i}\nFROM ""T""",srv{i % 3},"1.000,{i:02d}",{i}' for i in range(200)]
    path.write_text("SQLSTATEM,SERVERNAME,EXECTIME,TOTALEXEC\n" + "\n".join(rows) + "\n")
    df = load_source(spark, "sql_trace_summary", str(path))
    assert df.rdd.getNumPartitions() > 20
    got = {r["SQLSTATEM"]: r["TOTALEXEC"] for r in df.collect()}
    assert got == {f'SELECT {i}\nFROM "T"': float(i) for i in range(200)}


@pytest.mark.parametrize("seed", range(4))
def test_states_of_a_batch_are_those_of_its_lines(seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice(['"', '"', '""', ",", "a", "é", "\r"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    one, many = LineStates(), csv_ranges.BatchStates()
    outside, inside = many.ends(pa.array(lines))
    assert outside.tolist() == [bool(one.after(x, OUTSIDE)) for x in lines]
    assert inside.tolist() == [bool(one.after(x, INSIDE)) for x in lines]
    for state in (OUTSIDE, INSIDE):
        want, now = [], state
        for x in lines:
            now = one.after(x, now)
            want.append(bool(now))
        assert many.along(outside, inside, state).tolist() == want


def test_quoted_records_are_cut_by_the_batch(spark, small_ranges, tmp_path, monkeypatch):
    """No line goes through the line-by-line patterns."""
    monkeypatch.setattr(LineStates, "after", None)
    (tmp_path / "q.csv").write_text("a,b\n" + '"x ""1"",\ny",2\n' * 200)
    same(spark, str(tmp_path))
