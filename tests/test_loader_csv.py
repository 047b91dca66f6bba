"""CSV dialect of the exports: quoting, line breaks, missing-value texts, colliding headers; lazy report sections."""

import pytest

from loadlens.plans import reports
from loadlens.sources import load_source


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_quotes_and_line_breaks(spark, tmp_path):
    path = put(tmp_path, "trace.csv", 'SQLSTATEM,SERVERNAME,EXECTIME,TOTALEXEC\n'
               '"SELECT ""X"", Y FROM T",srv1,10,1\n'
               '"SELECT a\nFROM b",srv2,20,2\n'
               'plain,srv3,30,3\n')
    got = {r["SERVERNAME"]: (r["SQLSTATEM"], r["EXECTIME"]) for r in load_source(spark, "sql_trace_summary", path).collect()}
    assert got == {"srv1": ('SELECT "X", Y FROM T', 10.0), "srv2": ("SELECT a\nFROM b", 20.0), "srv3": ("plain", 30.0)}


def test_single_line_files_may_be_split(spark, tmp_path):
    path = put(tmp_path, "trace.csv", 'SQLSTATEM,SERVERNAME,EXECTIME,TOTALEXEC\n"a ""b""",s,1,1\n')
    rows = load_source(spark, "sql_trace_summary", path, multi_line=False).collect()
    assert [r["SQLSTATEM"] for r in rows] == ['a "b"']


def test_missing_value_texts(spark, tmp_path):
    path = put(tmp_path, "user.csv", "ACCOUNT,RESPTI,CPUTI,COUNT\nNULL,1,1,1\nN/A,2,2,1\nbob,3,NA,1\n\"\",4,4,1\nNone,5,5,1\n")
    rows = load_source(spark, "usertcode", path).collect()
    assert [(r["ACCOUNT"], r["RESPTI"], r["CPUTI"]) for r in rows] == [("bob", 3.0, 0.0)]


def test_colliding_headers_raise(spark, tmp_path):
    path = put(tmp_path, "memory.csv", "ACCOUNT,USED BYTES,USED-BYTES\na,1,2\n")
    with pytest.raises(ValueError, match="both clean to"):
        load_source(spark, "memory", path)


def test_sections_run_no_job_while_built(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 0.0)],
                               "ACCOUNT string, USEDBYTES double, MAXBYTES double, PRIVSUM double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sections", "building sections")
    out = reports.memory_section({"memory": df})
    assert not tracker.getJobIdsForGroup("sections")
    assert all(t.count() == 0 for t in out.values())  # no evidence: every output is empty
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
