"""Loader (CSV exports against declared schemas) and report sections end to end."""

import datetime as dt

import pandas as pd
import pytest

from loadlens.plans import reports
from loadlens.sources import CATALOG, all_empty, load_all, load_source, preview, profile


def write_csv(tmp_path, name, frame: pd.DataFrame) -> str:
    p = tmp_path / f"{name}.csv"
    frame.to_csv(p, index=False)
    return str(p)


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    paths = {}
    paths["memory"] = write_csv(d, "memory", pd.DataFrame({
        "ACCOUNT ": ["alice", "bob", "alice", "", "carol", "bob"],
        "USEDBYTES": ["1048576", "2097152", "x", "1048576", "3145728", "1048576"],
        "MAXBYTES": ["10", "20", "30", "40", "50", "60"],
        "PRIVSUM": ["1", "1", "1", "1", "1", "1"],
        "ENDDATE": ["20240131"] * 6,
        "ENDTIME": ["93015", "93500", "101000", "235959", "5", "250000"],
    }))
    paths["hitlist_db"] = write_csv(d, "hitlist", pd.DataFrame({
        "ACCOUNT": ["alice", "bob", "alice", "bob", "carol"],
        "REPORT": ["R1", "R2", "R1", "R3", "R2"],
        "RESPTI": ["100", "200", "300", "10000", "50"],
        "CPUTI": ["10", "20", "30", "40", "50"],
        "DBCALLS": ["1", "2", "3", "4", "5"],
        "ROLLOUTCNT": ["0", "1", "0", "2", "3"],
        "ENDDATE": ["20240131", "20240131", "20240131", "20240131", "bad"],
        "ENDTIME": ["10000", "20000", "30000", "40000", "50000"],
    }))
    paths["times"] = write_csv(d, "times", pd.DataFrame({
        "TIME": ["00--06", "06--07", "06--07", "23--00"],
        "PHYCALLS": ["5", "1", "2", "3"], "RESPTI": ["1000", "2000", "4000", "3000"],
        "CPUTI": ["100", "200", "300", "400"], "PROCTI": ["10", "20", "30", "40"],
        "READDIRCNT": ["1", "1", "1", "1"], "READSEQCNT": ["2", "2", "2", "2"], "CHNGCNT": ["0", "0", "0", "9"],
        "COUNT": ["1", "1", "1", "1"],
    }))
    paths["usertcode"] = write_csv(d, "usertcode", pd.DataFrame({
        "ACCOUNT": ["alice", None, "bob", "alice"], "REPORT": ["R1", "R2", "R1", "R2"],
        "RESPTI": ["100", "200", "300", "0"], "CPUTI": ["10", "0", "30", "40"], "COUNT": ["1", "1", "1", "1"],
        "ENTRY_ID": ["E1", "E2", "E3", "E4"],
        "ENDDATE": ["20240131"] * 4, "ENDTIME": ["93015", "93015", "153000", "235900"],
    }))
    paths["performance"] = write_csv(d, "perf", pd.DataFrame({
        "WP_TYP": ["DIA", "BTC", "DIA", "UPD"], "WP_CPU": ["01:30", "00:10", "bad", "2"],
        "WP_STATUS": ["run", "wait", "run", "run"],
    }))
    paths["sql_trace_summary"] = write_csv(d, "sqltrace", pd.DataFrame({
        "SQLSTATEM": ["SELECT a", "SELECT b", "SELECT a"], "SERVERNAME": ["ecc-ve7-00", "other", "ECC-VE7-00x"],
        "EXECTIME": ["1.234,5", "10", "1 000,5"], "TOTALEXEC": ["1", "2", "3"],
        "TIMEPEREXE": ["1,5", "2,5", "3,5"], "RECPROCNUM": ["7", "8", "9"], "AVGTPERREC": ["1,0", "5,0", "3,0"],
    }))
    paths["usr02"] = write_csv(d, "usr02", pd.DataFrame({
        "BNAME": ["alice", "bob", "carol", "dave"], "USTYP": ["A", "A", "B", "S"],
        "GLTGB": ["20240131", "00000000", "99991231", "20240131"],
    }))
    paths["tasktimes"] = write_csv(d, "tasktimes", pd.DataFrame({
        "ENTRY_ID": ["T1", "T2", "T1", None], "TIME": ["06--07"] * 4,
        "RESPTI": ["100", "400", "300", "900"], "PROCTI": ["1", "2", "3", "4"], "CPUTI": ["10", "20", "30", "40"],
        "QUEUETI": ["0", "0", "0", "0"], "PHYCALLS": ["5", "1", "5", "9"], "COUNT": ["1", "1", "1", "1"],
    }))
    return paths


@pytest.fixture(scope="module")
def dfs(spark, exports):
    return load_all(spark, exports)


def test_types_and_cleaning(dfs):
    m = dfs["memory"]
    types = dict(m.dtypes)
    assert types["USEDBYTES"] == "double" and types["FULL_DATETIME"] == "timestamp_ntz"
    assert "ACCOUNT" in m.columns                         # header " ACCOUNT " cleaned
    got = {(r["ACCOUNT"], r["USEDBYTES"], r["FULL_DATETIME"]) for r in m.collect()}
    assert ("Compte Inconnu", 1048576.0, dt.datetime(2024, 1, 31, 23, 59, 59)) in got
    assert ("alice", 0.0, dt.datetime(2024, 1, 31, 10, 10)) in got      # bad number -> 0
    assert ("bob", 1048576.0, None) in got                              # hour 25 -> null time


def test_hitlist_drops_rows_without_time(dfs):
    h = dfs["hitlist_db"]
    assert h.count() == 4 and h.filter("ACCOUNT = 'carol'").count() == 0


def test_usertcode_drops_missing_account_before_cleaning(dfs):
    u = dfs["usertcode"]
    assert sorted(r["ACCOUNT"] for r in u.collect()) == ["alice", "alice", "bob"]


def test_missing_file_gives_empty_declared_table(spark, dfs, tmp_path):
    t = load_source(spark, "tasktimes", str(tmp_path / "missing.csv"))
    assert t.isEmpty() and "RESPTI" in t.columns
    assert all_empty({"tasktimes": t}) and not all_empty(dfs)


def test_tasks_section(dfs):
    out = reports.tasks_section(dfs)
    long = {(r["ENTRY_ID"], r["variable"]): r["value"] for r in out["mean_times_by_entry_long"].collect()}
    assert long[("T2", "RESPTI")] == 400.0 and long[("T1", "RESPTI")] == 200.0
    assert None not in {k[0] for k in long}                 # raw ENTRY_ID: null keys never form a group
    assert [(r["ENTRY_ID"], r["PHYCALLS"]) for r in out["top_entries_by_phycalls"].collect()] == [("T1", 10.0),
                                                                                                 ("T2", 1.0)]


def test_duration_and_default_columns(dfs):
    p = dfs["performance"]
    assert sorted(r["WP_CPU_SECONDS"] for r in p.collect()) == [0.0, 2.0, 10.0, 90.0]
    assert {r["WP_IWAIT"] for r in p.collect()} == {0.0}


def test_european_numbers(dfs):
    q = {r["SQLSTATEM"]: r for r in dfs["sql_trace_summary"].filter("SERVERNAME != 'other'").collect()}
    assert sorted(r["EXECTIME"] for r in dfs["sql_trace_summary"].collect()) == [10.0, 1000.5, 1234.5]
    assert q["SELECT a"]["TIMEPEREXE"] in (1.5, 3.5)


def test_user_dates(dfs):
    u = {r["BNAME"]: r["GLTGB_DATE"] for r in dfs["usr02"].collect()}
    assert u == {"alice": dt.date(2024, 1, 31), "bob": None, "carol": dt.date(9999, 12, 31),
                 "dave": dt.date(2024, 1, 31)}


def test_preview_and_profile(dfs):
    p = preview(dfs["usr02"], 2, drop=["GLTGB"], order_by=["BNAME"])
    assert [r["BNAME"] for r in p.collect()] == ["alice", "bob"] and "GLTGB" not in p.columns
    prof = {r["column"]: r for r in profile(dfs["usr02"]).collect()}
    assert prof["GLTGB_DATE"]["non_null"] == 3 and prof["GLTGB_DATE"]["rows"] == 4
    assert prof["GLTGB_DATE"]["dtype"] == "date"


def test_unsupported_extension_gives_empty(spark, tmp_path):
    p = tmp_path / "x.xlsx"
    p.write_text("no")
    assert load_source(spark, CATALOG["memory"], str(p)).isEmpty()


def test_kpis(spark, dfs):
    k = reports.kpi_section(spark, dfs)
    r = k["kpis"].first()
    assert r["avg_resp_s"] == pytest.approx((100 + 200 + 300 + 10000) / 4 / 1000)
    assert r["total_db_calls"] == 10.0
    assert r["total_sql_execs"] == 6.0
    assert r["avg_mem_mib"] == pytest.approx((1 + 2 + 0 + 1 + 3 + 1) / 6)
    lab = k["kpi_labels"].first()
    assert lab["total_db_calls"] == "10" and lab["avg_resp_s"] == "2.65"


def test_filter_options_and_filters(spark, dfs):
    opts = reports.filter_options(dfs)
    assert [r[0] for r in opts["accounts"].collect()] == ["Compte Inconnu", "alice", "bob", "carol"]
    assert [r[0] for r in opts["reports"].collect()] == ["R1", "R2", "R3"]
    assert [r[0] for r in reports.filter_options(dfs, ["alice"])["reports"].collect()] == ["R1"]
    f = reports.apply_filters(dfs, reports.Filters(accounts=["alice"], reports=["R1"]))
    assert {r["ACCOUNT"] for r in f["hitlist_db"].collect()} == {"alice"}
    assert f["memory"].count() == 2


def test_memory_section(dfs):
    out = reports.memory_section(dfs)
    top = out["top_accounts_by_usedbytes"].collect()
    assert [r["ACCOUNT"] for r in top][:2] == ["bob", "carol"]
    avg = out["avg_usedbytes_by_account"].collect()
    assert "Compte Inconnu" not in [r["account_label"] for r in avg]
    hours = [r["FULL_DATETIME"].hour for r in out["hourly_usedbytes"].collect()]
    assert hours == [0, 9, 10, 23]                     # time "5" pads to 00:00:05; hour 25 is dropped
    assert dict(out["hourly_usedbytes"].dtypes)["FULL_DATETIME"] == "timestamp_ntz"
    assert out["usedbytes_density"].count() == 500


def test_transactions_section(dfs):
    out = reports.transactions_section(dfs)
    b = out["resp_by_hour_bucket"].collect()
    assert len(b) == 19
    by = {r["hour_bucket"]: r["RESPTI"] for r in b}
    assert by["09--10"] == 100.0 and by["15--16"] == 300.0 and by["23--00"] == 0.0 and by["00--06"] == 0.0
    shares = [r["share"] for r in out["top_reports_by_resp"].collect()]
    assert sum(shares) == pytest.approx(1.0)
    pts = out["cpu_vs_resp_points"].collect()
    assert {r["ENTRY_ID"] for r in pts} == {"E1", "E3"}


def test_hourly_section(dfs):
    out = reports.hourly_section(dfs)
    ph = {r["TIME"]: r["PHYCALLS"] for r in out["phycalls_by_time"].collect()}
    assert len(ph) == 19 and ph["06--07"] == 3.0 and ph["07--08"] == 0.0 and ph["23--00"] == 3.0
    io = out["top_times_by_total_io"].collect()
    assert io[0]["TIME"] == "23--00" and io[0]["TOTAL_IO"] == 12.0
    long = out["mean_times_by_time_long"].collect()
    assert [r["TIME"] for r in long][0] == "00--06"
    assert {(r["TIME"], r["variable"]): r["value"] for r in long}[("06--07", "RESPTI")] == 3.0


def test_hitlist_workprocess_sqltrace_users(dfs):
    h = reports.hitlist_section(dfs)
    assert [r["REPORT"] for r in h["top_reports_by_dbcalls"].collect()] == ["R1", "R3", "R2"]
    w = reports.workprocess_section(dfs)
    assert [(r["WP_TYP"], r["count"]) for r in w["count_by_type"].collect()] == [("DIA", 2), ("BTC", 1), ("UPD", 1)]
    q = reports.sqltrace_section(dfs)
    assert [r["SQLSTATEM"] for r in q["top_statements_by_exectime"].collect()] == ["SELECT a", "SELECT b"]
    assert q["avg_time_per_record_density"].count() == 500      # two matching servers, values 1 and 3
    u = reports.users_section(dfs)
    assert u["users_without_date_count"].first()["count"] == 1
    u2 = reports.users_section(dfs, max_valid_date="2262-04-11")
    assert u2["users_without_date_count"].first()["count"] == 2


def test_anomaly_section(dfs):
    out = reports.anomaly_section(dfs, m=1.0)
    a = out["anomalies"].collect()
    assert [r["RESPTI"] for r in a] == [10000.0]
    ov = out["overlay"].collect()
    assert sum(r["is_anomaly"] for r in ov) == 1 and len(ov) == 4
    assert out["threshold"].first()["n_anomalies"] == 1


def test_report_section_choice(spark, dfs):
    assert set(reports.report(spark, dfs, sections=[])) == {"kpis"}
    assert set(reports.report(spark, dfs, sections=["users"])) == {"kpis", "users"}


def test_full_report_runs(spark, dfs):
    rep = reports.report(spark, dfs, reports.Filters(accounts=["alice", "bob"]))
    for section, outs in rep.items():
        for name, df in outs.items():
            df.collect()


def test_typed_parquet_export(spark, tmp_path):
    src = spark.createDataFrame(
        [("alice", 1048576.0, dt.datetime(2024, 1, 31, 9, 30)), ("bob", None, None)],
        "ACCOUNT string, USEDBYTES double, FULL_DATETIME timestamp_ntz")
    path = str(tmp_path / "memory.parquet")
    src.write.parquet(path)
    m = load_source(spark, "memory", path)
    types = dict(m.dtypes)
    assert types["USEDBYTES"] == "double" and types["FULL_DATETIME"] == "timestamp_ntz"
    got = sorted((r["ACCOUNT"], r["USEDBYTES"], r["FULL_DATETIME"]) for r in m.collect())
    assert got == [("alice", 1048576.0, dt.datetime(2024, 1, 31, 9, 30)), ("bob", 0.0, None)]


def test_text_datetime_fallback(spark, tmp_path):
    path = write_csv(tmp_path, "mem", pd.DataFrame({"ACCOUNT": ["a", "b"], "USEDBYTES": ["1", "2"],
                                                    "FULL_DATETIME": ["2024-01-31 09:30:00", "garbage"]}))
    m = load_source(spark, "memory", path)
    assert sorted((r["ACCOUNT"], r["FULL_DATETIME"]) for r in m.collect()) == [
        ("a", dt.datetime(2024, 1, 31, 9, 30)), ("b", None)]


def test_command_line(spark, exports, capsys):
    from loadlens.__main__ import main
    args = [f"--source={k}={v}" for k, v in exports.items()] + ["--accounts", "alice,bob", "--section", "kpis",
                                                                 "--section", "hitlist", "--rows", "3"]
    assert main(args) == 0
    out = capsys.readouterr().out
    assert "== kpis / kpis" in out and "== hitlist / top_reports_by_dbcalls" in out and "memory" not in out


def test_format_detection_and_dataset_folders(spark, tmp_path):
    from loadlens.sources.loader import detect_format
    assert detect_format("/x/memory.csv") == "csv" and detect_format("/x/memory.csv.gz") == "csv"
    assert detect_format("/x/memory.parquet") == "parquet" and detect_format("/x/exports/memory/") == "parquet"
    with pytest.raises(ValueError):
        detect_format("/x/memory.xlsx")
    folder = tmp_path / "memory"          # a dataset folder of part files, no extension
    spark.createDataFrame([("alice", "5")], "ACCOUNT string, USEDBYTES string").repartition(2).write.parquet(str(folder))
    m = load_source(spark, "memory", str(folder))
    assert [(r["ACCOUNT"], r["USEDBYTES"]) for r in m.collect()] == [("alice", 5.0)]


def test_ml_section(spark, dfs):
    from pyspark.sql import functions as F
    u = spark.range(0, 300).select(
        (F.col("id") % 4).cast("string").alias("ACCOUNT"), (F.col("id") % 10 * 10.0).alias("CPUTI"),
        (F.col("id") % 10 * 25.0 + F.col("id") % 4).alias("RESPTI"), F.lit(1.0).alias("COUNT"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(31), F.col("id") % 24, F.lit(0), F.lit(0)).alias("FULL_DATETIME"))
    out = reports.ml_section({"usertcode": u}, "RESPTI", "usertcode", num_trees=5, max_depth=4)
    m = out["metrics"].first()
    assert m["n_train"] + m["n_test"] == 300 and m["r2"] > 0.5
    assert {r["feature"] for r in out["dropped_features"].collect()} == {"COUNT", "FULL_DATETIME"}
    assert out["trend_line"].count() == 1 and out["importances"].count() == 5   # CPUTI + 4 accounts
    with pytest.raises(ValueError):
        reports.ml_section(dfs, "ACCOUNT", "usertcode")
    with pytest.raises(ValueError):                    # one row: nothing to train on
        reports.ml_section({"usertcode": u.limit(1)}, "RESPTI", "usertcode", num_trees=2)


def test_wide_hitlist_export(spark, tmp_path):
    from loadlens.sources.specs import HITLIST_NUMERIC
    cols = {c: [str(i), "bad"] for i, c in enumerate(HITLIST_NUMERIC)}
    cols.update({"ACCOUNT": ["a", None], "REPORT": ["R", "S"], "ENDDATE": ["20240131", "20240131"],
                 "ENDTIME": ["93015", "101500"]})
    path = write_csv(tmp_path, "hit_wide", pd.DataFrame(cols))
    h = load_source(spark, "hitlist_db", path)
    assert len(HITLIST_NUMERIC) == 83
    types = dict(h.dtypes)
    assert all(types[c] == "double" for c in HITLIST_NUMERIC)
    rows = sorted(h.collect(), key=lambda r: r["REPORT"])
    assert rows[0]["VMC_ELAP_TIME"] == 82.0 and rows[1]["VMC_ELAP_TIME"] == 0.0
    assert rows[1]["ACCOUNT"] == "Non défini"
    prof = profile(h).collect()
    assert len(prof) == len(h.columns) and all(r["rows"] == 2 for r in prof)
