"""One registered query per report section: the section functions themselves, on exports built from the test tables.

Every table behind the section's charts is brought into one long form (output, key, metric, value) and compared with
SQL that states the section anew. The density curves have queries of their own in the catalog; here only their number
of points counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.functions.timebuckets import hour_bucket
from loadlens.operators import aggregates as agg
from loadlens.operators import regression
from loadlens.plans import reports
from loadlens.plans.catalog import SQL_SPINE, register, sql_bucket, table
from loadlens.session import checkpoint_dir
from loadlens.sources.loader import all_empty, clean_frame, load_all
from loadlens.sources.specs import CATALOG
from loadlens.sources.store import Store

DIGITS = 3


def _long(output: str, df: DataFrame, key: str, *metrics: str, digits: int = DIGITS) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics])).alias("m")
    return df.select(F.lit(output).alias("output"), F.col(key).cast("string").alias("key"), cells) \
        .select("output", "key", "m.metric", F.round("m.value", digits).alias("value"))


def _already_long(output: str, df: DataFrame, key: str) -> DataFrame:
    return df.select(F.lit(output).alias("output"), F.col(key).cast("string").alias("key"),
                     F.col("variable").alias("metric"), F.round("value", DIGITS).alias("value"))


def _count(output: str, df: DataFrame) -> DataFrame:
    return df.agg(F.lit(output).alias("output"), F.lit("all").alias("key"), F.lit("rows").alias("metric"),
                  F.count(F.lit(1)).cast("double").alias("value"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sql(output: str, key: str, source: str, metrics: dict[str, str], shown: list[str] | None = None,
         order: str | None = None, k: int | None = None, digits: int = DIGITS) -> str:
    """The groups of ``source`` by ``key`` (the k largest by ``order``), a row for each shown metric."""
    cols = ", ".join(f"{e} AS {m}" for m, e in metrics.items())
    top = f" ORDER BY {order} DESC, key LIMIT {k}" if k else ""
    g = f"SELECT CAST({key} AS VARCHAR) AS key, {cols} FROM {source} GROUP BY 1{top}"
    return "\nUNION ALL ".join(
        f"SELECT '{output}' AS output, key, '{m}' AS metric, round(CAST({m} AS DOUBLE), {digits}) AS value FROM ({g}) g"
        for m in (shown or metrics))


def _sql_count(output: str, source: str) -> str:
    return (f"SELECT '{output}' AS output, 'all' AS key, 'rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value "
            f"FROM ({source}) s")


def _all(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


# --- memory -----------------------------------------------------------------------------

_MEMORY = ("(SELECT CASE WHEN l_returnflag = 'R' THEN 'Compte Inconnu' ELSE CAST(l_suppkey AS VARCHAR) END AS acc, * "
           "FROM lineitem) m")
_SUMS = {"USEDBYTES": "SUM(l_extendedprice)", "MAXBYTES": "SUM(l_quantity)", "PRIVSUM": "SUM(l_tax)"}


@register("R_memory_section", _all(
    _sql("top", "acc", _MEMORY, _SUMS, order="USEDBYTES", k=10),
    _sql("long", "acc", _MEMORY, _SUMS, order="USEDBYTES", k=10),
    _sql("mean", "acc", f"(SELECT * FROM {_MEMORY} WHERE acc <> 'Compte Inconnu') k",
         {"USEDBYTES": "AVG(l_extendedprice)", "n": "COUNT(*)"}, ["USEDBYTES"], "n", 6),
    "SELECT 'density' AS output, 'all' AS key, 'rows' AS metric, 500.0 AS value",
    _sql("hourly", "strftime(date_trunc('hour', l_shipdate), '%Y-%m-%d %H:00:00')", "lineitem",
         {"USEDBYTES": "AVG(l_extendedprice)"}, digits=6)))
def r_memory(spark, d):
    li = table(spark, d, "lineitem")
    account = F.when(F.col("l_returnflag") == "R", F.lit("Compte Inconnu")).otherwise(F.col("l_suppkey").cast("string"))
    out = reports.memory_section({"memory": li.select(
        account.alias("ACCOUNT"), F.col("l_extendedprice").alias("USEDBYTES"), F.col("l_quantity").alias("MAXBYTES"),
        F.col("l_tax").alias("PRIVSUM"), F.col("l_shipdate").alias("FULL_DATETIME"))})
    hourly = out["hourly_usedbytes"].withColumn("h", F.date_format("FULL_DATETIME", "yyyy-MM-dd HH:00:00"))
    return _union(_long("top", out["top_accounts_by_usedbytes"], "ACCOUNT", "USEDBYTES", "MAXBYTES", "PRIVSUM"),
                  _already_long("long", out["memory_metrics_long"], "ACCOUNT"),
                  _long("mean", out["avg_usedbytes_by_account"], "account_label", "USEDBYTES"),
                  _count("density", out["usedbytes_density"]), _long("hourly", hourly, "h", "USEDBYTES", digits=6))


# --- transactions -----------------------------------------------------------------------

_IO = {"READDIRCNT": "SUM(value)", "READSEQCNT": "SUM(user_id)", "CHNGCNT": "SUM(1.0)", "PHYREADCNT": "SUM(value * 2)"}
_BUF = {"READDIRBUF": "SUM(value)", "READDIRREC": "SUM(value * 3)", "READSEQBUF": "SUM(user_id)",
        "READSEQREC": "SUM(user_id * 2)", "CHNGREC": "SUM(1.0)", "PHYCHNGREC": "SUM(2.0)"}
_COMM = {"DSQLCNT": "SUM(value)", "SLI_CNT": "SUM(user_id)"}


@register("R_transactions_section", _all(
    _sql("cpu", "user_id", "events", {"CPUTI": "AVG(value * 2)", "cpu_seconds": "AVG(value * 2) / 1000"},
         order="CPUTI", k=10),
    f"SELECT 'resp' AS output, key, 'share' AS metric, round(v / SUM(v) OVER (), {DIGITS}) AS value FROM ("
    "SELECT event_type AS key, AVG(value) AS v FROM events GROUP BY 1 ORDER BY v DESC, key LIMIT 10) r",
    _sql("count", "user_id", "events", {"n_transactions": "COUNT(*)"}, order="n_transactions", k=10),
    f"SELECT 'bucket', s.TIME_RANGE, 'RESPTI_SECONDS', round(COALESCE(AVG(e.value), 0) / 1000, {DIGITS}) "
    f"FROM ({SQL_SPINE}) s LEFT JOIN (SELECT {sql_bucket('ts')} AS b, value FROM events) e ON e.b = s.TIME_RANGE GROUP BY 2",
    _sql_count("points", "SELECT 1 FROM events WHERE value > 0"),
    _sql("io", "user_id", "events", _IO, order="PHYREADCNT", k=10),
    _sql("buffers", "user_id", "events", _BUF, order="READDIRREC", k=10),
    _sql("calls", "user_id", "events", _COMM, order="DSQLCNT", k=4)))
def r_transactions(spark, d):
    v, u = F.col("value"), F.col("user_id").cast("double")
    out = reports.transactions_section({"usertcode": table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("ACCOUNT"), F.col("event_type").alias("REPORT"), (v * 2).alias("CPUTI"),
        v.alias("RESPTI"), F.col("ts").alias("FULL_DATETIME"), v.alias("READDIRCNT"), u.alias("READSEQCNT"),
        F.lit(1.0).alias("CHNGCNT"), (v * 2).alias("PHYREADCNT"), v.alias("READDIRBUF"), (v * 3).alias("READDIRREC"),
        u.alias("READSEQBUF"), (u * 2).alias("READSEQREC"), F.lit(1.0).alias("CHNGREC"), F.lit(2.0).alias("PHYCHNGREC"),
        v.alias("DSQLCNT"), u.alias("SLI_CNT"))})
    return _union(_long("cpu", out["top_accounts_by_cpu"], "ACCOUNT", "CPUTI", "cpu_seconds"),
                  _long("resp", out["top_reports_by_resp"], "REPORT", "share"),
                  _long("count", out["transactions_per_account"], "ACCOUNT", "n_transactions"),
                  _long("bucket", out["resp_by_hour_bucket"], "hour_bucket", "RESPTI_SECONDS"),
                  _count("points", out["cpu_vs_resp_points"]),
                  _already_long("io", out["io_counts_long"], "ACCOUNT"),
                  _already_long("buffers", out["io_buffers_records_long"], "ACCOUNT"),
                  _already_long("calls", out["comm_metrics_long"], "ACCOUNT"))


# --- hourly -----------------------------------------------------------------------------

_TIMES = f"(SELECT {sql_bucket('ts')} AS b, * FROM events) t"


@register("R_hourly_section", _all(
    f"SELECT 'calls' AS output, s.TIME_RANGE AS key, 'PHYCALLS' AS metric, round(COALESCE(SUM(t.value), 0), {DIGITS}) AS value "
    f"FROM ({SQL_SPINE}) s LEFT JOIN {_TIMES} ON t.b = s.TIME_RANGE GROUP BY 2",
    _sql("io", "b", _TIMES, {"TOTAL_IO": "SUM(value + user_id + 1)"}, order="TOTAL_IO", k=5),
    _sql("times", "b", _TIMES, {"RESPTI": "AVG(value) / 1000", "CPUTI": "AVG(user_id) / 1000",
                                "PROCTI": "AVG(event_id) / 1000"})))
def r_hourly(spark, d):
    ev = table(spark, d, "events")
    out = reports.hourly_section({"times": ev.select(
        hour_bucket("ts").alias("TIME"), F.col("value").alias("PHYCALLS"), F.col("value").alias("READDIRCNT"),
        F.col("user_id").cast("double").alias("READSEQCNT"), F.lit(1.0).alias("CHNGCNT"), F.col("value").alias("RESPTI"),
        F.col("user_id").cast("double").alias("CPUTI"), F.col("event_id").cast("double").alias("PROCTI"))})
    return _union(_long("calls", out["phycalls_by_time"], "TIME", "PHYCALLS"),
                  _long("io", out["top_times_by_total_io"], "TIME", "TOTAL_IO"),
                  _already_long("times", out["mean_times_by_time_long"], "TIME"))


# --- tasks, hit list ----------------------------------------------------------------------

@register("R_tasks_section", _all(
    _sql("times", "l_partkey", "lineitem", {"RESPTI": "AVG(l_extendedprice)", "PROCTI": "AVG(l_quantity)",
                                            "CPUTI": "AVG(l_discount)", "QUEUETI": "AVG(l_tax)"}, order="RESPTI", k=10),
    _sql("calls", "l_partkey", "lineitem", {"PHYCALLS": "SUM(l_quantity)"}, order="PHYCALLS", k=10)))
def r_tasks(spark, d):
    out = reports.tasks_section({"tasktimes": table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("ENTRY_ID"), F.col("l_extendedprice").alias("RESPTI"),
        F.col("l_quantity").alias("PROCTI"), F.col("l_discount").alias("CPUTI"), F.col("l_tax").alias("QUEUETI"),
        F.col("l_quantity").alias("PHYCALLS"))})
    return _union(_already_long("times", out["mean_times_by_entry_long"], "ENTRY_ID"),
                  _long("calls", out["top_entries_by_phycalls"], "ENTRY_ID", "PHYCALLS"))


@register("R_hitlist_section", _all(
    _sql("times", "o_orderpriority", "orders", {"RESPTI": "AVG(o_totalprice)", "CPUTI": "AVG(o_custkey)"},
         order="RESPTI", k=10),
    _sql("calls", "o_orderpriority", "orders", {"DBCALLS": "SUM(o_totalprice)"}, order="DBCALLS", k=10),
    _sql("rollouts", "o_custkey", "orders", {"ROLLOUTCNT": "SUM(o_totalprice)"}, order="ROLLOUTCNT", k=10)))
def r_hitlist(spark, d):
    out = reports.hitlist_section({"hitlist_db": table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("REPORT"), F.col("o_custkey").cast("string").alias("ACCOUNT"),
        F.col("o_totalprice").alias("RESPTI"), F.col("o_custkey").cast("double").alias("CPUTI"),
        F.col("o_totalprice").alias("DBCALLS"), F.col("o_totalprice").alias("ROLLOUTCNT"))})
    return _union(_already_long("times", out["mean_times_by_report_long"], "REPORT"),
                  _long("calls", out["top_reports_by_dbcalls"], "REPORT", "DBCALLS"),
                  _long("rollouts", out["top_accounts_by_rollouts"], "ACCOUNT", "ROLLOUTCNT"))


# --- work processes and SQL trace: text cells through the source's cleaning (C9, C10) --------

_WP = "(SELECT event_type, minute(ts) * 60 + second(ts) AS s FROM events WHERE event_type <> 'error') w"


@register("R_workprocess_section", _all(
    _sql("count", "event_type", _WP, {"count": "COUNT(*)"}),
    _sql("mean", "event_type", _WP, {"WP_CPU_SECONDS": "AVG(s)"}),
    "SELECT 'density' AS output, 'all' AS key, 'rows' AS metric, 500.0 AS value",
    "SELECT 'default' AS output, '0.0' AS key, 'WP_IWAIT' AS metric, 0.0 AS value"))
def r_workprocess(spark, d):
    ev = table(spark, d, "events")
    # rows without a status go: usual cells are kept whatever their text, so the status is missing before cleaning
    raw = ev.filter(F.col("event_type") != "error").select(
        F.col("event_type").alias("WP_TYP"), F.date_format("ts", "mm:ss").alias("WP_CPU"), F.lit("run").alias("WP_STATUS"))
    wp = clean_frame(raw, CATALOG["performance"])
    out = reports.workprocess_section({"performance": wp})
    default = wp.select(F.col("WP_IWAIT").cast("string").alias("k"), "WP_IWAIT").distinct()
    return _union(_long("count", out["count_by_type"], "WP_TYP", "count"),
                  _long("mean", out["mean_cpu_by_type"], "WP_TYP", "WP_CPU_SECONDS"),
                  _count("density", out["cpu_seconds_density"]), _long("default", default, "k", "WP_IWAIT"))


_TRACE = "(SELECT source, n_chars, doc_id, lang FROM documents WHERE lang IS NOT NULL) t"


@register("R_sqltrace_section", _all(
    _sql("exec", "source", _TRACE, {"EXECTIME": "SUM(n_chars + 0.5)"}, order="EXECTIME", k=10),
    _sql("per", "source", _TRACE, {"TIMEPEREXE": "AVG(doc_id)"}, order="TIMEPEREXE", k=10),
    _sql("records", "source", _TRACE, {"RECPROCNUM": "SUM(n_chars)"}, order="RECPROCNUM", k=10),
    "SELECT 'density' AS output, 'all' AS key, 'rows' AS metric, 500.0 AS value"))
def r_sqltrace(spark, d):
    docs = table(spark, d, "documents").filter(F.col("lang").isNotNull())
    raw = docs.select(F.col("source").alias("SQLSTATEM"), F.concat(F.col("n_chars").cast("string"), F.lit(",5")).alias("EXECTIME"),
                      F.col("doc_id").cast("string").alias("TIMEPEREXE"), F.col("n_chars").cast("string").alias("RECPROCNUM"),
                      F.lit("1").alias("TOTALEXEC"), F.col("n_chars").cast("string").alias("AVGTPERREC"),
                      F.when(F.col("lang") == "en", F.lit("ecc-ve7-00_A")).otherwise(F.lit("other")).alias("SERVERNAME"))
    out = reports.sqltrace_section({"sql_trace_summary": clean_frame(raw, CATALOG["sql_trace_summary"])})
    return _union(_long("exec", out["top_statements_by_exectime"], "statement_label", "EXECTIME"),
                  _long("per", out["top_statements_by_time_per_exec"], "statement_label", "TIMEPEREXE"),
                  _long("records", out["top_statements_by_records"], "statement_label", "RECPROCNUM"),
                  _count("density", out["avg_time_per_record_density"]))


# --- users, anomalies -----------------------------------------------------------------------

_CHOSEN = ["1-URGENT", "2-HIGH"]
_USERS = ("(SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END "
          "AS day FROM orders) u")
_PICKED = f"(SELECT * FROM {_USERS} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) p"


@register("R_users_section", _all(
    _sql("types", "o_orderstatus", _PICKED, {"count": "COUNT(*)"}),
    _sql("dates", "day", f"(SELECT * FROM {_PICKED} WHERE day IS NOT NULL) q", {"count": "COUNT(*)"}),
    _sql_count("without", f"SELECT 1 FROM {_USERS} WHERE day IS NULL"),
    "SELECT 'counted', 'all', 'rows', CAST(COUNT(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'"))
def r_users(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderstatus") == "P", F.lit("00000000")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    users = clean_frame(o.select(F.col("o_orderpriority").alias("BNAME"), F.col("o_orderstatus").alias("USTYP"),
                                 date.alias("GLTGB")), CATALOG["usr02"])
    out = reports.users_section({"usr02": users}, reports.Filters(accounts=_CHOSEN))
    counted = out["users_without_date_count"].select(
        F.lit("counted").alias("output"), F.lit("all").alias("key"), F.lit("rows").alias("metric"),
        F.col("count").cast("double").alias("value"))
    return _union(_long("types", out["count_by_user_type"], "USTYP", "count"),
                  _long("dates", out["count_by_validity_date"], "GLTGB_DATE", "count"),
                  _count("without", out["users_without_date"]), counted)


_LIMIT = "(SELECT AVG(value) + 3 * STDDEV_SAMP(value) FROM events WHERE ts IS NOT NULL)"


@register("R_anomaly_section", f"""
SELECT 'limit' AS output, 'all' AS key, 'threshold' AS metric, round({_LIMIT}, {DIGITS}) AS value
UNION ALL SELECT 'limit', 'all', 'n_anomalies', CAST(COUNT(*) AS DOUBLE) FROM events WHERE ts IS NOT NULL AND value > {_LIMIT}
UNION ALL SELECT 'rows', event_type, 'RESPTI', round(value, {DIGITS}) FROM events WHERE ts IS NOT NULL AND value > {_LIMIT}
UNION ALL SELECT 'overlay', 'all', 'rows', CAST(COUNT(*) AS DOUBLE) FROM events WHERE ts IS NOT NULL""")
def r_anomalies(spark, d):
    out = reports.anomaly_section({"hitlist_db": table(spark, d, "events").select(
        F.col("ts").alias("FULL_DATETIME"), F.col("value").alias("RESPTI"), F.col("event_type").alias("REPORT"))})
    limit = out["threshold"].withColumn("k", F.lit("all"))
    return _union(_long("limit", limit, "k", "threshold", "n_anomalies"), _long("rows", out["anomalies"], "REPORT", "RESPTI"),
                  _count("overlay", out["overlay"]))


# --- exports written as CSV and loaded again (S1-S4, C1, F14), critical columns (C9), a forced tree (P7-P12) ------------

_ORDERS = ("(SELECT CASE WHEN o_custkey % 11 = 0 THEN 'Compte Inconnu' ELSE 'a \"' || (o_custkey % 50) || '\",' || chr(10) || 'x' END "
           "AS acc, o_totalprice AS v, o_orderpriority AS p FROM orders) o")


@register("S_load_all_csv_exports", _all(
    _sql("memory", "acc", _ORDERS, {"USEDBYTES": "SUM(v)", "n": "COUNT(*)"}),
    _sql("tasks", "p", f"(SELECT * FROM {_ORDERS} WHERE p IN ('1-URGENT', '5-LOW')) t", {"RESPTI": "SUM(v)"}),
    "SELECT 'missing' AS output, 'performance' AS key, 'rows' AS metric, CAST(0 AS DOUBLE) AS value",
    "SELECT 'gate', 'all', 'empty', CAST(0 AS DOUBLE)"))
def r_load_csv(spark, d):
    """Tables written as CSV into the shared folder (headers to be cleaned, quoted line breaks, missing-value texts), read
    by ``load_all`` with a source that does not exist, and filtered by task type."""
    o = table(spark, d, "orders")
    account = F.when(F.col("o_custkey") % 11 == 0, F.lit("NULL")).otherwise(
        F.concat(F.lit('a "'), F.col("o_custkey") % 50, F.lit('",\nx')))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    o.select(account.alias(" ACCOUNT."), F.col("o_totalprice").alias("USEDBYTES "), F.lit("1").alias("(MAXBYTES)")) \
        .write.csv(f"{folder}/memory.csv", header=True, quote='"', escape='"')
    o.select(F.col("o_orderpriority").alias("TASKTYPE"), F.col("o_orderpriority").alias("TIME"),
             F.col("o_totalprice").alias("RESPTI"), F.lit("1").alias("COUNT"), F.lit("x").alias("CPUTI")) \
        .write.csv(f"{folder}/tasktimes.csv", header=True, quote='"', escape='"')
    frames = load_all(spark, {"memory": f"{folder}/memory.csv", "tasktimes": f"{folder}/tasktimes.csv",
                              "performance": f"{folder}/no-such-file.csv"})
    chosen = reports.apply_filters(frames, reports.Filters(tasktypes=["1-URGENT", "5-LOW"]))
    memory = agg.group_metrics(chosen["memory"], "ACCOUNT", [("USEDBYTES", "sum", "USEDBYTES"), ("n", "count", "*")])
    tasks = agg.group_metrics(chosen["tasktimes"], "TIME", [("RESPTI", "sum", "RESPTI")])
    gate = spark.range(1).select(F.lit("gate").alias("output"), F.lit("all").alias("key"), F.lit("empty").alias("metric"),
                                 F.lit(float(all_empty(frames))).alias("value"))
    missing = _count("missing", frames["performance"]).withColumn("key", F.lit("performance"))
    return _union(_long("memory", memory, "ACCOUNT", "USEDBYTES", "n"), _long("tasks", tasks, "TIME", "RESPTI"), missing, gate)


@register("C9_rows_without_critical_columns", """
SELECT 'usertcode' AS source, event_id, event_type AS account FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'hitlist_db', event_id, event_type FROM events WHERE user_id % 3 <> 0
UNION ALL SELECT 'memory', event_id, CASE WHEN event_type = 'error' THEN 'Compte Inconnu' ELSE event_type END FROM events""")
def c9(spark, d):
    """Rows with missing cells go into the sources' cleaning: an account that is cleaned after the drop drops its row, one
    that is cleaned before has a default; a date that cannot be read drops the row where it is critical."""
    ev = table(spark, d, "events")
    account = F.when(F.col("event_type") != "error", F.col("event_type"))
    day = F.when(F.col("user_id") % 3 == 0, F.lit("20241399")).otherwise(F.date_format("ts", "yyyyMMdd"))
    numbers = [F.lit("1").alias(c) for c in ("RESPTI", "PROCTI", "CPUTI", "DBCALLS", "COUNT", "USEDBYTES")]
    raw = {"usertcode": ev.select("event_id", account.alias("ACCOUNT"), *numbers),
           "hitlist_db": ev.select("event_id", F.col("event_type").alias("ACCOUNT"), *numbers, day.alias("ENDDATE"),
                                   F.date_format("ts", "Hmmss").alias("ENDTIME")),
           "memory": ev.select("event_id", account.alias("ACCOUNT"), *numbers)}
    return _union(*[clean_frame(df, CATALOG[name]).select(F.lit(name).alias("source"), "event_id",
                                                          F.col("ACCOUNT").alias("account")) for name, df in raw.items()])


@register("P7_P12_forced_split", """
SELECT 'importance' AS part, 'event_type=' || event_type AS key, CAST(event_type = 'click' AS DOUBLE) AS value
FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT 'prediction', CASE WHEN event_type = 'click' THEN '10.0' ELSE '20.0' END,
       CAST(CASE WHEN event_type = 'click' THEN 10.0 ELSE 20.0 END AS DOUBLE) FROM (SELECT DISTINCT event_type = 'click' AS c,
       CASE WHEN event_type = 'click' THEN 'click' ELSE 'other' END AS event_type FROM events)
UNION ALL SELECT 'metric', 'r2', CAST(1 AS DOUBLE) UNION ALL SELECT 'metric', 'mae', CAST(0 AS DOUBLE)""")
def forced_split(spark, d):
    """A target that one category decides: every tree has that one split, whatever the sample."""
    ev = table(spark, d, "events").select(
        "event_type", F.when(F.col("event_type") == "click", 10.0).otherwise(20.0).alias("target"))
    run = regression.fit_forest(ev, "target", num_trees=3)
    imp = regression.importances(run, top=None).select(F.lit("importance").alias("part"), F.col("feature").alias("key"),
                                                       F.col("importance").alias("value"))
    seen = run.predictions.select(F.lit("prediction").alias("part"), F.col("target").cast("string").alias("key"),
                                  F.col("prediction").alias("value")).distinct()
    m = regression.metrics(run)
    score = m.select(F.lit("metric").alias("part"), F.inline(F.array(
        *[F.struct(F.lit(c).alias("key"), F.round(c, 6).alias("value")) for c in ("r2", "mae")])))
    return _union(imp, seen, score)


# --- cleaned sources kept by day with a zone map (F11, X1, X2) -----------------------------------------------------------

def _store(spark, d) -> Store:
    """The events in two batches, the second taken in twice."""
    ev = table(spark, d, "events")
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", "ts", ["value"])
    store.ingest(ev.filter("event_id % 2 = 0"), "even")
    store.ingest(ev.filter("event_id % 3 = 0"), "odd")
    store.ingest(ev.filter("event_id % 2 = 1"), "odd")
    return store


@register("F11_trailing_ranges_from_store", "\nUNION ALL ".join(
    f"SELECT '{p}' AS period, event_id, value FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL {i}"
    for p, i in (("6h", "6 HOUR"), ("1d", "1 DAY"))))
def f11_store(spark, d):
    store = _store(spark, d)
    return _union(*[store.trailing_range(p).select(F.lit(p).alias("period"), "event_id", "value") for p in ("6h", "1d")])


@register("X2_anomalies_from_store", f"SELECT event_id, value FROM events WHERE ts IS NOT NULL AND value > {_LIMIT}")
def x2_store(spark, d):
    return _store(spark, d).anomalies("value", 3.0, ["event_id", "value"])
