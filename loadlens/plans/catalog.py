"""Registered queries over the shared test tables, each with its SQL oracle.

Every query reads whole tables (``region nation customer supplier part orders
lineitem events documents ...``) through the loadlens operators, with the
table columns standing in for the workload-export roles:

* ACCOUNT -> ``l_suppkey`` / ``user_id`` / ``o_custkey``; REPORT -> ``p_type`` / ``event_type``
* RESPTI, CPUTI, USEDBYTES -> ``events.value``, ``l_extendedprice``, ``l_quantity``
* FULL_DATETIME -> ``events.ts``; SQLSTATEM / EXECTIME -> ``documents.text`` / ``n_chars``
* BNAME / USTYP / GLTGB -> ``o_custkey`` / ``o_orderpriority`` / ``o_orderdate`` text

Sums and means run in exact mode (``decimal_scale=2``: every metric column of
the tables has two decimals), which makes them independent of partitioning and
bit-identical to the SQL; other floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.cleaning import (clean_string, compact_date, compact_datetime, eu_number, mm_ss_seconds,
                                         parse_datetime_column, parse_datetime_text, short_label, thousands_label, to_double)
from loadlens.operators import aggregates as agg
from loadlens.operators import anomaly, density, encoding, filters, kpis, timeseries
from loadlens.sources.loader import preview, profile

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}

DEC = 2          # decimal places of the metric columns (exact sums / means)
ROUND = 6        # rounding of non-exact floating results, both sides
ROUND_DENSITY = 12


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one shared table; the handle (and its file listing) is reused per session.

    Listing and footer reads are paid once per table instead of once per query —
    on a many-thousand-file table that is seconds per query.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


# --- SQL fragments for the oracle -------------------------------------------------

def xsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,{DEC}))) AS DOUBLE)"


def xavg(c: str) -> str:
    return f"{xsum(c)} / COUNT({c})"


def sql_bucket(ts: str) -> str:
    h = f"hour({ts})"
    return (f"CASE WHEN {ts} IS NULL THEN NULL WHEN {h} < 6 THEN '00--06' ELSE "
            f"lpad(CAST({h} AS VARCHAR), 2, '0') || '--' || lpad(CAST(({h} + 1) % 24 AS VARCHAR), 2, '0') END")


SQL_SPINE = ("SELECT CASE WHEN range < 6 THEN '00--06' ELSE lpad(CAST(range AS VARCHAR), 2, '0') || '--' || "
             "lpad(CAST((range + 1) % 24 AS VARCHAR), 2, '0') END AS TIME_RANGE, range - 5 AS ord FROM range(5, 24)")


# The oracle's own statement of numbers, blanks and printable characters, apart from the patterns in the code.
SQL_DECIMAL = "^[ \\t\\n\\r]*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?[ \\t\\n\\r]*$"
SQL_BLANKS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
              "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
              "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")
SQL_UNPRINTABLE = "[^ -~\\x{09}-\\x{0D}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def sql_to_double(s: str) -> str:
    word = f"lower(ltrim(ltrim({s}, '+'), '-'))"
    return (f"CASE WHEN regexp_matches({s}, '{SQL_DECIMAL}') THEN "
            f"CASE WHEN isinf(TRY_CAST(trim({s}) AS DOUBLE)) THEN 0.0 ELSE COALESCE(TRY_CAST(trim({s}) AS DOUBLE), 0.0) END "
            f"WHEN {word} IN ('inf', 'infinity') THEN CASE WHEN {s}[1] = '-' THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END "
            f"ELSE 0.0 END")


def sql_clean_string(s: str, default: str = "Non défini") -> str:
    t = f"trim(regexp_replace(CAST({s} AS VARCHAR), '{SQL_UNPRINTABLE}', ' ', 'g'), {SQL_BLANKS})"
    return f"CASE WHEN {t} IS NULL OR {t} IN ('', 'nan') THEN '{default}' ELSE {t} END"


def sql_short_label(s: str, n: int = 70) -> str:
    return f"CASE WHEN length({s}) > {n} THEN substr({s}, 1, {n}) || '...' ELSE {s} END"


def sql_kde(source: str) -> str:
    """Density oracle over a one-column relation ``source(v)``."""
    return f"""
WITH v AS (SELECT v FROM ({source}) s WHERE v IS NOT NULL AND NOT isnan(v)),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
w AS (SELECT v, count(*) AS w FROM v GROUP BY v),
g AS (SELECT range AS i FROM range(0, {density.DEFAULT_GRID}))
SELECT CAST(g.i AS INTEGER) AS i, round(st.lo + g.i * (st.hi - st.lo) / {float(density.DEFAULT_GRID)}, {ROUND}) AS x,
       round(sum(w.w * exp(-0.5 * ((st.lo + g.i * (st.hi - st.lo) / {float(density.DEFAULT_GRID)} - w.v) / st.h)
                 * ((st.lo + g.i * (st.hi - st.lo) / {float(density.DEFAULT_GRID)} - w.v) / st.h))
                 / (st.n * st.h * sqrt(2 * pi()))), {ROUND_DENSITY}) AS density
FROM g, w, st WHERE st.hi > st.lo
GROUP BY g.i, st.lo, st.hi ORDER BY 1"""


def sql_kde_by_convolution(source: str) -> str:
    """The curve from values laid on a fine grid by linear binning, stated anew."""
    grid = float(density.DEFAULT_GRID)
    return f"""
WITH v AS (SELECT v FROM ({source}) s WHERE v IS NOT NULL AND NOT isnan(v)),
r AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
st AS (SELECT *, greatest(16.0, ceil(16.0 * ((hi - lo) / {grid}) / h)) AS cells FROM r WHERE hi > lo),
p AS (SELECT (v.v - st.lo) / ((st.hi - st.lo) / {grid} / st.cells) AS pos, st.cells * {grid} AS most FROM v, st),
c AS (SELECT least(floor(pos), most - 1) AS cell, pos FROM p),
n AS (SELECT cell, 1 - (pos - cell) AS w FROM c UNION ALL SELECT cell + 1, pos - cell FROM c),
w AS (SELECT st.lo + cell * ((st.hi - st.lo) / {grid} / st.cells) AS v, sum(w) AS w FROM n, st GROUP BY 1),
g AS (SELECT range AS i FROM range(0, {density.DEFAULT_GRID}))
SELECT CAST(g.i AS INTEGER) AS i, round(st.lo + g.i * (st.hi - st.lo) / {grid}, {ROUND}) AS x,
       round(sum(w.w * exp(-0.5 * pow((st.lo + g.i * (st.hi - st.lo) / {grid} - w.v) / st.h, 2))
                 / (st.n * st.h * sqrt(2 * pi()))), {ROUND_DENSITY}) AS density
FROM g, w, st GROUP BY g.i, st.lo, st.hi"""


# A numeric export column with junk in it: the JSON value of ``props``, except on
# error events, where the whole raw JSON text stands in for a garbled cell.
SQL_RAW_K = "CASE WHEN event_type = 'error' THEN props ELSE json_extract_string(props, '$.k') END"


def raw_k() -> Column:
    return F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.get_json_object("props", "$.k"))


def rounded_kde(df: DataFrame, column: str, curve=density.kde) -> DataFrame:
    k = curve(df, column)
    return k.select(F.col("i").cast("int").alias("i"), F.round("x", ROUND).alias("x"),
                    F.round("density", ROUND_DENSITY).alias("density"))


# === memory section ================================================================

M_METRICS = [("sum_extendedprice", "sum", "l_extendedprice"), ("sum_quantity", "sum", "l_quantity"),
             ("sum_tax", "sum", "l_tax")]


@register("M1_sum_by_account_top10", f"""
SELECT l_suppkey, {xsum('l_extendedprice')} AS sum_extendedprice, {xsum('l_quantity')} AS sum_quantity,
       {xsum('l_tax')} AS sum_tax
FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey
ORDER BY sum_extendedprice DESC, l_suppkey ASC LIMIT 10""")
def m1(spark, d):
    li = table(spark, d, "lineitem")
    top = agg.grouped_top_k(li, "l_suppkey", M_METRICS, "sum_extendedprice", 10, DEC)
    return agg.keep_if_positive_total(top, "sum_extendedprice")


@register("M2_avg_of_top6_frequent_accounts", f"""
WITH k AS (SELECT CAST(user_id AS VARCHAR) AS account, value FROM events),
g AS (SELECT account, COUNT(*) AS n_rows, {xavg('value')} AS avg_value FROM k
      WHERE account IS NOT NULL AND account <> 'Compte Inconnu' GROUP BY account),
t AS (SELECT * FROM g ORDER BY n_rows DESC, account ASC LIMIT 6)
SELECT account, avg_value FROM t ORDER BY avg_value DESC, account ASC""")
def m2(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").cast("string").alias("account"), "value")
    ev = filters.exclude_value(ev, "account", "Compte Inconnu")
    # One aggregate pass gives both the frequency and the mean per account;
    # the top-6 by frequency is then a k-row TakeOrderedAndProject.
    g = agg.group_metrics(ev, "account", [("n_rows", "count", "*"), ("avg_value", "avg", "value")], DEC)
    top = agg.top_k(g, "n_rows", "account", 6)
    return agg.sort_by(top.select("account", "avg_value"), "avg_value", "account")


@register("M3_density_of_value", sql_kde("SELECT value AS v FROM events"))
def m3(spark, d):
    return rounded_kde(table(spark, d, "events"), "value")


@register("M3_density_by_convolution", sql_kde_by_convolution("SELECT value AS v FROM events"))
def m3_convolution(spark, d):
    return rounded_kde(table(spark, d, "events"), "value", density.kde_by_convolution)


@register("M4_hourly_mean", f"""
SELECT date_trunc('hour', ts) AS hour, {xavg('value')} AS avg_value
FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 1""")
def m4(spark, d):
    return timeseries.hourly_mean(table(spark, d, "events"), "ts", "value", DEC, alias="avg_value")


@register("M5_memory_metrics_long_top10", f"""
WITH t AS (SELECT l_suppkey, {xsum('l_extendedprice')} AS sum_extendedprice, {xsum('l_quantity')} AS sum_quantity,
                  {xsum('l_tax')} AS sum_tax
           FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey
           ORDER BY sum_extendedprice DESC, l_suppkey ASC LIMIT 10)
SELECT l_suppkey, 'sum_extendedprice' AS variable, sum_extendedprice AS value FROM t
UNION ALL SELECT l_suppkey, 'sum_quantity', sum_quantity FROM t
UNION ALL SELECT l_suppkey, 'sum_tax', sum_tax FROM t""")
def m5(spark, d):
    top = agg.grouped_top_k(table(spark, d, "lineitem"), "l_suppkey", M_METRICS, "sum_extendedprice", 10, DEC)
    return agg.to_long(top, "l_suppkey", [m[0] for m in M_METRICS])


# === transactions section ===========================================================

@register("U1_avg_cpu_by_account_top10_seconds", f"""
SELECT user_id, {xavg('value')} AS avg_value, ({xavg('value')}) / 1000.0 AS avg_value_seconds
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
ORDER BY avg_value DESC, user_id ASC LIMIT 10""")
def u1(spark, d):
    top = agg.grouped_top_k(table(spark, d, "events"), "user_id", [("avg_value", "avg", "value")], "avg_value", 10, DEC)
    return top.withColumn("avg_value_seconds", F.col("avg_value") / 1000.0)


@register("U2_avg_resp_by_report_top10_share", f"""
WITH t AS (SELECT p_type, {xavg('p_retailprice')} AS avg_retailprice FROM part WHERE p_type IS NOT NULL
           GROUP BY p_type ORDER BY avg_retailprice DESC, p_type ASC LIMIT 10)
SELECT p_type, avg_retailprice, round(avg_retailprice / SUM(avg_retailprice) OVER (), {ROUND}) AS share FROM t""")
def u2(spark, d):
    top = agg.grouped_top_k(table(spark, d, "part"), "p_type", [("avg_retailprice", "avg", "p_retailprice")],
                            "avg_retailprice", 10, DEC)
    return agg.share_of_small(top, "avg_retailprice").withColumn("share", F.round("share", ROUND))


@register("U3_count_by_account_top10", """
SELECT o_custkey, COUNT(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey
ORDER BY n_rows DESC, o_custkey ASC LIMIT 10""")
def u3(spark, d):
    return agg.top_k(agg.count_by(table(spark, d, "orders"), "o_custkey", "n_rows"), "n_rows", "o_custkey", 10)


@register("U4_hour_bucket_mean_on_spine", f"""
WITH a AS (SELECT {sql_bucket('ts')} AS TIME_RANGE, {xavg('value')} AS avg_value FROM events
           WHERE ts IS NOT NULL GROUP BY 1),
s AS ({SQL_SPINE})
SELECT s.TIME_RANGE, COALESCE(a.avg_value, 0) AS avg_value, COALESCE(a.avg_value, 0) / 1000.0 AS avg_value_SECONDS
FROM s LEFT JOIN a ON s.TIME_RANGE = a.TIME_RANGE ORDER BY s.ord""")
def u4(spark, d):
    ev = timeseries.with_hour_bucket(table(spark, d, "events"), "ts")
    return timeseries.bucket_metrics_on_spine(ev, "TIME_RANGE", [("avg_value", "avg", "value")], DEC,
                                              seconds=["avg_value"])


@register("U5_cpu_resp_positive_pairs", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity > 0 AND l_extendedprice > 0""")
def u5(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0)).select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _long_top_sql(key: str, tbl: str, metrics: list[tuple[str, str]], order: str, k: int) -> str:
    sums = ", ".join(f"{xsum(c)} AS {a}" for a, c in metrics)
    unions = "\nUNION ALL ".join(f"SELECT {key}, '{a}' AS variable, {a} AS value FROM t" for a, _ in metrics)
    return (f"WITH t AS (SELECT {key}, {sums} FROM {tbl} WHERE {key} IS NOT NULL GROUP BY {key} "
            f"ORDER BY {order} DESC, {key} ASC LIMIT {k})\n{unions}")


U6 = [("sum_quantity", "l_quantity"), ("sum_extendedprice", "l_extendedprice"), ("sum_discount", "l_discount"),
      ("sum_tax", "l_tax")]
U7 = U6 + [("sum_linenumber", "l_linenumber"), ("sum_partkey", "l_partkey")]
U8 = [("sum_discount", "l_discount"), ("sum_tax", "l_tax")]


def _long_top(spark, d, metrics, order, k):
    specs = [(a, "sum", c) for a, c in metrics]
    top = agg.grouped_top_k(table(spark, d, "lineitem"), "l_suppkey", specs, order, k, DEC)
    return agg.to_long(top, "l_suppkey", [a for a, _ in metrics])


@register("U6_io_counters_long_top10", _long_top_sql("l_suppkey", "lineitem", U6, "sum_quantity", 10))
def u6(spark, d):
    return _long_top(spark, d, U6, "sum_quantity", 10)


@register("U7_buffer_counters_long_top10", _long_top_sql("l_suppkey", "lineitem", U7, "sum_discount", 10))
def u7(spark, d):
    return _long_top(spark, d, U7, "sum_discount", 10)


@register("U8_sql_counters_long_top4", _long_top_sql("l_suppkey", "lineitem", U8, "sum_discount", 4))
def u8(spark, d):
    return _long_top(spark, d, U8, "sum_discount", 4)


# === hourly section ==================================================================

@register("H1_bucket_sum_on_spine", f"""
WITH a AS (SELECT {sql_bucket('ts')} AS TIME_RANGE, {xsum('value')} AS sum_value FROM events
           WHERE ts IS NOT NULL GROUP BY 1),
s AS ({SQL_SPINE})
SELECT s.TIME_RANGE, COALESCE(a.sum_value, 0) AS sum_value FROM s LEFT JOIN a ON s.TIME_RANGE = a.TIME_RANGE
ORDER BY s.ord""")
def h1(spark, d):
    ev = timeseries.with_hour_bucket(table(spark, d, "events"), "ts")
    return timeseries.bucket_metrics_on_spine(ev, "TIME_RANGE", [("sum_value", "sum", "value")], DEC)


@register("H2_bucket_total_io_top5", f"""
WITH e AS (SELECT {sql_bucket('ts')} AS TIME_RANGE,
                  value + {sql_to_double(SQL_RAW_K)} + CAST(user_id AS DOUBLE) AS TOTAL_IO
           FROM events WHERE ts IS NOT NULL)
SELECT TIME_RANGE, {xsum('TOTAL_IO')} AS sum_total_io FROM e WHERE TIME_RANGE IS NOT NULL GROUP BY TIME_RANGE
ORDER BY sum_total_io DESC, TIME_RANGE ASC LIMIT 5""")
def h2(spark, d):
    ev = timeseries.with_hour_bucket(table(spark, d, "events"), "ts")
    k = to_double(raw_k())
    ev = ev.withColumn("TOTAL_IO", F.col("value") + k + F.col("user_id").cast("double"))
    return agg.grouped_top_k(ev, "TIME_RANGE", [("sum_total_io", "sum", "TOTAL_IO")], "sum_total_io", 5, DEC)


H3 = [("avg_value", "value"), ("avg_user_id", "user_id"), ("avg_event_id", "event_id")]


@register("H3_bucket_means_seconds_ordered_long", f"""
WITH a AS (SELECT {sql_bucket('ts')} AS TIME_RANGE,
                  {', '.join(f'({xavg(c)}) / 1000.0 AS {n}' for n, c in H3)}
           FROM events WHERE ts IS NOT NULL GROUP BY 1)
{' UNION ALL '.join(f"SELECT TIME_RANGE, '{n}' AS variable, {n} AS value FROM a" for n, _ in H3)}""")
def h3(spark, d):
    ev = timeseries.with_hour_bucket(table(spark, d, "events"), "ts")
    wide = timeseries.bucket_metrics_ordered(ev, "TIME_RANGE", [(n, "avg", c) for n, c in H3], DEC, to_seconds=True)
    return agg.to_long(wide, "TIME_RANGE", [n for n, _ in H3])


# === task section ===================================================================

T1 = [("avg_extendedprice", "l_extendedprice"), ("avg_quantity", "l_quantity"), ("avg_discount", "l_discount"),
      ("avg_tax", "l_tax")]


@register("T1_task_time_means_long_top10", f"""
WITH t AS (SELECT l_partkey, {', '.join(f'{xavg(c)} AS {n}' for n, c in T1)} FROM lineitem
           WHERE l_partkey IS NOT NULL GROUP BY l_partkey ORDER BY avg_extendedprice DESC, l_partkey ASC LIMIT 10)
{' UNION ALL '.join(f"SELECT l_partkey, '{n}' AS variable, {n} AS value FROM t" for n, _ in T1)}""")
def t1(spark, d):
    top = agg.grouped_top_k(table(spark, d, "lineitem"), "l_partkey", [(n, "avg", c) for n, c in T1],
                            "avg_extendedprice", 10, DEC)
    return agg.to_long(top, "l_partkey", [n for n, _ in T1])


@register("T2_sum_by_entry_top10", f"""
SELECT l_partkey, {xsum('l_quantity')} AS sum_quantity FROM lineitem WHERE l_partkey IS NOT NULL
GROUP BY l_partkey ORDER BY sum_quantity DESC, l_partkey ASC LIMIT 10""")
def t2(spark, d):
    return agg.grouped_top_k(table(spark, d, "lineitem"), "l_partkey", [("sum_quantity", "sum", "l_quantity")],
                             "sum_quantity", 10, DEC)


# === hit list section ===============================================================

@register("D1_resp_cpu_by_report_long_top10", f"""
WITH t AS (SELECT p_type, {xavg('p_retailprice')} AS avg_retailprice, {xavg('p_size')} AS avg_size FROM part
           WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY avg_retailprice DESC, p_type ASC LIMIT 10)
SELECT p_type, 'avg_retailprice' AS variable, avg_retailprice AS value FROM t
UNION ALL SELECT p_type, 'avg_size', avg_size FROM t""")
def d1(spark, d):
    top = agg.grouped_top_k(table(spark, d, "part"), "p_type",
                            [("avg_retailprice", "avg", "p_retailprice"), ("avg_size", "avg", "p_size")],
                            "avg_retailprice", 10, DEC)
    return agg.to_long(top, "p_type", ["avg_retailprice", "avg_size"])


@register("D2_dbcalls_by_report_top10", f"""
SELECT o_orderpriority, {xsum('o_totalprice')} AS sum_totalprice FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority ORDER BY sum_totalprice DESC, o_orderpriority ASC LIMIT 10""")
def d2(spark, d):
    return agg.grouped_top_k(table(spark, d, "orders"), "o_orderpriority",
                             [("sum_totalprice", "sum", "o_totalprice")], "sum_totalprice", 10, DEC)


@register("D3_rollouts_by_account_top10", f"""
SELECT o_custkey, {xsum('o_totalprice')} AS sum_totalprice FROM orders WHERE o_custkey IS NOT NULL
GROUP BY o_custkey ORDER BY sum_totalprice DESC, o_custkey ASC LIMIT 10""")
def d3(spark, d):
    return agg.grouped_top_k(table(spark, d, "orders"), "o_custkey", [("sum_totalprice", "sum", "o_totalprice")],
                             "sum_totalprice", 10, DEC)


# === work process section =============================================================

SQL_MMSS_OF_TS = ("CAST(TRY_CAST(split_part(strftime(ts, '%M:%S'), ':', 1) AS DOUBLE) * 60 + "
                  "TRY_CAST(split_part(strftime(ts, '%M:%S'), ':', 2) AS DOUBLE) AS BIGINT)")


@register("W1_density_of_cpu_seconds", sql_kde(f"SELECT CAST({SQL_MMSS_OF_TS} AS DOUBLE) AS v FROM events"))
def w1(spark, d):
    ev = table(spark, d, "events").select(mm_ss_seconds(F.date_format("ts", "mm:ss")).alias("cpu_seconds"))
    return rounded_kde(ev, "cpu_seconds")


@register("W1_density_by_convolution", sql_kde_by_convolution(f"SELECT CAST({SQL_MMSS_OF_TS} AS DOUBLE) AS v FROM events"))
def w1_convolution(spark, d):
    ev = table(spark, d, "events").select(mm_ss_seconds(F.date_format("ts", "mm:ss")).alias("cpu_seconds"))
    return rounded_kde(ev, "cpu_seconds", density.kde_by_convolution)


@register("W2_count_by_type", """
SELECT event_type, COUNT(*) AS n_rows FROM events WHERE event_type IS NOT NULL GROUP BY event_type
ORDER BY n_rows DESC, event_type ASC""")
def w2(spark, d):
    return agg.sort_by(agg.count_by(table(spark, d, "events"), "event_type", "n_rows"), "n_rows", "event_type")


@register("W3_avg_cpu_by_type", f"""
SELECT event_type, {xavg('value')} AS avg_value FROM events WHERE event_type IS NOT NULL GROUP BY event_type
ORDER BY avg_value DESC, event_type ASC""")
def w3(spark, d):
    g = agg.group_metrics(table(spark, d, "events"), "event_type", [("avg_value", "avg", "value")], DEC)
    return agg.sort_by(g, "avg_value", "event_type")


# === SQL trace section ==================================================================

def _statement_top(spark, d, fn, col, alias):
    docs = table(spark, d, "documents").select(F.col("text").alias("statement"), col)
    top = agg.grouped_top_k(docs, "statement", [(alias, fn, col)], alias, 10, DEC)
    return top.select(short_label("statement").alias("statement_label"), alias)


def _statement_sql(fn_sql: str, alias: str) -> str:
    return (f"WITH t AS (SELECT text AS statement, {fn_sql} AS {alias} FROM documents WHERE text IS NOT NULL "
            f"GROUP BY text ORDER BY {alias} DESC, statement ASC LIMIT 10)\n"
            f"SELECT {sql_short_label('statement')} AS statement_label, {alias} FROM t")


@register("Q1_exectime_by_statement_top10", _statement_sql(xsum("n_chars"), "sum_n_chars"))
def q1(spark, d):
    return _statement_top(spark, d, "sum", "n_chars", "sum_n_chars")


@register("Q2_density_for_matching_server", sql_kde(
    "SELECT value AS v FROM events WHERE contains(lower(event_type), lower('CLICK'))"))
def q2(spark, d):
    ev = filters.contains_ci(table(spark, d, "events"), "event_type", "CLICK")
    return rounded_kde(ev, "value")


@register("Q2_density_by_convolution", sql_kde_by_convolution(
    "SELECT value AS v FROM events WHERE contains(lower(event_type), lower('CLICK'))"))
def q2_convolution(spark, d):
    ev = filters.contains_ci(table(spark, d, "events"), "event_type", "CLICK")
    return rounded_kde(ev, "value", density.kde_by_convolution)


@register("Q3_time_per_exec_by_statement_top10", _statement_sql(xavg("n_chars"), "avg_n_chars"))
def q3(spark, d):
    return _statement_top(spark, d, "avg", "n_chars", "avg_n_chars")


@register("Q4_records_by_statement_top10", _statement_sql(xsum("doc_id"), "sum_doc_id"))
def q4(spark, d):
    return _statement_top(spark, d, "sum", "doc_id", "sum_doc_id")


# === users section =======================================================================

@register("N1_count_by_user_type_share", """
SELECT c_mktsegment, COUNT(*) AS n_users, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def n1(spark, d):
    return agg.share_of_total(agg.count_by(table(spark, d, "customer"), "c_mktsegment", "n_users"), "n_users")


@register("N2_count_by_date", """
SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n_rows FROM orders WHERE o_orderdate IS NOT NULL
GROUP BY 1 ORDER BY 1""")
def n2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return agg.count_by(o, "day", "n_rows").orderBy("day")


def _users_with_validity(spark, d) -> DataFrame:
    """orders as a user master: the validity date text is the ``00000000`` sentinel for pending orders."""
    o = table(spark, d, "orders")
    gl = F.when(F.col("o_orderstatus") == "P", F.lit("00000000")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select(F.col("o_custkey").alias("BNAME"), F.col("o_orderkey"), F.col("o_orderpriority").alias("USTYP"),
                    compact_date(gl).alias("GLTGB_DATE"))


_SQL_USERS = """
WITH u AS (SELECT o_custkey AS BNAME, o_orderkey, o_orderpriority AS USTYP,
                  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS GLTGB_DATE
           FROM orders)"""


@register("N3_users_without_date", _SQL_USERS + """
SELECT BNAME, o_orderkey, USTYP FROM u WHERE GLTGB_DATE IS NULL ORDER BY BNAME, o_orderkey""")
def n3(spark, d):
    u = _users_with_validity(spark, d)
    return filters.null_rows(u, "GLTGB_DATE").select("BNAME", "o_orderkey", "USTYP").orderBy("BNAME", "o_orderkey")


@register("N3_count_users_without_date", _SQL_USERS + """
SELECT COUNT(*) AS n_without_date FROM u WHERE GLTGB_DATE IS NULL""")
def n3c(spark, d):
    return filters.null_rows(_users_with_validity(spark, d), "GLTGB_DATE").agg(F.count(F.lit(1)).alias("n_without_date"))


# === anomalies ===========================================================================

def _thr_sql(m: float) -> str:
    return (f"(SELECT CASE WHEN SUM(value) > 0 THEN AVG(value) + {m} * STDDEV_SAMP(value) END "
            f"FROM events WHERE ts IS NOT NULL)")


@register("X1_threshold_and_count_m3", f"""
SELECT round({_thr_sql(3.0)}, {ROUND}) AS threshold,
       COUNT(*) FILTER (WHERE value > {_thr_sql(3.0)}) AS n_anomalies FROM events WHERE ts IS NOT NULL""")
def x1(spark, d):
    r = anomaly.anomaly_count(table(spark, d, "events"), "value", 3.0, ts="ts")
    return r.select(F.round("threshold", ROUND).alias("threshold"), "n_anomalies")


def _x2_sql(m: float) -> str:
    return f"""
SELECT ts, value, user_id, event_type FROM events WHERE ts IS NOT NULL AND value > {_thr_sql(m)}
ORDER BY value DESC, ts ASC, user_id ASC, event_type ASC"""


@register("X2_anomalies_m3", _x2_sql(3.0))
def x2(spark, d):
    return anomaly.anomalies(table(spark, d, "events"), "value", 3.0, ["ts", "value", "user_id", "event_type"], "ts")


@register("X2_anomalies_m2", _x2_sql(2.0))
def x2b(spark, d):
    return anomaly.anomalies(table(spark, d, "events"), "value", 2.0, ["ts", "value", "user_id", "event_type"], "ts")


@register("X3_overlay_m3", f"""
SELECT event_id, ts, value, round({_thr_sql(3.0)}, {ROUND}) AS threshold,
       COALESCE(value > {_thr_sql(3.0)}, false) AS is_anomaly
FROM events WHERE ts IS NOT NULL AND (SELECT SUM(value) > 0 FROM events)""")
def x3(spark, d):
    o = anomaly.anomaly_overlay(table(spark, d, "events"), "value", 3.0, "ts", ["event_id", "ts", "value"])
    return o.withColumn("threshold", F.round("threshold", ROUND))


# === KPIs ================================================================================

@register("K1_K5_kpis", f"""
SELECT round(AVG(e.value) / 1000, {ROUND}) AS avg_resp_s,
       round((SELECT AVG(l_extendedprice) FROM lineitem) / 1048576, {ROUND}) AS avg_mem_mib,
       round(SUM(e.value), 2) AS total_db_calls,
       round((SELECT SUM(o_totalprice) FROM orders), 2) AS total_sql_execs,
       round(AVG(e.user_id) / 1000, {ROUND}) AS avg_cpu_s
FROM events e""")
def k15(spark, d):
    ev = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("double"))
    k = kpis.kpis(spark, hitlist=ev, memory=table(spark, d, "lineitem"), sql_trace=table(spark, d, "orders"),
                  resp="value", cpu="user_id", dbcalls="value", used="l_extendedprice", totalexec="o_totalprice")
    return k.select(F.round("avg_resp_s", ROUND).alias("avg_resp_s"), F.round("avg_mem_mib", ROUND).alias("avg_mem_mib"),
                    F.round("total_db_calls", 2).alias("total_db_calls"),
                    F.round("total_sql_execs", 2).alias("total_sql_execs"), F.round("avg_cpu_s", ROUND).alias("avg_cpu_s"))


@register("C16_thousands_label_of_total", f"""
SELECT replace(format('{{:,}}', CAST(trunc({xsum('value')}) AS BIGINT)), ',', ' ') AS total_label FROM events""")
def c16(spark, d):
    t = agg.group_metrics(table(spark, d, "events").withColumn("__all", F.lit(1)), "__all",
                          [("total", "sum", "value")], DEC)
    return t.select(thousands_label("total").alias("total_label"))


# === filters ============================================================================

@register("F1_account_options", """
SELECT DISTINCT value FROM (SELECT CAST(c_nationkey AS VARCHAR) AS value FROM customer
                            UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier) u
WHERE value IS NOT NULL ORDER BY value""")
def f1(spark, d):
    return filters.value_options([(table(spark, d, "customer"), "c_nationkey"), (table(spark, d, "supplier"), "s_nationkey")])


CHOSEN_REGION = "EUROPE"
SQL_CHOSEN_NATIONS = ("SELECT n_nationkey FROM nation WHERE n_regionkey IN "
                      f"(SELECT r_regionkey FROM region WHERE r_name = '{CHOSEN_REGION}')")


def chosen_nations(spark, d) -> DataFrame:
    """The accounts a user picks: the nations of one region (a 25-row dimension, so a bounded list)."""
    region = table(spark, d, "region").filter(F.col("r_name") == CHOSEN_REGION)
    nation = table(spark, d, "nation")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left_semi").select("n_nationkey")


@register("F2_account_list_filter", f"""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
WHERE c_nationkey IN ({SQL_CHOSEN_NATIONS})""")
def f2(spark, d):
    c = filters.in_frame(table(spark, d, "customer"), "c_nationkey", chosen_nations(spark, d), "n_nationkey",
                         bounded=True)
    return c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register("F3_report_options_after_filter", f"""
SELECT DISTINCT c_mktsegment AS value FROM customer
WHERE c_nationkey IN ({SQL_CHOSEN_NATIONS}) AND c_mktsegment IS NOT NULL ORDER BY value""")
def f3(spark, d):
    c = filters.in_frame(table(spark, d, "customer"), "c_nationkey", chosen_nations(spark, d), "n_nationkey",
                         bounded=True)
    return filters.value_options([(c, "c_mktsegment")])


@register("F4_type_list_filter", """
SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('PROMO', 'SMALL')""")
def f4(spark, d):
    return filters.in_values(table(spark, d, "part"), "p_type", ["PROMO", "SMALL"]).select("p_partkey", "p_type", "p_size")


@register("F10_rows_of_top5_frequent_accounts", """
WITH k AS (SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY COUNT(*) DESC, user_id ASC LIMIT 5)
SELECT event_type, COUNT(*) AS n_rows FROM events WHERE user_id IN (SELECT user_id FROM k)
GROUP BY event_type ORDER BY event_type""")
def f10(spark, d):
    ev = filters.restrict_to_top_frequent(table(spark, d, "events"), "user_id", 5)
    return agg.count_by(ev, "event_type", "n_rows").orderBy("event_type")


def _trailing_sql(interval: str) -> str:
    return f"""
SELECT COUNT(*) AS n_rows, {xsum('value')} AS sum_value FROM events
WHERE ts >= (SELECT MAX(ts) FROM events) - {interval}"""


def _trailing(spark, d, period):
    r = filters.trailing_range(table(spark, d, "events"), "ts", period)
    return r.agg(F.count(F.lit(1)).alias("n_rows"),
                 agg.exact_sum("value", DEC).alias("sum_value"))


@register("F11_trailing_6h_rows", """
SELECT event_id, ts, value FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 6 HOUR""")
def f11a(spark, d):
    return filters.trailing_range(table(spark, d, "events"), "ts", "6h").select("event_id", "ts", "value")


@register("F11_trailing_1d", _trailing_sql("INTERVAL 1 DAY"))
def f11b(spark, d):
    return _trailing(spark, d, "1d")


@register("F11_trailing_1m", _trailing_sql("INTERVAL 1 MONTH"))
def f11c(spark, d):
    return _trailing(spark, d, "1m")


@register("F11_trailing_1h", _trailing_sql("INTERVAL 1 HOUR"))
def f11e(spark, d):
    return _trailing(spark, d, "1h")


@register("F11_trailing_6m", _trailing_sql("INTERVAL 6 MONTH"))
def f11f(spark, d):
    return _trailing(spark, d, "6m")


@register("F11_trailing_1y_of_orders", """
SELECT COUNT(*) AS n_rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_value FROM orders
WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 1 YEAR""")
def f11g(spark, d):
    r = filters.trailing_range(table(spark, d, "orders"), "o_orderdate", "1y")
    return r.agg(F.count(F.lit(1)).alias("n_rows"), agg.exact_sum("o_totalprice", DEC).alias("sum_value"))


@register("F11_all_rows", f"SELECT COUNT(*) AS n_rows, {xsum('value')} AS sum_value FROM events")
def f11h(spark, d):
    return _trailing(spark, d, "all")


@register("F11_year_to_date", """
SELECT COUNT(*) AS n_rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_value FROM orders
WHERE o_orderdate >= date_trunc('year', (SELECT MAX(o_orderdate) FROM orders))""")
def f11d(spark, d):
    r = filters.trailing_range(table(spark, d, "orders"), "o_orderdate", "ytd")
    return r.agg(F.count(F.lit(1)).alias("n_rows"),
                 agg.exact_sum("o_totalprice", DEC).alias("sum_value"))


# === cleaning functions on real columns =====================================================

@register("C2_clean_document_text", f"""
SELECT doc_id, {sql_clean_string('text')} AS text_clean FROM documents""")
def c2(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_string("text").alias("text_clean"))


@register("C2_clean_page_url", f"""
SELECT page_id, {sql_clean_string('url', 'Compte Inconnu')} AS url_clean FROM pages""")
def c2b(spark, d):
    return table(spark, d, "pages").select("page_id", clean_string("url", "Compte Inconnu").alias("url_clean"))


@register("C3_numeric_coercion", f"""
SELECT event_id, raw, {sql_to_double('raw')} AS parsed FROM (SELECT event_id, {SQL_RAW_K} AS raw FROM events) e""")
def c3(spark, d):
    ev = table(spark, d, "events").select("event_id", raw_k().alias("raw"))
    return ev.select("event_id", "raw", to_double("raw").alias("parsed"))


@register("C4_european_number_text", f"""
SELECT event_id, {sql_to_double("replace(replace(replace(eu, ' ', ''), '.', ''), ',', '.')")} AS parsed
FROM (SELECT event_id, replace(CAST(value AS VARCHAR), '.', ',') AS eu FROM events) e""")
def c4(spark, d):
    # the value written the European way (decimal comma), then parsed back
    ev = table(spark, d, "events").select("event_id", F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("eu"))
    return ev.select("event_id", eu_number("eu").alias("parsed"))


@register("C5_mm_ss_to_seconds", f"""
SELECT event_id, CAST(COALESCE({SQL_MMSS_OF_TS}, 0) AS DOUBLE) AS seconds FROM events""")
def c5(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", mm_ss_seconds(F.date_format("ts", "mm:ss")).alias("seconds"))


@register("C6_compact_date_time", """
SELECT event_id, strptime(strftime(ts, '%Y%m%d') ||
         lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS VARCHAR), 6, '0'), '%Y%m%d%H%M%S') AS full_datetime
FROM events""")
def c6(spark, d):
    ev = table(spark, d, "events")
    date_txt = F.date_format("ts", "yyyyMMdd")
    time_int = F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")   # unpadded, like the exports
    return ev.select("event_id", compact_datetime(date_txt, time_int).alias("full_datetime"))


# === the same functions on dirty cells built from the tables ==================================

@register("C4_european_number_with_thousands", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value * 1000, 2) END AS parsed FROM events""")
def c4b(spark, d):
    ev = table(spark, d, "events")
    eu = F.translate(F.format_number(F.round(F.col("value") * 1000, 2).cast("decimal(20,2)"), 2), ",.", ".,")
    cell = F.when(F.col("event_type") == "error", F.concat(eu, F.lit(" EUR"))).otherwise(eu)
    return ev.select("event_id", cell.alias("eu")).select("event_id", eu_number("eu").alias("parsed"))


@register("C5_dirty_mm_ss", """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 = 1 THEN event_id % 90
       ELSE (user_id % 70) * 60 + event_id % 90 END AS DOUBLE) AS seconds FROM events""")
def c5b(spark, d):
    m, s = (F.col("user_id") % 70).cast("string"), (F.col("event_id") % 90).cast("string")
    cell = F.when(F.col("event_type") == "error", F.concat(m, F.lit(":x"))) \
        .when(F.col("user_id") % 5 == 0, F.concat(m, F.lit(":"), s, F.lit(":00"))) \
        .when(F.col("user_id") % 5 == 1, F.concat(F.lit(" "), s)).otherwise(F.concat(m, F.lit(":"), s))
    return table(spark, d, "events").select("event_id", cell.alias("t")).select("event_id", mm_ss_seconds("t").alias("seconds"))


@register("C6_dirty_compact_date_time", """
SELECT event_id, CASE WHEN event_type <> 'error' AND user_id % 4 < 2 THEN date_trunc('day', ts) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE
       END AS full_datetime FROM events""")
def c6b(spark, d):
    ev = table(spark, d, "events")
    date = F.when(F.col("event_type") == "error", F.lit("20241340")).otherwise(F.date_format("ts", "yyyyMMdd"))
    time = F.when(F.col("user_id") % 4 == 0, F.lit("90500")).when(F.col("user_id") % 4 == 1, F.lit("090500")) \
        .when(F.col("user_id") % 4 == 2, F.lit("250000"))
    return ev.select("event_id", compact_datetime(date, time).alias("full_datetime"))


@register("C7_date_time_text", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS parsed FROM events""")
def c7(spark, d):
    text = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", text.alias("t")).select("event_id", parse_datetime_text("t").alias("parsed"))


# Columns written in one form, with junk on error events and every 50th cell in another form: the vote finds the form,
# all other cells are null. The SQL states which cells those are.
_FORMS = {"day_first": ("dd/MM/yyyy HH:mm:ss", "second"), "dotted": ("d.M.yyyy H:mm", "minute"),
          "month_name": ("d MMM yyyy HH:mm:ss", "second"), "two_digit_year": ("dd/MM/yy HH:mm", "minute"),
          "year_first": ("yyyy/MM/dd HH:mm:ss", "second"), "twelve_hours": ("MM/dd/yyyy hh:mm:ss a", "second")}


def _inferred(spark, d):
    ev = table(spark, d, "events")
    out = []
    for name, (form, _) in _FORMS.items():
        text = F.when(F.col("event_type") == "error", F.lit("not a date")) \
            .when(F.col("event_id") % 50 == 7, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format("ts", form))
        column = ev.select("event_id", text.alias("t"))
        out.append(column.select(F.lit(name).alias("column"), "event_id", parse_datetime_column(column, "t").alias("parsed")))
    return reduce(DataFrame.unionByName, out)


register("C7_inferred_date_time_forms", "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"column\", event_id, CASE WHEN event_type <> 'error' AND event_id % 50 <> 7 "
    f"THEN date_trunc('{unit}', ts) END AS parsed FROM events" for name, (_, unit) in _FORMS.items()))(_inferred)


@register("C2_clean_dirty_cells", f"""
SELECT event_id, {sql_clean_string("CASE WHEN event_type = 'error' THEN 'nan' WHEN user_id % 4 = 0 THEN chr(160) || chr(9) "
                                   "WHEN user_id % 4 = 1 THEN NULL WHEN user_id % 4 = 2 THEN ' é' || chr(7) || event_type || ' ü ' "
                                   "ELSE event_type || chr(160) || 'x' || chr(10) END")} AS cell FROM events""")
def c2c(spark, d):
    cell = F.when(F.col("event_type") == "error", F.lit("nan")).when(F.col("user_id") % 4 == 0, F.lit("\u00a0\t")) \
        .when(F.col("user_id") % 4 == 1, F.lit(None)) \
        .when(F.col("user_id") % 4 == 2, F.concat(F.lit(" é\x07"), F.col("event_type"), F.lit(" ü "))) \
        .otherwise(F.concat(F.col("event_type"), F.lit("\u00a0x\n")))
    return table(spark, d, "events").select("event_id", cell.alias("raw")).select("event_id", clean_string("raw").alias("cell"))


@register("U4_hour_bucket_mean_with_missing_hours", f"""
WITH a AS (SELECT {sql_bucket('ts')} AS TIME_RANGE, {xavg('value')} AS avg_value FROM events
           WHERE ts IS NOT NULL AND hour(ts) BETWEEN 8 AND 17 GROUP BY 1),
s AS ({SQL_SPINE})
SELECT s.TIME_RANGE, COALESCE(a.avg_value, 0) AS avg_value FROM s LEFT JOIN a ON s.TIME_RANGE = a.TIME_RANGE
ORDER BY s.ord""")
def u4b(spark, d):
    ev = table(spark, d, "events").filter(F.hour("ts").between(8, 17))
    return timeseries.bucket_metrics_on_spine(timeseries.with_hour_bucket(ev, "ts"), "TIME_RANGE",
                                              [("avg_value", "avg", "value")], DEC)


@register("M2_null_and_placeholder_accounts", f"""
WITH k AS (SELECT CASE WHEN event_type = 'error' THEN 'Compte Inconnu' WHEN user_id % 3 = 0 THEN NULL
                       ELSE CAST(user_id AS VARCHAR) END AS account, value FROM events)
SELECT account, {xavg('value')} AS avg_value FROM k WHERE account IS NOT NULL AND account <> 'Compte Inconnu'
GROUP BY account ORDER BY avg_value DESC, account""")
def m2b(spark, d):
    account = F.when(F.col("event_type") == "error", F.lit("Compte Inconnu")) \
        .when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string"))
    ev = filters.exclude_value(table(spark, d, "events").select(account.alias("account"), "value"), "account", "Compte Inconnu")
    return agg.sort_by(agg.group_metrics(ev, "account", [("avg_value", "avg", "value")], DEC), "avg_value", "account")


# === profile / preview ======================================================================

@register("S6_profile_customer", """
SELECT * FROM (
  SELECT 'c_custkey' AS "column", 0 AS position, 'bigint' AS dtype, COUNT(c_custkey) AS non_null, COUNT(*) AS rows FROM customer
  UNION ALL SELECT 'c_name', 1, 'string', COUNT(c_name), COUNT(*) FROM customer
  UNION ALL SELECT 'c_nationkey', 2, 'int', COUNT(c_nationkey), COUNT(*) FROM customer
  UNION ALL SELECT 'c_acctbal', 3, 'double', COUNT(c_acctbal), COUNT(*) FROM customer
  UNION ALL SELECT 'c_mktsegment', 4, 'string', COUNT(c_mktsegment), COUNT(*) FROM customer) p
ORDER BY position""")
def s6(spark, d):
    return profile(table(spark, d, "customer"))


@register("S5_preview_customer", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5""")
def s5(spark, d):
    return preview(table(spark, d, "customer"), 5, drop=["c_acctbal"], order_by=["c_custkey"])


# === regression job ===========================================================================

from loadlens.operators import regression  # noqa: E402

P_TARGET = "l_extendedprice"
P_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_FOREST_RUNS: dict[tuple[str, str], regression.ForestRun] = {}


def forest_run(spark: SparkSession, d: str) -> regression.ForestRun:
    """Fit once per session and table folder; the forest outputs share it.

    The target depends on the features (quantity after discount and tax), so the metrics tell whether the forest learns.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOREST_RUNS:
        li = table(spark, d, "lineitem").withColumn(
            "net_quantity", F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        _FOREST_RUNS[key] = regression.fit_forest(li, "net_quantity", P_FEATURES)
    return _FOREST_RUNS[key]


def _p2_row(c: str, pos: int, dtype: str, is_time: bool) -> str:
    return (f"SELECT '{c}' AS feature, {pos} AS position, '{dtype}' AS dtype, COUNT({c}) AS non_null, "
            f"COALESCE(MIN({c}) < MAX({c}), false) AS varies, {str(is_time).lower()} AS is_time "
            f"FROM lineitem WHERE {P_TARGET} IS NOT NULL")


_P2_TYPES = ["double", "double", "double", "string", "string", "timestamp_ntz"]


@register("P2_P4_feature_profile", "WITH p AS (" + "\nUNION ALL ".join(
    _p2_row(c, i, t, t == "timestamp_ntz") for i, (c, t) in enumerate(zip(P_FEATURES, _P2_TYPES))) + """)
SELECT feature, position, dtype, non_null, varies, is_time, non_null > 0 AND varies AND NOT is_time AS kept
FROM p ORDER BY position""")
def p2(spark, d):
    li = table(spark, d, "lineitem").filter(F.col(P_TARGET).isNotNull())
    return regression.feature_profile(li, P_FEATURES)


@register("P6_numeric_feature_stats", f"""
SELECT feature, round(mean, {ROUND}) AS mean, round(std, {ROUND}) AS std FROM (
  SELECT 'l_quantity' AS feature, AVG(l_quantity) AS mean, STDDEV_POP(l_quantity) AS std FROM lineitem
  UNION ALL SELECT 'l_discount', AVG(l_discount), STDDEV_POP(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', AVG(l_tax), STDDEV_POP(l_tax) FROM lineitem) s""")
def p6(spark, d):
    s = regression.numeric_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return s.select("feature", F.round("mean", ROUND).alias("mean"), F.round("std", ROUND).alias("std"))


@register("P7_text_feature_modes", """
SELECT feature, value AS mode FROM (
  SELECT feature, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS rn FROM (
    SELECT 'l_returnflag' AS feature, l_returnflag AS value, COUNT(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, COUNT(*) FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 2) c) r
WHERE rn = 1""")
def p7(spark, d):
    return regression.text_modes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("P11_P14_metrics_of_linear_predictor", f"""
WITH m AS (SELECT regr_slope({P_TARGET}, l_quantity) AS a, regr_intercept({P_TARGET}, l_quantity) AS b FROM lineitem),
j AS (SELECT {P_TARGET} AS y, m.a * l_quantity + m.b AS p FROM lineitem, m WHERE {P_TARGET} IS NOT NULL),
t AS (SELECT AVG(y) AS my FROM j)
SELECT COUNT(*) AS n_test, round(1 - SUM((y - p) * (y - p)) / SUM((y - my) * (y - my)), {ROUND}) AS r2,
       round(AVG(abs(y - p)), {ROUND}) AS mae, round(regr_slope(p, y), {ROUND}) AS trend_slope,
       round(regr_intercept(p, y), 3) AS trend_intercept
FROM j, t""")
def p11(spark, d):
    li = table(spark, d, "lineitem").filter(F.col(P_TARGET).isNotNull())
    # predictor: the least-squares line, its two coefficients a scalar subquery (one partial aggregate per task)
    line = li.agg(F.struct(F.regr_slope(P_TARGET, "l_quantity").alias("a"),
                           F.regr_intercept(P_TARGET, "l_quantity").alias("b")).alias("m")).scalar()
    j = li.select(F.col(P_TARGET).alias("y"), "l_quantity", line.alias("m")) \
        .select("y", (F.col("m.a") * F.col("l_quantity") + F.col("m.b")).alias("p"))
    m = regression.regression_metrics(j, "y", "p")
    return m.select("n_test", *[F.round(c, ROUND).alias(c) for c in ("r2", "mae", "trend_slope")],
                    F.round("trend_intercept", 3).alias("trend_intercept"))


@register("P7_label_slots", """
WITH c AS (SELECT 'o_clerk' AS feature, o_custkey::VARCHAR AS value, COUNT(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders GROUP BY 2)
SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1 AS slot
FROM c WHERE value IS NOT NULL""")
def p7_slots(spark, d):
    """The one-hot slots of a text column with many labels and of one with few."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("o_clerk"), "o_orderpriority")
    return encoding.label_slots(orders, ["o_clerk", "o_orderpriority"])


def sql_row_hash(columns: list[str], source: str) -> str:
    """Every row of ``source`` with its hash: MD5 of the seed, the columns' texts and the number among its copies."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns)
    return (f"(SELECT *, CAST('0x' || substr(md5(plain || ':' || row_number() OVER (PARTITION BY plain)), 1, 15) AS BIGINT) "
            f"AS h FROM (SELECT *, md5(concat_ws(chr(31), '{regression.SEED}', {cells})) AS plain FROM {source}) s)")


_SPLIT = ["l_orderkey", "l_linenumber", "l_returnflag"]


@register("P5_split_of_rows_and_copies", f"""
SELECT 'rows' AS part, concat_ws('-', l_orderkey, l_linenumber) AS row, h % 10 < 8 AS train, 1 AS n
FROM {sql_row_hash(_SPLIT, "lineitem")} a
UNION ALL SELECT 'copies', l_returnflag, h % 10 < 8, COUNT(*) FROM {sql_row_hash(["l_returnflag"], "lineitem")} b GROUP BY 2, 3""")
def p5(spark, d):
    """The training flag of every row, and how many copies of a few distinct rows go to either part."""
    li = table(spark, d, "lineitem").select(*_SPLIT)
    rows = regression.with_row_hash(li).select(
        F.lit("rows").alias("part"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"),
        regression.in_training().alias("train"), F.lit(1).cast("long").alias("n"))
    copies = regression.with_row_hash(li.select("l_returnflag")) \
        .groupBy(F.col("l_returnflag").alias("row"), regression.in_training().alias("train")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("copies"))
    return rows.unionByName(copies)


@register("P13_sample_of_test_rows", f"""
SELECT l_orderkey AS actual, l_linenumber AS predicted FROM {sql_row_hash(_SPLIT, "lineitem")} a
WHERE h % 10 >= 8 ORDER BY h, l_orderkey, l_linenumber LIMIT {regression.SAMPLE_ROWS}""")
def p13_rows(spark, d):
    """The plotted sample of test rows, with two columns of the table as actual and predicted values."""
    hashed = regression.with_row_hash(table(spark, d, "lineitem").select(*_SPLIT))
    test = hashed.filter(~regression.in_training())
    return regression.sample_rows(test, "l_orderkey", "l_linenumber")


@register("P_forest_metrics")
def p_metrics(spark, d):
    return regression.metrics(forest_run(spark, d))


@register("P12_forest_importances")
def p12(spark, d):
    return regression.importances(forest_run(spark, d))


@register("P13_forest_actual_vs_predicted_sample")
def p13(spark, d):
    return regression.actual_vs_predicted_sample(forest_run(spark, d))


@register("P14_forest_sample_trend_line")
def p14(spark, d):
    return regression.sample_trend(forest_run(spark, d))
