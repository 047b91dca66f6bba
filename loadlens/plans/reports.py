"""Report sections over cleaned workload exports: one function per section.

Input is the dict produced by ``sources.load_all`` (source key -> cleaned
DataFrame). Each section returns an ordered dict of named, lazy DataFrames —
the table behind every chart of the original reports. An output is left
out when its columns are missing (checked on the schema). All grouped outputs of a
section and its "metric total > 0" evidence guards come from one pass over its
source (``operators.onepass``), held from the first use until ``release()``; a
failing guard yields the output's empty form. Building a section runs no job (but
for ``ml_section``, which fits).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.cleaning import as_text, ms_to_seconds, short_label
from loadlens.functions.timebuckets import hour_bucket
from loadlens.operators import aggregates as agg
from loadlens.operators import anomaly, density, filters, kpis, regression, timeseries
from loadlens.operators.onepass import GroupedPass
from loadlens.sources.specs import MEMORY_ACCOUNT_DEFAULT

# --- fixed values: column groups and defaults of the original sections ----------------
MEMORY_METRICS = ("USEDBYTES", "MAXBYTES", "PRIVSUM")
IO_COUNTS = ("READDIRCNT", "READSEQCNT", "CHNGCNT", "PHYREADCNT")
IO_BUFFERS = ("READDIRBUF", "READDIRREC", "READSEQBUF", "READSEQREC", "CHNGREC", "PHYCHNGREC")
COMM_METRICS = ("DSQLCNT", "SLI_CNT")
TOTAL_IO_PARTS = ("READDIRCNT", "READSEQCNT", "CHNGCNT")
HOURLY_TIMES = ("RESPTI", "CPUTI", "PROCTI")
TASK_TIMES = ("RESPTI", "PROCTI", "CPUTI", "QUEUETI")
HITLIST_TIMES = ("RESPTI", "CPUTI")
DEFAULT_SERVER = "ECC-VE7-00"
TOP_ACCOUNTS_FOR_MEAN = 6
# ---------------------------------------------------------------------------------------


@dataclass
class Filters:
    """List filters of the sidebar; an empty list means "no filter"."""
    accounts: Sequence[str] = field(default_factory=list)
    reports: Sequence[str] = field(default_factory=list)
    wp_types: Sequence[str] = field(default_factory=list)
    tasktypes: Sequence[str] = field(default_factory=list)


def _has(df: DataFrame | None, *cols: str) -> bool:
    return df is not None and all(c in df.columns for c in cols)


def filter_options(dfs: Mapping[str, DataFrame], accounts: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Choices offered by the sidebar: accounts across three sources; reports of the
    hit list once the chosen accounts are applied; work-process types."""
    out: dict[str, DataFrame] = {}
    acc = [(dfs[k], "ACCOUNT") for k in ("memory", "usertcode", "hitlist_db") if _has(dfs.get(k), "ACCOUNT")]
    if acc:
        out["accounts"] = filters.value_options(acc)
    hit = dfs.get("hitlist_db")
    if _has(hit, "REPORT"):
        if _has(hit, "ACCOUNT"):
            hit = filters.in_values(hit, "ACCOUNT", accounts)
        out["reports"] = filters.value_options([(hit, "REPORT")])
    if _has(dfs.get("performance"), "WP_TYP"):
        out["wp_types"] = filters.value_options([(dfs["performance"], "WP_TYP")])
    return out


def apply_filters(dfs: Mapping[str, DataFrame], f: Filters) -> dict[str, DataFrame]:
    """Account list over memory / usertcode / hitlist_db, report list over hitlist_db,
    WP type list over performance, optional task-type list wherever a TASKTYPE column exists."""
    out = dict(dfs)
    for k in ("memory", "usertcode", "hitlist_db"):
        if _has(out.get(k), "ACCOUNT"):
            out[k] = filters.in_values(out[k], "ACCOUNT", f.accounts)
    if _has(out.get("hitlist_db"), "REPORT"):
        out["hitlist_db"] = filters.in_values(out["hitlist_db"], "REPORT", f.reports)
    if _has(out.get("performance"), "WP_TYP"):
        out["performance"] = filters.in_values(out["performance"], "WP_TYP", f.wp_types)
    for k, df in list(out.items()):
        if _has(df, "TASKTYPE"):
            out[k] = filters.in_values(df, "TASKTYPE", f.tasktypes)
    return out


def kpi_section(spark: SparkSession, dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The five KPIs, computed on the unfiltered sources."""
    k = kpis.kpis(spark, dfs.get("hitlist_db"), dfs.get("memory"), dfs.get("sql_trace_summary"))
    return {"kpis": k, "kpi_labels": kpis.kpi_labels(k)}


class Section(dict):
    """The named outputs of a section. Its grouped outputs share one held pass over the source; ``release`` frees it."""

    def __init__(self, grouped: GroupedPass | None = None):
        super().__init__()
        self.grouped = grouped

    def guarded(self, name: str, result: DataFrame, cols: Sequence[str]) -> None:
        """Add an output; it is empty when the metric total of the input is not > 0."""
        self[name] = result.filter(self.grouped.positive(cols))

    def release(self) -> None:
        if self.grouped is not None:
            self.grouped.release()


def _sums(cols: Sequence[str]) -> list[agg.MetricSpec]:
    return [(c, "sum", c) for c in cols]


def _means(cols: Sequence[str]) -> list[agg.MetricSpec]:
    return [(c, "avg", c) for c in cols]


def _density(df: DataFrame, column: str, bins: int | None, exact: bool) -> DataFrame:
    """A section's curve: by convolution, unless the exact one or equal-width bins are asked for."""
    return density.kde(df, column, bins=bins) if bins or exact else density.kde_by_convolution(df, column)


def memory_section(dfs: Mapping[str, DataFrame], bins: int | None = None, exact: bool = False) -> dict[str, DataFrame]:
    src = dfs.get("memory")
    if src is None:
        return Section()
    once = GroupedPass(src)
    out = Section(once)
    once.total(MEMORY_METRICS)
    frequent = [("__n", "count", "*"), *_means(["USEDBYTES"])]
    by_account, by_hour = _has(src, "ACCOUNT", *MEMORY_METRICS), _has(src, "FULL_DATETIME", "USEDBYTES")
    if by_account:
        once.by("ACCOUNT", _sums(MEMORY_METRICS))
    if _has(src, "ACCOUNT", "USEDBYTES"):
        once.by("ACCOUNT", frequent)
    if by_hour:
        once.by("FULL_DATETIME", _means(["USEDBYTES"]), timeseries.truncate_to_hour(src, "FULL_DATETIME"))
    if by_account:
        top = agg.top_k(once.groups("ACCOUNT", _sums(MEMORY_METRICS)), "USEDBYTES", "ACCOUNT", 10)
        out.guarded("top_accounts_by_usedbytes", agg.keep_if_positive_total(top, "USEDBYTES"), ["USEDBYTES"])
        out.guarded("memory_metrics_long", agg.to_long(top, "ACCOUNT", list(MEMORY_METRICS)), MEMORY_METRICS)
    if _has(src, "ACCOUNT", "USEDBYTES"):
        keyed = filters.exclude_value(once.groups("ACCOUNT", frequent), "ACCOUNT", MEMORY_ACCOUNT_DEFAULT) \
            .select(as_text("ACCOUNT").alias("account_label"), "__n", "USEDBYTES")
        # frequency and mean come with the account's group; the 6 most frequent are a k-row top-k
        top = agg.top_k(keyed, "__n", "account_label", TOP_ACCOUNTS_FOR_MEAN).drop("__n")
        out.guarded("avg_usedbytes_by_account", agg.sort_by(top, "USEDBYTES", "account_label"), ["USEDBYTES"])
        out.guarded("usedbytes_density", _density(src, "USEDBYTES", bins, exact), ["USEDBYTES"])
    if by_hour:
        out.guarded("hourly_usedbytes", once.groups("FULL_DATETIME", _means(["USEDBYTES"])).orderBy("FULL_DATETIME"),
                    ["USEDBYTES"])
    return out


def transactions_section(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    src = dfs.get("usertcode")
    if src is None:
        return Section()
    once = GroupedPass(src)
    out = Section(once)
    once.total(("CPUTI", "RESPTI", *IO_COUNTS, *IO_BUFFERS, *COMM_METRICS))
    counted = [("n_transactions", "count", "*")]
    long_forms = [x for x in (("io_counts_long", IO_COUNTS, "PHYREADCNT", 10),
                              ("io_buffers_records_long", IO_BUFFERS, "READDIRREC", 10),
                              ("comm_metrics_long", COMM_METRICS, "DSQLCNT", 4)) if _has(src, "ACCOUNT", *x[1])]
    if _has(src, "ACCOUNT"):
        once.by("ACCOUNT", counted + (_means(["CPUTI"]) if _has(src, "CPUTI") else [])
                + [m for _, cols, _, _ in long_forms for m in _sums(cols)])
    if _has(src, "REPORT", "RESPTI"):
        once.by("REPORT", _means(["RESPTI"]))
    if _has(src, "FULL_DATETIME", "RESPTI"):
        once.by("hour_bucket", _means(["RESPTI"]), hour_bucket("FULL_DATETIME"))

    if _has(src, "ACCOUNT", "CPUTI"):
        top = agg.top_k(once.groups("ACCOUNT", _means(["CPUTI"])), "CPUTI", "ACCOUNT", 10)
        out.guarded("top_accounts_by_cpu", top.withColumn("cpu_seconds", ms_to_seconds("CPUTI")), ["CPUTI"])
    if _has(src, "REPORT", "RESPTI"):
        top = agg.top_k(once.groups("REPORT", _means(["RESPTI"])), "RESPTI", "REPORT", 10)
        out.guarded("top_reports_by_resp", agg.share_of_small(top, "RESPTI"), ["RESPTI"])
    if _has(src, "ACCOUNT"):
        out["transactions_per_account"] = agg.top_k(once.groups("ACCOUNT", counted), "n_transactions", "ACCOUNT", 10)
    if _has(src, "FULL_DATETIME", "RESPTI"):
        out.guarded("resp_by_hour_bucket", timeseries.on_spine(once.groups("hour_bucket", _means(["RESPTI"])),
                                                               "hour_bucket", ["RESPTI"], seconds=["RESPTI"]), ["RESPTI"])
    if _has(src, "RESPTI", "CPUTI"):
        extra = [c for c in ("ACCOUNT", "ENTRY_ID") if c in src.columns]
        pairs = src.filter((F.col("RESPTI") > 0) & (F.col("CPUTI") > 0)).select("CPUTI", "RESPTI", *extra)
        out["cpu_vs_resp_points"] = pairs.filter(once.positive(["CPUTI"]) & once.positive(["RESPTI"]))
    for name, cols, order, k in long_forms:
        top = agg.top_k(once.groups("ACCOUNT", _sums(cols)), order, "ACCOUNT", k)
        out.guarded(name, agg.to_long(top, "ACCOUNT", list(cols)), cols)
    return out


def hourly_section(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    src = dfs.get("times")
    if src is None:
        return Section()
    with_io = _has(src, "TIME", *TOTAL_IO_PARTS)
    io = "__TOTAL_IO"
    if with_io:
        src = src.withColumn(io, sum((F.col(c) for c in TOTAL_IO_PARTS[1:]), F.col(TOTAL_IO_PARTS[0])))
    once = GroupedPass(src)
    out = Section(once)
    once.total(("PHYCALLS", *TOTAL_IO_PARTS, *HOURLY_TIMES))
    wanted = [*(_sums(["PHYCALLS"]) if _has(src, "PHYCALLS") else []), *([("TOTAL_IO", "sum", io)] if with_io else []),
              *(_means(HOURLY_TIMES) if _has(src, *HOURLY_TIMES) else [])]
    if _has(src, "TIME"):
        once.by("TIME", wanted)
    if _has(src, "TIME", "PHYCALLS"):
        out.guarded("phycalls_by_time", timeseries.on_spine(once.groups("TIME", _sums(["PHYCALLS"])), "TIME",
                                                            ["PHYCALLS"]), ["PHYCALLS"])
    if with_io:
        top = agg.top_k(once.groups("TIME", [("TOTAL_IO", "sum", io)]), "TOTAL_IO", "TIME", 5)
        out.guarded("top_times_by_total_io", top, TOTAL_IO_PARTS)
    if _has(src, "TIME", *HOURLY_TIMES):
        wide = timeseries.in_bucket_order(once.groups("TIME", _means(HOURLY_TIMES)), "TIME", HOURLY_TIMES,
                                          to_seconds=True)
        out.guarded("mean_times_by_time_long", agg.to_long(wide, "TIME", list(HOURLY_TIMES)), HOURLY_TIMES)
    return out


def tasks_section(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    src = dfs.get("tasktimes")
    if src is None:
        return Section()
    once = GroupedPass(src)
    out = Section(once)
    once.total((*TASK_TIMES, "PHYCALLS"))
    times, calls = _has(src, "ENTRY_ID", *TASK_TIMES), _has(src, "ENTRY_ID", "PHYCALLS")
    if times:
        once.by("ENTRY_ID", _means(TASK_TIMES))
    if calls:
        once.by("ENTRY_ID", _sums(["PHYCALLS"]))
    if times:
        top = agg.top_k(once.groups("ENTRY_ID", _means(TASK_TIMES)), "RESPTI", "ENTRY_ID", 10)
        out.guarded("mean_times_by_entry_long", agg.to_long(top, "ENTRY_ID", list(TASK_TIMES)), TASK_TIMES)
    if calls:
        out.guarded("top_entries_by_phycalls",
                    agg.top_k(once.groups("ENTRY_ID", _sums(["PHYCALLS"])), "PHYCALLS", "ENTRY_ID", 10), ["PHYCALLS"])
    return out


def hitlist_section(dfs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    src = dfs.get("hitlist_db")
    if src is None:
        return Section()
    once = GroupedPass(src)
    out = Section(once)
    once.total((*HITLIST_TIMES, "DBCALLS", "ROLLOUTCNT"))
    times, calls = _has(src, "REPORT", *HITLIST_TIMES), _has(src, "REPORT", "DBCALLS")
    rollouts = _has(src, "ACCOUNT", "ROLLOUTCNT")
    if times:
        once.by("REPORT", _means(HITLIST_TIMES))
    if calls:
        once.by("REPORT", _sums(["DBCALLS"]))
    if rollouts:
        once.by("ACCOUNT", _sums(["ROLLOUTCNT"]))
    if times:
        top = agg.top_k(once.groups("REPORT", _means(HITLIST_TIMES)), "RESPTI", "REPORT", 10)
        out.guarded("mean_times_by_report_long", agg.to_long(top, "REPORT", list(HITLIST_TIMES)), HITLIST_TIMES)
    if calls:
        out.guarded("top_reports_by_dbcalls",
                    agg.top_k(once.groups("REPORT", _sums(["DBCALLS"])), "DBCALLS", "REPORT", 10), ["DBCALLS"])
    if rollouts:
        out.guarded("top_accounts_by_rollouts",
                    agg.top_k(once.groups("ACCOUNT", _sums(["ROLLOUTCNT"])), "ROLLOUTCNT", "ACCOUNT", 10), ["ROLLOUTCNT"])
    return out


def workprocess_section(dfs: Mapping[str, DataFrame], bins: int | None = None, exact: bool = False) -> dict[str, DataFrame]:
    src = dfs.get("performance")
    if src is None:
        return Section()
    once = GroupedPass(src)
    out = Section(once)
    once.total(("WP_CPU_SECONDS",))
    counted, timed = [("count", "count", "*")], _means(["WP_CPU_SECONDS"])
    if _has(src, "WP_TYP"):
        once.by("WP_TYP", counted + (timed if _has(src, "WP_CPU_SECONDS") else []))
    if _has(src, "WP_CPU_SECONDS"):
        out.guarded("cpu_seconds_density", _density(src, "WP_CPU_SECONDS", bins, exact), ["WP_CPU_SECONDS"])
    if _has(src, "WP_TYP"):
        out["count_by_type"] = agg.sort_by(once.groups("WP_TYP", counted), "count", "WP_TYP")
    if _has(src, "WP_TYP", "WP_CPU_SECONDS"):
        out.guarded("mean_cpu_by_type", agg.sort_by(once.groups("WP_TYP", timed), "WP_CPU_SECONDS", "WP_TYP"),
                    ["WP_CPU_SECONDS"])
    return out


def sqltrace_section(dfs: Mapping[str, DataFrame], server_text: str = DEFAULT_SERVER,
                     bins: int | None = None, exact: bool = False) -> dict[str, DataFrame]:
    src = dfs.get("sql_trace_summary")
    if src is None:
        return Section()
    # the density's guard is on the matching servers only: their values, and nothing elsewhere
    matching = "__AVGTPERREC"
    with_density = _has(src, "SERVERNAME", "AVGTPERREC")
    if with_density:
        here = filters.matches_ci("SERVERNAME", server_text)
        src = src.withColumn(matching, F.when(here, F.col("AVGTPERREC")))
    once = GroupedPass(src)
    out = Section(once)
    once.total(("EXECTIME", "TIMEPEREXE", "RECPROCNUM", matching))
    shown = [x for x in (("top_statements_by_exectime", "sum", "EXECTIME"),
                         ("top_statements_by_time_per_exec", "avg", "TIMEPEREXE"),
                         ("top_statements_by_records", "sum", "RECPROCNUM")) if _has(src, "SQLSTATEM", x[2])]
    for _, fn, col in shown:
        once.by("SQLSTATEM", [(col, fn, col)])
    for name, fn, col in shown:
        top = agg.top_k(once.groups("SQLSTATEM", [(col, fn, col)]), col, "SQLSTATEM", 10)
        out.guarded(name, top.withColumn("statement_label", short_label("SQLSTATEM")), [col])
    if with_density:
        srv = filters.contains_ci(src, "SERVERNAME", server_text)
        out.guarded("avg_time_per_record_density", _density(srv, "AVGTPERREC", bins, exact), [matching])
    return out


def users_section(dfs: Mapping[str, DataFrame], f: Filters | None = None,
                  max_valid_date: str | None = None) -> dict[str, DataFrame]:
    """User types, validity dates and users without a date.

    The chosen accounts filter BNAME for the first two outputs; the
    "without a date" list uses the table without that filter. ``max_valid_date``
    (e.g. ``'2262-04-11'``) treats later dates as missing, like a
    nanosecond-range date parser would.
    """
    u = dfs.get("usr02")
    out: dict[str, DataFrame] = {}
    if u is None:
        return out
    if max_valid_date and "GLTGB_DATE" in u.columns:
        u = u.withColumn("GLTGB_DATE", F.when(F.col("GLTGB_DATE") <= F.lit(max_valid_date).cast("date"),
                                               F.col("GLTGB_DATE")))
    full = u
    if f and f.accounts and "BNAME" in u.columns:
        u = filters.in_values(u, "BNAME", f.accounts)
    if _has(u, "USTYP"):
        out["count_by_user_type"] = agg.share_of_total(agg.count_by(u, "USTYP", "count"), "count")
    if _has(u, "GLTGB_DATE"):
        out["count_by_validity_date"] = agg.count_by(u, "GLTGB_DATE", "count").orderBy("GLTGB_DATE")
    if _has(full, "BNAME", "GLTGB_DATE"):
        cols = [c for c in ("BNAME", "GLTGB_DATE", "USTYP") if c in full.columns]
        missing = filters.null_rows(full, "GLTGB_DATE").select(*cols)
        out["users_without_date"] = agg.sort_rows(missing, *[F.col(c).asc() for c in cols])
        out["users_without_date_count"] = missing.agg(F.count(F.lit(1)).alias("count"))
    return out


def anomaly_section(dfs: Mapping[str, DataFrame], m: float = anomaly.M_DEFAULT) -> dict[str, DataFrame]:
    h = dfs.get("hitlist_db")
    if not _has(h, "RESPTI", "FULL_DATETIME"):
        return {}
    cols = [c for c in ("FULL_DATETIME", "RESPTI", "ACCOUNT", "REPORT") if c in h.columns]
    return {
        "threshold": anomaly.anomaly_count(h, "RESPTI", m, ts="FULL_DATETIME"),
        "anomalies": anomaly.anomalies(h, "RESPTI", m, cols, ts="FULL_DATETIME"),
        "overlay": anomaly.anomaly_overlay(h, "RESPTI", m, ts="FULL_DATETIME", columns=cols),
    }


# fixed values: the sources offered to the regression job, the first is the default
ML_SOURCES = ("hitlist_db", "memory", "times", "usertcode", "performance", "sql_trace_summary")


def ml_section(dfs: Mapping[str, DataFrame], target: str, source: str = ML_SOURCES[0],
               num_trees: int = regression.NUM_TREES, max_depth: int = regression.DEFAULT_MAX_DEPTH,
               max_categories: int | None = None, seed: int = regression.SEED) -> dict[str, DataFrame]:
    """Random-forest regression of ``target`` on the other columns of one source (P1-P14).

    Fits when called (the pipeline fit is a series of Spark jobs); the returned
    tables are the metrics with split sizes, the named importances, the plotted
    sample and its trend line, and the features left out by the pruning rules.
    """
    if source not in ML_SOURCES:
        raise ValueError(f"source must be one of {ML_SOURCES}")
    src = dfs.get(source)
    if src is None or src.isEmpty():
        return {}
    if target not in regression.numeric_columns(src):
        raise ValueError(f"{target!r} is not a numeric column of {source}")
    run = regression.fit_forest(src, target, num_trees=num_trees, max_depth=max_depth,
                                max_categories=max_categories, seed=seed)
    spark = src.sparkSession
    return {
        "metrics": regression.metrics(run),
        "importances": regression.importances(run, top=None),
        "actual_vs_predicted": regression.actual_vs_predicted_sample(run),
        "trend_line": regression.sample_trend(run),
        "dropped_features": spark.createDataFrame([(c,) for c in run.dropped], "feature string"),
    }


SECTIONS = {
    "memory": memory_section,
    "transactions": transactions_section,
    "hourly": hourly_section,
    "tasks": tasks_section,
    "hitlist": hitlist_section,
    "workprocess": workprocess_section,
    "sqltrace": sqltrace_section,
    "anomalies": anomaly_section,
}


def report(spark: SparkSession, dfs: Mapping[str, DataFrame], f: Filters | None = None,
           sections: Sequence[str] | None = None) -> dict[str, dict[str, DataFrame]]:
    """KPIs on the unfiltered sources, then the chosen sections on the filtered ones."""
    f = f or Filters()
    filtered = apply_filters(dfs, f)
    out = {"kpis": kpi_section(spark, dfs)}
    for name in (list(SECTIONS) + ["users"]) if sections is None else sections:
        if name == "users":
            out[name] = users_section(filtered, f)
        else:
            out[name] = SECTIONS[name](filtered)
    return out
