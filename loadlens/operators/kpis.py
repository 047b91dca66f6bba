"""Headline KPIs as one single-row DataFrame.

Each source contributes one scalar subquery (one partial aggregate per task);
KPIs sharing a source share that subquery. The row is ``spark.range(1)`` with
the subqueries projected onto it: no join, nothing collected by the driver.
Missing source / missing column / empty source -> 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.cleaning import bytes_to_mib, ms_to_seconds, thousands_label


def _has(df: DataFrame | None, col: str) -> bool:
    return df is not None and col in df.columns


def _scalar_struct(df: DataFrame, fields: dict[str, Column]) -> Column:
    return df.agg(F.struct(*[e.alias(n) for n, e in fields.items()]).alias("s")).scalar()


def kpis(spark: SparkSession, hitlist: DataFrame | None = None, memory: DataFrame | None = None,
         sql_trace: DataFrame | None = None, resp: str = "RESPTI", cpu: str = "CPUTI",
         dbcalls: str = "DBCALLS", used: str = "USEDBYTES", totalexec: str = "TOTALEXEC") -> DataFrame:
    """avg response (s), avg memory (MiB), total DB calls, total SQL executions, avg CPU (s)."""
    hit_fields = {n: e for n, e, ok in [
        ("resp", F.avg(F.col(resp)), _has(hitlist, resp)),
        ("db", F.sum(F.col(dbcalls)), _has(hitlist, dbcalls)),
        ("cpu", F.avg(F.col(cpu)), _has(hitlist, cpu)),
    ] if ok}
    hs = _scalar_struct(hitlist, hit_fields) if hit_fields else None

    ms = _scalar_struct(memory, {"used": F.avg(F.col(used))}) if _has(memory, used) else None
    qs = _scalar_struct(sql_trace, {"execs": F.sum(F.col(totalexec))}) if _has(sql_trace, totalexec) else None
    cols = [
        (hs.alias("h") if hs is not None else F.lit(None).alias("h")),
        (ms.alias("m") if ms is not None else F.lit(None).alias("m")),
        (qs.alias("q") if qs is not None else F.lit(None).alias("q")),
    ]
    row = spark.range(1).select(*cols)

    def fld(struct: str, name: str, present: bool) -> Column:
        return F.coalesce(F.col(f"{struct}.{name}").cast("double"), F.lit(0.0)) if present else F.lit(0.0)

    out = row.select(
        ms_to_seconds(fld("h", "resp", "resp" in hit_fields)).alias("avg_resp_s"),
        bytes_to_mib(fld("m", "used", ms is not None)).alias("avg_mem_mib"),
        fld("h", "db", "db" in hit_fields).alias("total_db_calls"),
        fld("q", "execs", qs is not None).alias("total_sql_execs"),
        ms_to_seconds(fld("h", "cpu", "cpu" in hit_fields)).alias("avg_cpu_s"),
    )
    return out


def kpi_labels(k: DataFrame) -> DataFrame:
    """Display texts: two decimals for means, space-grouped integers for totals."""
    return k.select(
        F.format_string("%.2f", "avg_resp_s").alias("avg_resp_s"),
        F.format_string("%.2f", "avg_mem_mib").alias("avg_mem_mib"),
        thousands_label("total_db_calls").alias("total_db_calls"),
        thousands_label("total_sql_execs").alias("total_sql_execs"),
        F.format_string("%.2f", "avg_cpu_s").alias("avg_cpu_s"),
    )
