"""Threshold anomalies: rows above ``mean + m * sample std``.

The statistics are one scalar subquery (partial avg / stddev per task, one
row merged), evaluated once and inlined as a literal into the row filter: no
join, no driver round-trip, two column-pruned passes over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.cleaning import to_double
from loadlens.operators.aggregates import sort_rows

# fixed values: the multiplier slider of the original reports
M_MIN, M_MAX, M_STEP, M_DEFAULT = 1.0, 5.0, 0.1, 3.0


def validate_multiplier(m: float) -> float:
    steps = round((m - M_MIN) / M_STEP)
    if not (M_MIN <= m <= M_MAX) or abs(M_MIN + steps * M_STEP - m) > 1e-9:
        raise ValueError(f"multiplier must be in [{M_MIN}, {M_MAX}] in steps of {M_STEP}, got {m}")
    return round(M_MIN + steps * M_STEP, 1)


def prepare(df: DataFrame, value: str, ts: str | None = None) -> DataFrame:
    """Coerce the metric to double (bad -> 0) and drop rows without a timestamp."""
    out = df.withColumn(value, to_double(value, df.schema[value].dataType))
    return out.filter(F.col(ts).isNotNull()) if ts else out


def threshold_scalar(df: DataFrame, value: str, m: float) -> Column:
    """Scalar subquery: ``mean + m * stddev_samp`` when ``sum(value) > 0``, else null.

    With a single row the sample std is null, so the threshold is null and no
    row can exceed it.
    """
    m = validate_multiplier(m)
    v = F.col(value)
    thr = F.when(F.sum(v) > 0, F.avg(v) + F.lit(m) * F.stddev_samp(v))
    return df.agg(thr.alias("threshold")).scalar()


def anomalies(df: DataFrame, value: str, m: float = M_DEFAULT, columns: Sequence[str] | None = None,
              ts: str | None = None, key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows with ``value`` strictly above the threshold, largest first.

    ``columns`` picks the output columns (default: all). Ties on ``value``
    break by ``key`` (default: the remaining output columns) for a stable order.
    """
    base = prepare(df, value, ts)
    out_cols = list(columns) if columns else base.columns
    flagged = base.withColumn("threshold", threshold_scalar(base, value, m))
    hits = flagged.filter(F.col(value) > F.col("threshold")).select(*out_cols)
    ties = [key] if isinstance(key, str) else list(key or [c for c in out_cols if c != value])
    return sort_rows(hits, F.col(value).desc(), *[F.col(c).asc() for c in ties])


def anomaly_count(df: DataFrame, value: str, m: float = M_DEFAULT, ts: str | None = None) -> DataFrame:
    """One row: the threshold and the number of rows above it."""
    base = prepare(df, value, ts)
    flagged = base.select(F.col(value), threshold_scalar(base, value, m).alias("threshold"))
    return flagged.agg(F.first("threshold", ignorenulls=True).alias("threshold"),
                       F.count(F.when(F.col(value) > F.col("threshold"), 1)).alias("n_anomalies"))


def anomaly_overlay(df: DataFrame, value: str, m: float = M_DEFAULT, ts: str | None = None,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Every row with the threshold and an ``is_anomaly`` flag (chart overlay).

    Empty when the evidence guard fails (``sum(value) <= 0``).
    """
    base = prepare(df, value, ts)
    m = validate_multiplier(m)
    v = F.col(value)
    stats = base.agg(F.struct((F.sum(v) > 0).alias("ok"),
                              (F.avg(v) + F.lit(m) * F.stddev_samp(v)).alias("thr")).alias("s")).scalar()
    keep = list(columns) if columns else base.columns
    out = base.select(*keep, stats.alias("__s"))
    return (out.filter(F.col("__s.ok"))
               .withColumn("threshold", F.col("__s.thr"))
               .withColumn("is_anomaly", F.coalesce(v > F.col("threshold"), F.lit(False)))
               .drop("__s"))
