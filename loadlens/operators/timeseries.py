"""Time trends: hourly means and hour-bucket metrics on the 19-bucket spine.

The spine join is a broadcast hash join of a 19-row table against an
aggregate that has at most 19 (+ unknown-label) groups, so it never shuffles
the input: the input side is reduced by partial aggregation first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from loadlens.functions.cleaning import ms_to_seconds
from loadlens.functions.timebuckets import bucket_labels, bucket_ordinal, bucket_spine, hour_bucket
from loadlens.operators.aggregates import MetricSpec, group_metrics


def truncate_to_hour(df: DataFrame, ts: str) -> Column:
    """Start of the clock hour, keeping the column's timestamp flavour.

    ``date_trunc`` returns a zoned timestamp; for a zone-less (NTZ) column the
    hour is rebuilt from its fields so no time-zone conversion is involved.
    """
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    return F.date_trunc("hour", c)


def hourly_mean(df: DataFrame, ts: str, value: str, decimal_scale: int | None = None,
                hour_col: str = "hour", alias: str | None = None) -> DataFrame:
    """Mean of ``value`` per clock hour of ``ts``; hours without rows are absent.

    A tumbling one-hour window on static data: ``date_trunc('hour')`` keys a
    hash aggregate; rows with a null timestamp are dropped.
    """
    out = alias or value
    keyed = df.select(truncate_to_hour(df, ts).alias(hour_col), F.col(value))
    agg = group_metrics(keyed, hour_col, [(out, "avg", value)], decimal_scale)
    return agg.orderBy(hour_col)


def with_hour_bucket(df: DataFrame, ts: str, label_col: str = "TIME_RANGE") -> DataFrame:
    """Add the hour-bucket label of ``ts``; rows with a null ``ts`` are dropped."""
    return df.filter(F.col(ts).isNotNull()).withColumn(label_col, hour_bucket(ts))


def bucket_metrics_on_spine(df: DataFrame, label_col: str, metrics: Sequence[MetricSpec],
                            decimal_scale: int | None = None, seconds: Sequence[str] = ()) -> DataFrame:
    """Metrics per bucket label on the full 19-bucket spine; missing buckets -> 0.

    Output: label, metrics (and ``<metric>_SECONDS`` for names in ``seconds``),
    ordered by the fixed bucket order. Labels outside the spine are not kept:
    they are filtered out before the aggregate (a pushed-down IN list), so the
    broadcast aggregate has at most 19 rows whatever the label column holds.
    """
    known = df.filter(F.col(label_col).isin(bucket_labels()))
    return on_spine(group_metrics(known, label_col, metrics, decimal_scale), label_col, [m[0] for m in metrics], seconds)


def on_spine(agg: DataFrame, label_col: str, names: Sequence[str], seconds: Sequence[str] = ()) -> DataFrame:
    """Bucket metrics (one row per label) laid on the spine; see ``bucket_metrics_on_spine``."""
    spine = bucket_spine(agg.sparkSession, label_col)
    # Both sides are bounded: 19 spine rows, at most 19 aggregate rows.
    joined = spine.join(F.broadcast(agg.filter(F.col(label_col).isin(bucket_labels()))), on=label_col, how="left")
    cols = [F.col(label_col)] + [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    cols += [ms_to_seconds(F.coalesce(F.col(n), F.lit(0.0))).alias(f"{n}_SECONDS") for n in seconds]
    return joined.orderBy("ord").select(*cols)


def bucket_metrics_ordered(df: DataFrame, label_col: str, metrics: Sequence[MetricSpec],
                           decimal_scale: int | None = None, to_seconds: bool = False) -> DataFrame:
    """Metrics per bucket label, no spine (absent buckets stay absent).

    Ordered by the fixed bucket order; labels outside it sort last, by name.
    With ``to_seconds`` every metric is divided by 1000.
    """
    agg = group_metrics(df, label_col, metrics, decimal_scale)
    return in_bucket_order(agg, label_col, [m[0] for m in metrics], to_seconds)


def in_bucket_order(agg: DataFrame, label_col: str, names: Sequence[str], to_seconds: bool = False) -> DataFrame:
    """Bucket metrics (one row per label) in the fixed order; see ``bucket_metrics_ordered``."""
    cols = [F.col(label_col)] + [(ms_to_seconds(n) if to_seconds else F.col(n)).alias(n) for n in names]
    return agg.orderBy(bucket_ordinal(label_col), F.col(label_col)).select(*cols)
