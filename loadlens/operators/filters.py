"""Filters and filter options (the sidebar of the original reports).

Plain predicates (``isin``, ``!=``, ``contains``) stay as Filter nodes that
Catalyst pushes into the Parquet scan when they touch raw columns.
Membership in another DataFrame is a ``left_semi`` join: broadcast when the
key side is bounded (a top-k list), otherwise a shuffle join chosen by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from loadlens.operators.aggregates import count_by, top_k

def value_options(frames: Sequence[tuple[DataFrame, str]], alias: str = "value") -> DataFrame:
    """Sorted distinct non-null values of one column across several frames."""
    if not frames:
        raise ValueError("need at least one (frame, column)")
    parts = [df.select(F.col(c).cast("string").alias(alias)) for df, c in frames]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.na.drop().distinct().orderBy(alias)


def in_values(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Keep rows whose ``column`` is in ``values``; an empty list means no filter.

    One predicate for a list of any length (a hash-set test once planned), so rows, column order and the common
    type of mixed values never depend on the length. The list is the caller's, on the driver anyway.
    """
    if not values:
        return df
    return df.filter(F.col(column).isin(list(dict.fromkeys(values))))


def in_frame(df: DataFrame, column: str, keys: DataFrame, key_column: str | None = None,
             bounded: bool = False) -> DataFrame:
    """Semi-join: keep rows whose ``column`` appears in ``keys``.

    ``bounded=True`` declares the key frame small by construction (e.g. a
    top-k), so it is broadcast; otherwise the planner decides at run time.
    """
    kc = key_column or column
    # a semi-join ignores duplicate keys, so no distinct (and no extra shuffle) is needed
    k = keys.select(F.col(kc).alias("__k"))
    k = F.broadcast(k) if bounded else k
    return df.join(k, df[column] == k["__k"], "left_semi")


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop the placeholder key (null keys drop as well, as in SQL)."""
    return df.filter(F.col(column) != F.lit(value))


def contains_ci(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-insensitive literal substring match; empty text means no filter."""
    return df.filter(matches_ci(column, text)) if text else df


def matches_ci(column: str, text: str | None) -> Column:
    """The predicate of ``contains_ci``."""
    return F.lower(F.col(column)).contains(text.lower()) if text else F.lit(True)


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def top_frequent_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent non-null keys (ties by key ascending): at most k rows."""
    return top_k(count_by(df, key, "__n"), "__n", key, k).select(key)


def restrict_to_top_frequent(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose key is among the k most frequent keys (broadcast semi-join of k keys)."""
    return in_frame(df, key, top_frequent_keys(df, key, k), bounded=True)


# --- trailing ranges relative to the newest row ---------------------------------
# fixed values: the chart range buttons of the original reports
RANGE_INTERVALS = {
    "1h": "INTERVAL 1 HOUR",
    "6h": "INTERVAL 6 HOURS",
    "1d": "INTERVAL 1 DAY",
    "1m": "INTERVAL 1 MONTH",
    "6m": "INTERVAL 6 MONTHS",
    "1y": "INTERVAL 1 YEAR",
}


def trailing_range(df: DataFrame, ts: str, period: str) -> DataFrame:
    """Rows with ``ts`` in the trailing ``period`` ending at the newest ``ts``.

    ``period``: 1h, 6h, 1d, 1m, 6m, 1y, ytd (since Jan 1 of the newest year) or
    all. The newest timestamp is a scalar subquery (one partial max per task).
    """
    if period == "all":
        return df
    newest = df.agg(F.max(F.col(ts))).scalar()
    return df.filter(F.col(ts) >= range_start(newest, period, df.schema[ts].dataType))


def range_start(newest: Column, period: str, kind: DataType) -> Column:
    """Where the trailing ``period`` begins that ends at ``newest``, a timestamp of type ``kind``."""
    if period == "ytd":
        if isinstance(kind, TimestampNTZType):
            # zone-less column: Jan 1 of the newest year, built from its fields (no zone conversion)
            return F.make_timestamp_ntz(F.year(newest), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        return F.date_trunc("year", newest).cast(kind)
    if period in RANGE_INTERVALS:
        return newest - F.expr(RANGE_INTERVALS[period])
    raise ValueError(f"unknown period {period!r}")
