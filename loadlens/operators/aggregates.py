"""Grouped metrics, top-k, counts, shares and wide -> long reshaping.

Every report section is a parameter set of these helpers. Plans they produce:

* ``group_metrics``: Filter(key not null) -> HashAggregate(partial) -> Exchange
  hashpartitioning(key) -> HashAggregate(final). The partial step combines
  map-side, so a key holding a third of all rows still ships one row per task.
* ``top_k``: TakeOrderedAndProject (per-task top-k, then a k-row merge) — no
  global sort of the grouped result.

Exact mode (``decimal_scale``): for metrics with that many decimals, values
are summed as integers in units of 10^-scale (integer columns: as they are).
The 64-bit units are summed in three limbs of 21 bits, each a BIGINT sum on
Spark's fast primitive path that cannot overflow below 2^42 rows a group, and
put together once per group as a DECIMAL. Sums and means then do not depend on
partitioning or task order (double sums do), and equal a DECIMAL sum converted
to double, i.e. the same SQL on any engine, bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

LIMB_BITS = 21
LIMB_MASK = (1 << LIMB_BITS) - 1
MetricSpec = tuple[str, str, str]  # (output alias, function, input column)
_FUNCS = {"sum", "avg", "mean", "count", "min", "max"}


def exact_sum(c: str | Column, scale: int, integral: bool = False) -> Column:
    """Exact sum of a column with ``scale`` decimals, as double (see module notes).

    ``integral``: the column has an integer type, its values are the units.
    """
    col = F.col(c) if isinstance(c, str) else c
    if integral:
        units, scale = col.cast("bigint"), 0
    else:
        x = col.cast("double") * F.lit(10.0 ** scale)
        # half-up to the nearest unit with plain double arithmetic: round() on a double
        # goes through java.math.BigDecimal per value, this is ~40 % faster end to end
        units = (F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))).cast("bigint")
    low = F.sum(units.bitwiseAND(F.lit(LIMB_MASK)))
    mid = F.sum(F.shiftright(units, LIMB_BITS).bitwiseAND(F.lit(LIMB_MASK)))
    high = F.sum(F.shiftright(units, 2 * LIMB_BITS))

    def decimal(part: Column, limb: int) -> Column:
        return part.cast("decimal(19,0)") * F.lit(Decimal(1 << limb * LIMB_BITS))
    total = decimal(high, 2) + decimal(mid, 1) + decimal(low, 0)
    # the factor shifts the decimal point exactly
    return (total.cast(f"decimal({38 - scale},0)") * F.lit(Decimal(1).scaleb(-scale))).cast("double")


def metric_expr(func: str, column: str, alias: str, decimal_scale: int | None = None,
                integral: bool = False) -> Column:
    """One aggregate expression. ``count`` of ``*`` counts rows."""
    func = func.lower()
    if func not in _FUNCS:
        raise ValueError(f"unknown aggregate {func!r}")
    if func == "count":
        e = F.count(F.lit(1)) if column == "*" else F.count(F.col(column))
    elif func in ("min", "max"):
        e = getattr(F, func)(F.col(column))
    elif decimal_scale is not None:
        total = exact_sum(column, decimal_scale, integral)
        e = total if func == "sum" else total / F.count(F.col(column))
    else:
        e = F.sum(F.col(column)) if func == "sum" else F.avg(F.col(column))
    return e.alias(alias)


def group_metrics(df: DataFrame, key: str | Sequence[str], metrics: Iterable[MetricSpec],
                  decimal_scale: int | None = None) -> DataFrame:
    """Aggregate ``metrics`` per key; rows with a null key are left out."""
    keys = [key] if isinstance(key, str) else list(key)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)} if decimal_scale is not None \
        else set()
    aggs = [metric_expr(fn, col, alias, decimal_scale, col in whole) for alias, fn, col in metrics]
    return df.filter(cond).groupBy(*keys).agg(*aggs)


def top_k(df: DataFrame, order_by: str | Sequence[str], key: str | Sequence[str], k: int,
          ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) ``order_by``; ties by key ascending."""
    if k <= 0:
        raise ValueError("k must be positive")
    orders = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = [key] if isinstance(key, str) else list(key)
    sort = [(F.col(c).asc() if ascending else F.col(c).desc()) for c in orders]
    return df.orderBy(*sort, *[F.col(k_).asc() for k_ in keys]).limit(k)


def sort_by(df: DataFrame, order_by: str, key: str | Sequence[str], ascending: bool = False) -> DataFrame:
    """Full ordered output with a deterministic tie-break (range-partitioned sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    o = F.col(order_by).asc() if ascending else F.col(order_by).desc()
    return df.orderBy(o, *[F.col(k_).asc() for k_ in keys])


def sort_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Global sort of row-level output that stays balanced when many rows tie.

    A range partitioner sends equal sort keys to one partition, so a value shared
    by a third of the rows would be sorted by one task. A hidden unique id as the
    last key lets the partitioner split such a group; it only orders rows that
    tie on every requested key.
    """
    tie = "__row_tiebreak"
    return df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*order, F.col(tie)).drop(tie)


def grouped_top_k(df: DataFrame, key: str, metrics: Iterable[MetricSpec], order_by: str, k: int,
                  decimal_scale: int | None = None) -> DataFrame:
    """``group_metrics`` followed by ``top_k`` on one of its outputs."""
    return top_k(group_metrics(df, key, metrics, decimal_scale), order_by, key, k)


def count_by(df: DataFrame, key: str, alias: str = "count") -> DataFrame:
    """Row count per non-null key."""
    return group_metrics(df, key, [(alias, "count", "*")])


def share_of_small(df: DataFrame, value_col: str, alias: str = "share") -> DataFrame:
    """``value / sum(value)`` over the whole frame, for small frames only.

    The empty window moves every row to one task: use it after a top-k (<= k
    rows) or on a frame whose row count is bounded by a low-cardinality key.
    """
    total = F.sum(F.col(value_col)).over(Window.partitionBy())
    return df.withColumn(alias, F.col(value_col) / total)


def share_of_total(df: DataFrame, value_col: str, alias: str = "share") -> DataFrame:
    """``value / sum(value)`` with the total as a scalar subquery (any frame size)."""
    total = df.agg(F.sum(F.col(value_col)).cast("double")).scalar()
    return df.withColumn(alias, F.col(value_col) / total)


def to_long(df: DataFrame, ids: str | Sequence[str], values: Sequence[str],
            variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide -> long: one row per (ids, metric name, metric value)."""
    ids_l = [ids] if isinstance(ids, str) else list(ids)
    cast = df.select(*ids_l, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(ids_l, list(values), variable, value)


def keep_if_positive_total(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Evidence guard on a small result: keep it only if its metric total is > 0.

    Mirrors the "only chart when there is something to show" rule; the frame
    must be small (top-k output), since the total is an empty-window sum.
    """
    cs = [cols] if isinstance(cols, str) else list(cols)
    total = sum((F.sum(F.col(c)).over(Window.partitionBy()) for c in cs), F.lit(0.0))
    return df.withColumn("__total", total).filter(F.col("__total") > 0).drop("__total")


def require_positive_input(result: DataFrame, source: DataFrame, col: str) -> DataFrame:
    """Evidence guard on the input: empty result unless ``sum(source.col) > 0``.

    Lazy: the total is a scalar subquery (one partial aggregate per task),
    evaluated once when the result is computed; no driver round-trip.
    """
    total = source.agg(F.sum(F.col(col))).scalar()
    return result.filter(F.coalesce(total, F.lit(0.0)) > 0)
