"""Gaussian kernel density curve of one numeric column.

Curve: ``grid`` points ``x_i = min + i * (max - min) / grid`` (i = 0..grid-1),
bandwidth ``h = sample std * n^(-1/5)`` (Scott's rule) unless given, and

    density(x_i) = sum_v w_v * exp(-((x_i - v) / h)^2 / 2) / (n * h * sqrt(2 pi))

Plan: values pre-aggregated to (value, weight) with a partial + final hash
aggregate (a hot value costs one row per task) — the only pass over the raw
column; (n, min, max, std) are scalar subqueries over that weighted table,
reusing its shuffle output; every (value, weight) row is expanded by a
generator over the grid points its kernel reaches (with more data the bandwidth
and so the reach shrinks) *inside* the same codegen stage and folded into a
partial aggregate on the grid index, so each task ships at most ``grid`` rows
to the final merge. The only join is with the ``grid`` points themselves.

``bins``: optional pre-binning of values into equal-width bins (approximate:
each value moves at most half a bin width, i.e. (max-min)/(2*bins)); the
(bin, weight) table is bounded by ``bins`` rows per task, which caps the
kernel work at ``bins * grid`` per task whatever the data size.

``kde_by_convolution`` is the form for large data: values are laid on a fine grid by linear binning (a value
gives each of its two neighbours the share 1 - distance), which is a mergeable aggregate of bounded size, and
the grid's weights are convolved with the kernel once. No value is shuffled. The fine step d is at most h / 16,
and linear binning errs by at most d^2 / 8 times the kernel's largest second derivative, so

    |density - exact density| <= (d / h)^2 / (8 h sqrt(2 pi)) <= 4.9e-4 / (h sqrt(2 pi))   at every point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_GRID = 500
#: exp(-z^2 / 2) is 0 in double arithmetic beyond this z.
KERNEL_REACH = 38.7
#: Fine cells in a step of the curve's grid, at least; and in a bandwidth, at least.
CELLS_PER_STEP = 16
CELLS_PER_BANDWIDTH = 16


def _weighted_stats(weighted: DataFrame):
    """Scalar subquery (n, lo, hi, sd) from the (value, weight) table.

    The sample standard deviation is computed in two centred steps (mean, then
    the weighted sum of squared deviations), which is as accurate as a
    one-pass estimator on the raw values. Reading the weighted table instead
    of the raw column lets the statistics reuse the same shuffle output as
    the density itself: the raw column is read once.
    """
    first = weighted.agg(F.struct(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                  (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean")).alias("s")).scalar()
    dev = weighted.select("v", "w", first.alias("s"))
    m2 = F.sum(F.col("w") * (F.col("v") - F.col("s.mean")) * (F.col("v") - F.col("s.mean")))
    return dev.agg(F.struct(F.first("s.n").alias("n"), F.first("s.lo").alias("lo"), F.first("s.hi").alias("hi"),
                            F.sqrt(m2 / (F.first("s.n") - 1)).alias("sd")).alias("st")).scalar()


def kde(df: DataFrame, column: str, grid: int = DEFAULT_GRID, bandwidth: float | None = None,
        bins: int | None = None) -> DataFrame:
    """Density curve as rows (i, x, density); empty unless max > min."""
    if grid < 2:
        raise ValueError("grid must be >= 2")
    v = F.col(column).cast("double")
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if bins:
        # statistics from the raw column (one partial aggregate per task), then
        # equal-width bins between min and max: a value maps to its bin centre and
        # the partial aggregate holds at most ``bins`` rows per task
        st = vals.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                               F.stddev_samp("v").alias("sd")).alias("st")).scalar()
        width = (F.col("st.hi") - F.col("st.lo")) / F.lit(float(bins))
        idx = F.least(F.floor((F.col("v") - F.col("st.lo")) / width), F.lit(bins - 1))
        centres = vals.select("v", st.alias("st")).select((F.col("st.lo") + (idx + 0.5) * width).alias("v"))
        weighted = centres.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    else:
        # exact (value, weight) table: the only pass over the raw column; the
        # statistics are computed from it and reuse its shuffle output
        weighted = vals.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
        st = _weighted_stats(weighted)

    h = (F.lit(float(bandwidth)) if bandwidth else
         F.col("st.sd") * F.pow(F.col("st.n").cast("double"), F.lit(-0.2)))
    shape = [F.col("st.lo").alias("lo"), F.col("st.hi").alias("hi"), F.col("st.n").alias("n"), h.alias("h")]

    # The kernel work of a row is large for its bytes, so the rows are dealt evenly to a fixed number of partitions
    # that the adaptive planner does not merge by size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _curve(weighted.repartition(parts), st, shape, grid)


def _curve(weighted: DataFrame, st: Column, shape: list[Column], grid: int) -> DataFrame:
    """The curve of (v, w) rows; ``st`` is a scalar subquery with n, lo, hi, ``shape`` names lo, hi, n and h."""
    def grid_x(i: Column) -> Column:
        return F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.lit(float(grid))

    ctx = weighted.select("v", "w", st.alias("st")).filter(F.col("st.hi") > F.col("st.lo")) \
        .select("v", "w", *shape)
    # grid points at which the kernel of v is not exactly 0 in double arithmetic
    step = (F.col("hi") - F.col("lo")) / F.lit(float(grid))
    reach = F.lit(KERNEL_REACH) * F.col("h")
    first = F.greatest(F.lit(0.0), F.floor((F.col("v") - reach - F.col("lo")) / step))
    last = F.least(F.lit(grid - 1.0), F.ceil((F.col("v") + reach - F.col("lo")) / step))
    expanded = ctx.select("v", "w", "lo", "hi", "n", "h",
                          F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i"))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi))
    z = (grid_x(F.col("i")) - F.col("v")) / F.col("h")
    contrib = F.col("w") * F.exp(F.lit(-0.5) * z * z) / norm
    dens = expanded.select("i", contrib.alias("c")).groupBy("i").agg(F.sum("c").alias("density"))
    # every grid point appears, also where no kernel reaches; at most ``grid`` rows on either side
    points = weighted.sparkSession.range(grid).select(F.col("id").cast("int").alias("i"), st.alias("st")) \
        .filter(F.col("st.hi") > F.col("st.lo")).select("i", *shape)
    return points.join(F.broadcast(dens), "i", "left") \
        .select("i", grid_x(F.col("i")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density")).orderBy("i")


def kde_by_convolution(df: DataFrame, column: str, grid: int = DEFAULT_GRID, bandwidth: float | None = None) -> DataFrame:
    """Density curve as rows (i, x, density) by linear binning and one convolution (error bound: see the module).

    Two scans of the column with partial aggregates: count, extremes and deviation; then per fine cell the number of
    values and the sum of their distances from its lower edge. Null and NaN are no values; empty unless max > min.
    """
    if grid < 2:
        raise ValueError("grid must be >= 2")
    v = F.col(column).cast("double")
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    st = vals.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                           F.stddev_samp("v").alias("sd")).alias("st")).scalar()
    h = F.lit(float(bandwidth)) if bandwidth else F.col("st.sd") * F.pow(F.col("st.n").cast("double"), F.lit(-0.2))
    step = (F.col("st.hi") - F.col("st.lo")) / F.lit(float(grid))
    cells = F.greatest(F.lit(float(CELLS_PER_STEP)), F.ceil(F.lit(float(CELLS_PER_BANDWIDTH)) * step / h).cast("double"))
    width = step / cells
    laid = vals.select("v", st.alias("st")).filter(F.col("st.hi") > F.col("st.lo")) \
        .select(((F.col("v") - F.col("st.lo")) / width).alias("at"), (cells * grid).alias("most"))
    cell = F.least(F.floor("at"), F.col("most") - 1).cast("long")
    lower = laid.select(cell.alias("cell"), (F.col("at") - cell).alias("over")) \
        .groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.sum("over").alias("over"))
    shares = F.array(F.struct(F.col("cell"), (F.col("k") - F.col("over")).alias("w")),
                     F.struct((F.col("cell") + 1).alias("cell"), F.col("over").alias("w")))
    nodes = lower.select(F.inline(shares)).groupBy("cell").agg(F.sum("w").alias("w"))
    weighted = nodes.select("cell", "w", st.alias("st")).select((F.col("st.lo") + F.col("cell") * width).alias("v"), "w")
    shape = [F.col("st.lo").alias("lo"), F.col("st.hi").alias("hi"), F.col("st.n").alias("n"), h.alias("h")]
    return _curve(weighted, st, shape, grid)
