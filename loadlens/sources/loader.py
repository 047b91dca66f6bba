"""Reading exports and turning them into typed, cleaned DataFrames.

``load_source`` is lazy: scan -> rename -> one cleaning projection -> null
filter. Catalyst collapses the projections, prunes unread columns and pushes
filters on raw columns into the Parquet scan.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, StringType, StructField, StructType, TimestampNTZType,
                               TimestampType)

from loadlens.functions.cleaning import (clean_column_names, clean_string, compact_date, compact_datetime,
                                         eu_number, mm_ss_seconds, parse_datetime_column, to_double)
from loadlens.sources.csv_ranges import fits_one_range, read_quoted_csv
from loadlens.sources.specs import CATALOG, SourceSpec

log = logging.getLogger(__name__)

SUPPORTED_FORMATS = ("csv", "parquet")

# fixed values: the cell texts that the original reader takes for a missing value
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class UnsupportedFormat(ValueError):
    """A file that is neither CSV nor Parquet."""


def detect_format(path: str) -> str:
    """``.csv`` (also ``.csv.gz`` / ``.csv.bz2``) -> csv; ``.parquet`` or a folder without an
    extension (a dataset of part files) -> parquet; anything else is unsupported."""
    p = path.lower().rstrip("/")
    name = p.rsplit("/", 1)[-1]
    if name.endswith((".csv", ".csv.gz", ".csv.bz2")):
        return "csv"
    if name.endswith(".parquet") or "." not in name:
        return "parquet"
    raise UnsupportedFormat(f"unsupported file format: {path}")


def read_raw(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV: header row, every column read as text (no inference), missing-value texts as null; Parquet: as stored.

    Quoted CSV fields may hold doubled quotes, separators and line breaks; such files are read in parallel by byte
    ranges (``csv_ranges``). Files of one range in all, and with ``multi_line=False`` files known to have no line break
    in quotes, are read by Spark's reader as they are: one scan, no pass over the quotes before it, the same rows.
    """
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        if multi_line and not fits_one_range(spark, path):
            raw = read_quoted_csv(spark, path)
        else:
            raw = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line).csv(path)
        return raw.select(*[missing_to_null(F.col(f"`{c.replace('`', '``')}`")).alias(c) for c in raw.columns])
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise UnsupportedFormat(f"unsupported file format: {fmt}")


def missing_to_null(c: Column) -> Column:
    """A text cell, null if it is one of the missing-value texts."""
    return F.when(~c.isin(*MISSING_TEXTS), c)


def declared_schema(spec: SourceSpec) -> StructType:
    """Schema of a cleaned source when every declared column is present."""
    fields = [StructField(c, DoubleType()) for c in spec.numeric]
    fields += [StructField(c, StringType()) for c in spec.text if c not in spec.numeric]
    if spec.duration:
        fields.append(StructField(spec.duration[1], DoubleType()))
    if spec.date_time:
        fields.append(StructField(spec.datetime_col, TimestampNTZType()))
    if spec.compact_date:
        fields.append(StructField(spec.compact_date[1], DateType()))
    return StructType(fields)


def empty_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    return spark.createDataFrame([], declared_schema(spec))


def clean_frame(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Apply a SourceSpec to an already-renamed frame (one projection + one filter)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = set(df.columns)
    exprs: dict[str, Column] = {c: F.col(c) for c in df.columns}

    to_num = eu_number if spec.number_style == "eu" else to_double
    for c in spec.numeric:
        if c in present:
            exprs[c] = to_num(c, types[c]).alias(c)
    for c in spec.default_zero:
        if c not in present:
            exprs[c] = F.lit(0.0).alias(c)
    if spec.duration and spec.duration[0] in present:
        src, dst = spec.duration
        exprs[dst] = mm_ss_seconds(src, types[src]).alias(dst)

    dt = spec.datetime_col
    if spec.date_time and all(c in present for c in spec.date_time):
        exprs[dt] = compact_datetime(*spec.date_time).alias(dt)
    elif dt in present and not isinstance(types[dt], (TimestampType, TimestampNTZType)):
        exprs[dt] = parse_datetime_column(df, dt).alias(dt)

    if spec.compact_date:
        src, dst = spec.compact_date
        if src in present:
            exprs[src] = F.nullif(F.col(src).cast("string"), F.lit("00000000")).alias(src)
            exprs[dst] = compact_date(src).alias(dst)
        else:
            exprs[dst] = F.lit(None).cast("date").alias(dst)

    typed = df.select(*exprs.values())

    # Null drop on the critical columns. Cleaned texts are never null, so a
    # text column only drops rows when the spec cleans it after the drop.
    cond = None
    for c in spec.required:
        if c not in typed.columns:
            continue
        if c in spec.text and not spec.clean_after_drop:
            continue
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    if cond is not None:
        typed = typed.filter(cond)

    texts = {c: d for c, d in spec.text.items() if c in present and c not in spec.numeric}
    if not texts:
        return typed
    return typed.select(*[(clean_string(c, texts[c]).alias(c) if c in texts else F.col(c)) for c in typed.columns])


def load_source(spark: SparkSession, spec: SourceSpec | str, path: str, fmt: str | None = None,
                multi_line: bool = True) -> DataFrame:
    """Read one export and clean it; a missing file or an unsupported format gives an empty table.

    Only those two errors are caught, while the scan is resolved; colliding headers and errors raised later by actions
    surface normally.
    """
    spec = CATALOG[spec] if isinstance(spec, str) else spec
    try:
        raw = read_raw(spark, path, fmt, multi_line)
    except (AnalysisException, UnsupportedFormat) as e:
        log.error("source %s could not be loaded from %s: %s", spec.name, path, e)
        return empty_source(spark, spec)
    # two headers that clean to one name raise: neither column may be lost silently
    return clean_frame(raw.toDF(*clean_column_names(raw.columns)), spec)


def load_all(spark: SparkSession, paths: Mapping[str, str], multi_line: bool = True) -> dict[str, DataFrame]:
    """Load every catalogued source named in ``paths`` (source key -> file path)."""
    return {key: load_source(spark, CATALOG[key], path, multi_line=multi_line) for key, path in paths.items()}


def all_empty(frames: Mapping[str, DataFrame]) -> bool:
    """True when no source has a single row (one short job per source)."""
    return all(df.isEmpty() for df in frames.values())


def preview(df: DataFrame, n: int = 5, drop: Sequence[str] = (), order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows, optionally without some columns; ordered when ``order_by`` is given."""
    out = df.drop(*[c for c in drop if c in df.columns])
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, position, Spark type, non-null count, total row count.

    A single aggregate pass; the result is unpivoted to long form.
    """
    cols = df.columns
    if not cols:
        raise ValueError("frame has no columns")
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    long = counts.unpivot(["__rows"], [f"c{i}" for i in range(len(cols))], "__slot", "non_null")
    meta = F.create_map(*[x for i, f in enumerate(df.schema.fields)
                          for x in (F.lit(f"c{i}"), F.struct(F.lit(f.name).alias("name"), F.lit(i).alias("pos"),
                                                             F.lit(f.dataType.simpleString()).alias("dtype")))])
    m = meta[F.col("__slot")]
    return long.select(m["name"].alias("column"), m["pos"].alias("position"), m["dtype"].alias("dtype"),
                       F.col("non_null"), F.col("__rows").alias("rows")).orderBy("position")
