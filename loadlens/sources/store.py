"""Cleaned sources kept by batch and day, with a zone map: trailing ranges and anomalies read only the files they need.

``ingest`` writes one export (a batch) as Parquet folders ``rows/batch=<name>/day=<date>/`` and beside them a zone map, one
row per file: rows, oldest and newest timestamp, and for each metric its count, mean, squared deviations and maximum.
Taking a batch in again replaces it, so a repeated export changes nothing. Rows are dealt by range of day and a hash, so a
day that holds most rows is split over files.

Queries look at the zone map first (one row per file, never the rows). A trailing range lists and reads the day folders
that reach into it. The threshold ``mean + m * std`` is merged from the files' moments, and only files whose maximum is
above it are read.

Edge cases: rows without a timestamp stand in a folder of their own; they count in no range and in no threshold. A metric
that cannot be read counts as 0, as in the other anomaly operators. An empty store has no rows and no threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.cleaning import to_double
from loadlens.operators.aggregates import sort_rows
from loadlens.operators.anomaly import M_DEFAULT, validate_multiplier
from loadlens.operators.filters import range_start

DAY = "__day"


@dataclass
class Store:
    """A folder of ingested batches; ``ts`` is the timestamp column, ``metrics`` have zones."""

    spark: SparkSession
    path: str
    ts: str
    metrics: Sequence[str] = ()

    @property
    def rows_path(self) -> str:
        return f"{self.path.rstrip('/')}/rows"

    @property
    def zones_path(self) -> str:
        return f"{self.path.rstrip('/')}/zones"

    def ingest(self, df: DataFrame, batch: str) -> None:
        """Write or replace a batch, then the zones of its files."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        typed = df.withColumns({m: to_double(m, kinds[m]) for m in self.metrics}) if self.metrics else df
        folder = f"{self.rows_path}/batch={batch}"
        salt = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        typed.withColumn(DAY, F.to_date(self.ts)).repartitionByRange(DAY, salt).sortWithinPartitions(DAY) \
            .write.mode("overwrite").partitionBy(DAY).parquet(folder)
        written = self.spark.read.schema(typed.schema).option("basePath", folder).parquet(folder)
        timed = F.col(self.ts).isNotNull()
        moments = []
        for i, m in enumerate(self.metrics):
            v = F.when(timed, F.col(f"`{m}`"))
            moments += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.max(v).alias(f"max{i}"),
                        (F.var_pop(v) * F.count(v)).alias(f"dev{i}")]
        written.groupBy(F.col("_metadata.file_path").alias("file")) \
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(self.ts).alias("oldest"), F.max(self.ts).alias("newest"), *moments) \
            .write.mode("overwrite").parquet(f"{self.zones_path}/batch={batch}")

    def zones(self) -> DataFrame:
        """The zone map of all batches."""
        return self.spark.read.parquet(self.zones_path)

    def rows(self, files: Sequence[str] | None = None) -> DataFrame:
        """The ingested rows; with ``files``, those of these files or folders alone."""
        schema = self.spark.read.parquet(self.rows_path).drop(DAY, "batch").schema
        if files is not None and not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(files or [self.rows_path]))

    def trailing_range(self, period: str) -> DataFrame:
        """As ``filters.trailing_range``, from the folders that reach into the range. Their names come to the driver: as many
        as the range has days, times batches."""
        if period == "all":
            return self.rows()
        zones = self.zones()
        bounds = zones.agg(F.max("newest").alias("newest")).select(
            range_start(F.col("newest"), period, zones.schema["newest"].dataType).alias("start"))
        folder = F.regexp_replace("file", "/[^/]*$", "")
        found = zones.filter(F.col("newest") >= bounds.scalar())
        files = [r[0] for r in found.select(folder.alias("folder")).distinct().orderBy("folder").collect()]
        return self.rows(files).filter(F.col(self.ts) >= bounds.scalar())

    def threshold(self, metric: str, m: float = M_DEFAULT) -> DataFrame:
        """One row (threshold): mean + m * sample std over all files, merged from their moments; null without evidence."""
        i, m = list(self.metrics).index(metric), validate_multiplier(m)
        n, mean, dev = F.col(f"n{i}"), F.col(f"mean{i}"), F.col(f"dev{i}")
        known = self.zones().filter(n > 0)
        whole = known.agg((F.sum(n * mean) / F.sum(n)).alias("mean")).scalar()
        merged = known.select(n.alias("n"), mean.alias("mean"), dev.alias("dev"), whole.alias("whole")).agg(
            F.sum("n").alias("n"), F.max("whole").alias("mean"),
            F.sum(F.col("dev") + F.col("n") * (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole"))).alias("dev"))
        std: Column = F.sqrt(F.col("dev") / (F.col("n") - 1))
        return merged.select(F.when((F.col("mean") > 0) & (F.col("n") > 1), F.col("mean") + F.lit(m) * std).alias("threshold"))

    def files_above(self, metric: str, m: float = M_DEFAULT) -> tuple[float | None, list[str]]:
        """The threshold, and the files that hold a row above it."""
        limit = self.threshold(metric, m).first()["threshold"]
        if limit is None:
            return None, []
        top = F.col(f"max{list(self.metrics).index(metric)}")
        return limit, [r[0] for r in self.zones().filter(top > limit).select("file").orderBy("file").collect()]

    def anomalies(self, metric: str, m: float = M_DEFAULT, columns: Sequence[str] | None = None) -> DataFrame:
        """As ``anomaly.anomalies``: rows above the threshold, largest first, from the files that hold one."""
        limit, files = self.files_above(metric, m)
        rows = self.rows(files)
        out = list(columns) if columns else rows.columns
        hits = rows.filter(F.col(self.ts).isNotNull() & (F.col(f"`{metric}`") > F.lit(limit))).select(*out)
        return sort_rows(hits, F.col(metric).desc(), *[F.col(c).asc() for c in out if c != metric])
