"""Hourly trends on a stream of exports (Structured Streaming).

The same operators as the batch reports, fed by ``readStream``: exports
dropped into a folder are picked up incrementally. Event-time windows with a
watermark bound the state: a one-hour window is final (and emitted in append
mode) once the watermark passes its end, after which its state is dropped.
Late rows beyond the watermark are ignored, as Structured Streaming defines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loadlens.functions.timebuckets import hour_bucket
from loadlens.session import checkpoint_dir

DEFAULT_WATERMARK = "1 hour"


def read_export_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                       file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Incremental scan of a folder of exports with a declared schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def hourly_mean_stream(stream: DataFrame, ts: str, value: str, watermark: str = DEFAULT_WATERMARK,
                       alias: str | None = None) -> DataFrame:
    """Mean of ``value`` per one-hour tumbling event-time window (the streaming hourly trend)."""
    out = alias or value
    s = stream.filter(F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp"))
    return (s.withWatermark("__ts", watermark)
             .groupBy(F.window("__ts", "1 hour").alias("w"))
             .agg(F.avg(F.col(value)).alias(out), F.count(F.lit(1)).alias("n_rows"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), out, "n_rows"))


def bucket_metrics_stream(stream: DataFrame, ts: str, metrics: Sequence[tuple[str, str, str]],
                          watermark: str = DEFAULT_WATERMARK, label_col: str = "TIME_RANGE") -> DataFrame:
    """Hour-bucket metrics per day, per bucket label (running totals of the bucket trend).

    Keyed by (day window, bucket label) so the state of a finished day can be dropped.
    """
    s = (stream.filter(F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp"))
         .withColumn(label_col, hour_bucket(ts)))
    aggs = []
    for alias, fn, col in metrics:
        c = F.col(col)
        aggs.append({"sum": F.sum(c), "avg": F.avg(c), "count": F.count(F.lit(1)),
                     "min": F.min(c), "max": F.max(c)}[fn].alias(alias))
    return (s.withWatermark("__ts", watermark)
             .groupBy(F.window("__ts", "1 day").alias("d"), label_col).agg(*aggs)
             .select(F.col("d.start").cast("timestamp_ntz").alias("day"), label_col, *[m[0] for m in metrics]))


def start(df: DataFrame, name: str, output_mode: str = "append", sink: str = "parquet",
          path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a streaming query with its checkpoint under the shared checkpoint folder.

    The ``memory`` sink keeps the whole result on the driver: for tests and small previews only.
    """
    spark = df.sparkSession
    w = (df.writeStream.queryName(name).outputMode(output_mode)
         .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"))
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    if path is None:
        raise ValueError("a file sink needs a path")
    return w.format(sink).start(path)
