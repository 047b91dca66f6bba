"""Table access and shared-folder helpers for the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loadlens.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in full."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder (``spark.checkpoint.dir``), for files a job writes and rereads."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and reread: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
