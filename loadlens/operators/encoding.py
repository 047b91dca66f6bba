"""Slots of text categories as a distributed dictionary: no label reaches the driver.

One-hot encoding gives every category of a text column its slot: the most frequent first, equal counts by text. The
dictionary is a table (feature, value, n, slot): counts by a partial + final aggregate, dealt by range in slot order, and
numbered in two levels — a row's place in its range, plus a prefix sum over the ranges' sizes (one row per range and
feature). It is written to the shared folder once, so the ranges that were numbered are the ranges that are read.

Columns meet their slots by a join on the label: broadcast where the measured bytes of the dictionary are within
``BROADCAST_BYTES``, otherwise a shuffle join whose hot labels adaptive execution splits. Only the number of categories of
each feature and the dictionary's size come to the driver. ``SlotEncoder`` is the join as a pipeline stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadlens.session import checkpoint_dir

BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as written to the shared folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def label_slots(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n, slot (from 0 within each feature) of the non-null values of text columns."""
    counts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]) \
        .unpivot([], list(columns), "feature", "value").filter(F.col("value").isNotNull()) \
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = (F.col("feature"), F.col("n").desc(), F.col("value"))
    dealt = written(counts.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
                     "labels")
    spans = dealt.groupBy("feature", "part").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("feature", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    # one row per range and feature; the numbered dictionary is written, since every pass of a fit reads it
    return written(dealt.join(F.broadcast(offsets), ["feature", "part"])
                    .select("feature", "value", "n", (F.col("offset") + F.col("place") - F.col("first")).alias("slot")),
                    "slots")


def category_counts(slots: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many categories each column has: one row per column."""
    found = {r["feature"]: r["n"] for r in slots.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def dictionary_bytes(slots: DataFrame) -> int:
    """What a copy of the dictionary takes in memory."""
    return slots.agg(F.sum(F.octet_length("value") + ROW_BYTES)).first()[0] or 0


def with_slots(df: DataFrame, slots: DataFrame, sizes: Mapping[str, int], suffix: str = "__idx",
               small: bool = False) -> DataFrame:
    """Add a column ``<c><suffix>`` per text column: its slot as double. Null and unknown values have the slot behind the
    last, which a one-hot encoder with ``dropLast`` turns into all zeros. The columns say how many slots there are.
    ``small``: the dictionary is within BROADCAST_BYTES; rows then stay where they are."""
    order = df.columns
    for c, size in sizes.items():
        own = slots.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("slot").alias(f"{c}__slot"))
        index = F.coalesce(F.col(f"`{c}__slot`"), F.lit(size)).cast("double")
        nominal = {"ml_attr": {"type": "nominal", "name": f"{c}{suffix}", "num_vals": size + 1}}
        order = [*order, f"{c}{suffix}"]
        df = df.join(F.broadcast(own) if small else own, c, "left") \
            .withColumn(f"{c}{suffix}", index.alias(f"{c}{suffix}", metadata=nominal)) \
            .select(*[F.col(f"`{x}`") for x in order])
    return df


class SlotEncoder(Transformer):
    """``with_slots`` as a stage. A join may move rows: ``deal`` puts them back where the forest expects them."""

    def __init__(self, slots: DataFrame, sizes: Mapping[str, int], deal=None):
        super().__init__()
        self.slots, self.sizes = slots, dict(sizes)
        self.small = dictionary_bytes(slots) <= BROADCAST_BYTES
        self.deal = deal

    def _transform(self, df: DataFrame) -> DataFrame:
        out = with_slots(df, self.slots, self.sizes, small=self.small)
        return out if self.small or self.deal is None else self.deal(out)


def slot_names(slots: DataFrame, sizes: Mapping[str, int], before: int) -> DataFrame:
    """position, feature: the names ``column=category`` of one-hot slots that stand behind ``before`` other ones."""
    at, start = before, []
    for c, size in sizes.items():
        start += [F.lit(c), F.lit(at)]
        at += size
    if not start:
        return slots.select(F.col("slot").alias("position"), F.col("value").alias("feature")).limit(0)
    return slots.select((F.create_map(*start)[F.col("feature")] + F.col("slot")).cast("long").alias("position"),
                        F.concat_ws("=", "feature", "value").alias("feature"))
