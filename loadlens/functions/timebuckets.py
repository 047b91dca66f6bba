"""Hour-bucket labels, their fixed order, and the 19-row bucket spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the bucket convention of the exports ------------------------
NIGHT_LABEL = "00--06"      # hours 0..5 share one bucket
FIRST_DAY_HOUR = 6          # hours 6..23 get one bucket each, "HH--HH+1"
LABEL_SEP = "--"
# -------------------------------------------------------------------------------


def bucket_labels() -> list[str]:
    """The 19 labels in display order: ``00--06``, ``06--07`` ... ``22--23``, ``23--00``."""
    return [NIGHT_LABEL] + [f"{h:02d}{LABEL_SEP}{(h + 1) % 24:02d}" for h in range(FIRST_DAY_HOUR, 24)]


def hour_bucket(ts: Column | str) -> Column:
    """Label of the clock hour of ``ts``; null timestamp -> null label.

    Hour 23 is labelled ``23--00`` so that it lands on the spine (the label
    ``23--24`` would never match it).
    """
    h = F.hour(F.col(ts) if isinstance(ts, str) else ts)
    day = F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(LABEL_SEP),
                   F.lpad(((h + 1) % 24).cast("string"), 2, "0"))
    return F.when(h.isNull(), F.lit(None).cast("string")).when(h < FIRST_DAY_HOUR, F.lit(NIGHT_LABEL)).otherwise(day)


def bucket_ordinal(label: Column | str) -> Column:
    """Position of a label in the fixed order (0..18); unknown labels -> 19 (sort last)."""
    lab = F.col(label) if isinstance(label, str) else label
    labels = bucket_labels()
    arr = F.array(*[F.lit(x) for x in labels])
    pos = F.array_position(arr, lab)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(labels))).cast("int")


def bucket_spine(spark: SparkSession, label_col: str = "TIME_RANGE") -> DataFrame:
    """19-row spine (label, ord), derived from ``spark.range`` by the bucket rule."""
    hours = spark.range(FIRST_DAY_HOUR - 1, 24)  # 5 stands for the night bucket
    h = F.col("id").cast("int")
    label = F.when(h < FIRST_DAY_HOUR, F.lit(NIGHT_LABEL)).otherwise(
        F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(LABEL_SEP), F.lpad(((h + 1) % 24).cast("string"), 2, "0")))
    return hours.select(label.alias(label_col), (h - (FIRST_DAY_HOUR - 1)).alias("ord"))
