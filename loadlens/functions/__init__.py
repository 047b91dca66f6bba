"""Column -> Column expressions (cleaning, labels, time buckets)."""

from loadlens.functions.cleaning import (
    as_text, bytes_to_mib, clean_column_name, clean_column_names, clean_string, compact_date,
    compact_datetime, eu_number, mm_ss_seconds, ms_to_seconds, parse_datetime_text, short_label,
    thousands_label, to_double, unicode_strip,
)
from loadlens.functions.timebuckets import bucket_labels, bucket_ordinal, bucket_spine, hour_bucket

__all__ = [
    "as_text", "bytes_to_mib", "clean_column_name", "clean_column_names", "clean_string", "compact_date",
    "compact_datetime", "eu_number", "mm_ss_seconds", "ms_to_seconds", "parse_datetime_text", "short_label",
    "thousands_label", "to_double", "unicode_strip", "bucket_labels", "bucket_ordinal", "bucket_spine",
    "hour_bucket",
]
