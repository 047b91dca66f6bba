"""Streaming variants of the hourly trend operators."""

from loadlens.streaming.hourly import bucket_metrics_stream, hourly_mean_stream, read_export_stream, start

__all__ = ["bucket_metrics_stream", "hourly_mean_stream", "read_export_stream", "start"]
