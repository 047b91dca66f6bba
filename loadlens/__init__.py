"""loadlens: workload-statistics analytics as lazy Spark DataFrame jobs.

Sub-packages:

* ``sources``   – source catalog, declared schemas, CSV/Parquet loading, profiling.
* ``functions`` – Column -> Column cleaning and labelling expressions.
* ``operators`` – aggregates / top-k, filters, KPIs, time buckets, density,
  anomaly thresholds and the random-forest regression job.
* ``plans``     – one function per report section, returning named DataFrames.
* ``streaming`` – the hourly trend operators on a Structured Streaming source.
"""

from loadlens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
