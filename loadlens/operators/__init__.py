"""DataFrame -> DataFrame operators (aggregates, filters, KPIs, time series, density,
anomalies, regression)."""
