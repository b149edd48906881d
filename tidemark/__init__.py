"""Table and model-quality monitoring expressed as Spark DataFrame jobs."""

from tidemark.spec import GenericTable, InferenceLog, Metric, MonitorSpec, TimeSeries

__all__ = ["GenericTable", "InferenceLog", "Metric", "MonitorSpec", "TimeSeries"]
