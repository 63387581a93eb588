"""Value counts and event rollups over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.plans.index import value_index


def streaming_value_index(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Running value counts of a stream; for update or complete mode."""
    return value_index(rows, columns)


def merge_index(index: DataFrame, added: DataFrame) -> DataFrame:
    """An index with another's counts added, as after new rows; one shuffle of counts."""
    return index.unionByName(added).groupBy("column_id", "value").agg(F.sum("row_count").alias("row_count"))


def event_rollup(events: DataFrame, time: str, operation: str, duration: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, means and maxima by window and operation; events later than `late` are left out of a stream."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return (
        kept.groupBy(F.window(time, window).alias("w"), F.col(operation).alias("operation"))
        .agg(F.count("*").alias("n"), F.avg(duration).alias("mean_duration"), F.max(duration).alias("max_duration"))
        .select(F.col("w.start").alias("window_start"), "operation", "n", "mean_duration", "max_duration")
    )
