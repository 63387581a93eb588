"""Summaries of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.plans import telemetry
from quillsift.plans.queries.base import query
from quillsift.sources.tables import table
from quillsift.streaming.incremental import event_rollup as rollup


@query("SELECT event_type AS operation, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.event_counts(table(spark, folder, "events"), "event_type")


@query("SELECT event_type AS operation, floor(avg(value) * 100 + 0.5) / 100 AS mean_duration FROM events GROUP BY 1")
def mean_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.mean_durations(table(spark, folder, "events"), "event_type", "value")


_POINTS = (0.5, 0.95, 0.99)
_PERCENTILES_SQL = f"""
SELECT event_type AS operation, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
    {", ".join(f"list_sort(list(value))[floor(count(*) * {p})::BIGINT + 1] AS p{round(p * 100)}" for p in _POINTS)}
FROM events GROUP BY 1
"""


@query(_PERCENTILES_SQL)
def percentiles_floor(spark: SparkSession, folder: str) -> DataFrame:
    found = telemetry.percentiles(table(spark, folder, "events"), _POINTS, "event_type", "value")
    return found.withColumn("mean", F.round("mean", 6))


@query(_PERCENTILES_SQL)
def percentiles_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """The same by slices, as where very many durations differ."""
    found = telemetry.percentiles(table(spark, folder, "events"), _POINTS, "event_type", "value", slices=16, together=0)
    return found.withColumn("mean", F.round("mean", 6))


@query("""
SELECT coalesce(floor(count(*) FILTER (event_type = 'error') * 1.0 / nullif(count(*), 0) * 10000 + 0.5) / 100, 0) AS error_rate FROM events
""")
def error_rate(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.error_rate(table(spark, folder, "events"), F.col("event_type") == "error")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def slowest_10(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "event_type", "value")


@query("""
SELECT event_type AS operation, 'all' AS phase, floor(avg(value) * 100 + 0.5) / 100 AS mean_ms FROM events GROUP BY 1
UNION ALL SELECT event_type, 'rest', floor(avg(value - floor(value)) * 100 + 0.5) / 100 FROM events GROUP BY 1
""")
def phase_averages(spark: SparkSession, folder: str) -> DataFrame:
    phases = F.create_map(F.lit("all"), F.col("value"), F.lit("rest"), F.col("value") - F.floor("value"))
    events = table(spark, folder, "events").select(F.col("event_type").alias("operation"), phases.alias("phases"))
    return telemetry.phase_averages(events).withColumn("mean_ms", F.col("mean_ms").cast("double"))


@query("""
SELECT event_type AS operation, count(*) FILTER (value <= 50) AS success, count(*) FILTER (value > 100) AS error,
    count(*) FILTER (value > 50 AND value <= 100) AS cancelled
FROM events GROUP BY 1
""")
def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    outcome = F.when(F.col("value") > 100, "error").when(F.col("value") > 50, "cancelled").otherwise("success")
    return telemetry.outcome_counts(table(spark, folder, "events").select(F.col("event_type").alias("operation"), outcome.alias("outcome")))


@query("""
SELECT date_trunc('day', ts) AS window_start, event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean_duration, max(value) AS max_duration
FROM events GROUP BY 1, 2
""")
def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollup(table(spark, folder, "events"), "ts", "event_type", "value", "1 day").withColumn("mean_duration", F.round("mean_duration", 6))
