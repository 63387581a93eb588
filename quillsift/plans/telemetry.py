"""Summaries of operation events, and the events of the engine itself."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.sources.storage import cut

EVENT = "operation string, timestamp double, duration double, outcome string, error string, phases map<string,double>, fields map<string,string>"


def event_counts(events: DataFrame, operation: str = "operation") -> DataFrame:
    return events.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("n"))


def half_up(x: Column) -> Column:
    """Two decimals, halves upwards."""
    return F.floor(x * 100 + 0.5) / 100


def mean_durations(events: DataFrame, operation: str = "operation", duration: str = "duration") -> DataFrame:
    return events.groupBy(F.col(operation).alias("operation")).agg(half_up(F.avg(duration)).alias("mean_duration"))


def error_rate(events: DataFrame, failed: Column) -> DataFrame:
    """Per cent with two decimals; 0 without events."""
    share = F.count_if(failed) / F.nullif(F.count("*"), F.lit(0))
    return events.agg(F.coalesce(F.floor(share * 10000 + 0.5) / 100, F.lit(0.0)).alias("error_rate"))


#: Up to so many different pairs of operation and duration, an operation's are ranked in one task.
RANKED_TOGETHER = 1_000_000


def percentiles(events: DataFrame, points: tuple[float, ...] = (0.5, 0.95, 0.99), operation: str = "operation", duration: str = "duration", slices: int = 64, together: int = RANKED_TOGETHER) -> DataFrame:
    """min, max, mean, count and the values at floor(n * p) in order, from 0, for each operation. Events without a duration are left out.

    Equal durations are counted first (a partial aggregation), so that ranks are taken over different ones. Where about `together` or fewer are
    left, which a first pass over the two columns estimates, one window ranks them. Beyond that, approximate quantiles cut each operation into
    slices; a value's rank is its place in its slice plus the rows of the slices before, so that a hot operation is ranked by as many tasks
    as it has slices. The quantiles are written once (a reliable checkpoint): worked out again they can differ, and a slice's rows wouldn't be
    those that its size counted. Ranks are exact either way.
    """
    events = events.where(F.col(duration).isNotNull()).select(F.col(operation).alias("operation"), F.col(duration).alias("d"))
    counted = events.groupBy("operation", "d").agg(F.count("*").alias("times"))
    names = [f"p{round(p * 100)}" for p in points]
    if events.agg(F.approx_count_distinct(F.struct("operation", "d"))).first()[0] <= together:
        own = Window.partitionBy("operation")
        ranked = counted.withColumns({"n": F.sum("times").over(own), "upto": F.sum("times").over(own.orderBy("d"))})
    else:
        inner = [i / slices for i in range(1, slices)]
        cuts = cut(counted.groupBy(F.col("operation").alias("of")).agg(F.percentile_approx("d", inner, 1000).alias("cuts")))
        same = F.col("operation").eqNullSafe(F.col("of"))
        sliced = counted.join(cuts, same).select("operation", "d", "times", F.size(F.filter("cuts", lambda x: x < F.col("d"))).alias("slice"))
        sizes = sliced.groupBy(F.col("operation").alias("of"), F.col("slice").alias("place")).agg(F.sum("times").alias("rows"))
        own = Window.partitionBy("of")  # at most `slices` rows each
        earlier = F.sum("rows").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        before = sizes.select("of", "place", F.sum("rows").over(own).alias("n"), F.coalesce(earlier, F.lit(0)).alias("before"))
        within = F.sum("times").over(Window.partitionBy("operation", "slice").orderBy("d"))
        placed = sliced.withColumn("within", within).join(before, same & (F.col("slice") == F.col("place")))
        ranked = placed.withColumn("upto", F.col("within") + F.col("before"))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("d"))).alias(name) for p, name in zip(points, names, strict=True)]
    return ranked.groupBy("operation").agg(F.sum("times").alias("count"), F.min("d").alias("min"), F.max("d").alias("max"), (F.sum(F.col("d") * F.col("times")) / F.sum("times")).alias("mean"), *at)


def phase_averages(events: DataFrame) -> DataFrame:
    return events.select("operation", F.explode("phases").alias("phase", "ms")).groupBy("operation", "phase").agg(half_up(F.avg("ms")).alias("mean_ms"))


def outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("operation").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "error", "cancelled")))


class _Event:
    def __init__(self, collector: Collector, operation: str, fields: dict[str, Any]):
        self.collector, self.began = collector, time.time()
        self.row = {"operation": operation, "timestamp": self.began, "fields": {k: str(v) for k, v in fields.items()}, "phases": {}, "outcome": None, "error": None, "duration": None}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.row["phases"][name] = self.row["phases"].get(name, 0.0) + (time.perf_counter() - began) * 1000

    def add(self, **fields: Any) -> _Event:
        self.row["fields"] |= {k: str(v) for k, v in fields.items()}
        return self

    def _close(self, outcome: str, error: str | None = None) -> None:
        if self.row["outcome"] is None:
            self.row |= {"outcome": outcome, "error": error, "duration": (time.time() - self.began) * 1000}
            self.collector._push(self.row)

    def success(self) -> None:
        self._close("success")

    def error(self, error: Exception | str) -> None:
        self._close("error", str(error))

    def cancel(self) -> None:
        self._close("cancelled")


class Collector:
    """The last events, oldest first; listeners hear each one."""

    def __init__(self, limit: int = 1000, enabled: bool = True):
        self.events: deque[dict] = deque(maxlen=limit)
        self.enabled = enabled
        self.listeners: list[Callable[[dict], None]] = []

    def start_event(self, operation: str, **fields: Any) -> _Event:
        return _Event(self, operation, fields)

    def _push(self, row: dict) -> None:
        if self.enabled:
            self.events.append(row)
            for listen in list(self.listeners):
                listen(row)

    def on_event(self, listen: Callable[[dict], None]) -> Callable[[], None]:
        self.listeners.append(listen)
        return lambda: self.listeners.remove(listen)

    def by_operation(self, operation: str) -> list[dict]:
        return [e for e in self.events if e["operation"] == operation]

    def since(self, timestamp: float) -> list[dict]:
        return [e for e in self.events if e["timestamp"] >= timestamp]

    def clear(self) -> None:
        self.events.clear()

    def to_json(self) -> str:
        return json.dumps(list(self.events))

    def frame(self, spark: SparkSession) -> DataFrame:
        names = ("operation", "timestamp", "duration", "outcome", "error", "phases", "fields")
        return spark.createDataFrame([tuple(e[n] for n in names) for e in self.events], EVENT)
