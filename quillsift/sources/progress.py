"""How far a Spark job group is."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def share_done(spark: SparkSession, group: str) -> float:
    """Finished tasks of all tasks of the group's stages that are known so far."""
    tracker = spark.sparkContext.statusTracker()
    done = known = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in info.stageIds if (info := tracker.getJobInfo(job)) else ():
            if found := tracker.getStageInfo(stage):
                done, known = done + found.numCompletedTasks, known + found.numTasks
    return done / known if known else 0.0


@contextmanager
def job_group(spark: SparkSession, group: str, on_progress: Callable[[float], None] | None = None, every: float = 0.05) -> Iterator[None]:
    """Runs what is inside as a job group, which spark.sparkContext.cancelJobGroup stops. `on_progress` hears of shares that grow, from 0.0, and
    of 1.0 when it has ended without an error."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    ended = threading.Event()
    told = [0.0]

    def watch() -> None:
        while not ended.wait(every):
            if (now := min(share_done(spark, group), 0.99)) > told[0]:
                told[0] = now
                on_progress(now)

    watcher = threading.Thread(target=watch, daemon=True) if on_progress else None
    if watcher:
        on_progress(0.0)
        watcher.start()
    try:
        yield
    finally:
        ended.set()
        if watcher:
            watcher.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if on_progress:
        on_progress(1.0)
