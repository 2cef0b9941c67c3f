"""Compaction of days: duplicates go, events are clustered, clusters become tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import project_clusters
from ..operators.sequence import content_dedup
from ..operators.tasks import build_tasks
from ..operators.vector import greedy_dedup


@dataclass
class Compaction:
    """What compaction makes of some days: tasks, the events with their flag, and counts by date."""

    tasks: DataFrame
    events: DataFrame
    report: DataFrame


def compact(events: DataFrame, now: Column, done: DataFrame | None = None, force: bool = False, threshold: float = 0.7, duplicate: float = 0.95, least: int = 3) -> Compaction:
    """Compact every date before today's that isn't ``done`` (date) yet; ``force`` does those again. All dates run as one plan,
    grouped by date, where single days would each wait for the one before. Writing the result is up to the caller."""
    e = events.withColumn("date", F.to_date("timestamp")).filter(F.col("date") < F.to_date(now))
    e = e if force else e.filter(~F.coalesce("compacted", F.lit(False)))
    e = e if force or done is None else e.join(done.select("date"), "date", "left_anti")
    unique = greedy_dedup(content_dedup(e, ["date"]).select(*e.columns), ["date"], duplicate)
    clusters = project_clusters(unique, threshold, least, keys=("date", "project"))
    tasks = build_tasks(clusters, ["date", "project", "cluster", "block"], now)
    report = e.groupBy("date").agg(F.count("*").alias("event_count")).join(unique.groupBy("date").agg(F.count("*").alias("kept_count")), "date", "left")
    report = report.join(tasks.groupBy("date").agg(F.count("*").alias("task_count")), "date", "left").fillna(0)
    dates = e.select("date").distinct()
    flagged = events.withColumn("_d", F.to_date("timestamp")).join(dates.select(F.col("date").alias("_d"), F.lit(True).alias("_c")), "_d", "left")
    flagged = flagged.withColumn("compacted", F.coalesce("_c", F.lit(False)) | F.coalesce("compacted", F.lit(False))).select(*events.columns)
    return Compaction(tasks, flagged, report)


def last_days(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Events of the ``days`` days before today: what the daily sweep compacts."""
    d = F.to_date("timestamp")
    return events.filter((d < F.to_date(now)) & (d >= F.date_sub(F.to_date(now), days)))
