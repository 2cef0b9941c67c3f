"""Filters over events and tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import latest


@dataclass
class EventFilter:
    """All conditions that are set must hold; a null never matches. ``app`` is compared exactly, without wildcards."""

    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    event_type: str | None = None
    category: str | None = None
    project: str | None = None
    source: str | None = None
    app: str | None = None
    compacted: bool | None = None

    def is_empty(self) -> bool:
        return all(v is None for v in vars(self).values())

    def condition(self) -> Column:
        out = F.lit(True)
        for name in ("event_type", "category", "project", "source", "compacted"):
            if (v := getattr(self, name)) is not None:
                out &= F.col(name) == F.lit(v)
        if self.date is not None:
            out &= F.col("date") == F.to_date(F.lit(self.date))
        if self.date_from is not None:
            out &= F.col("date") >= F.to_date(F.lit(self.date_from))
        if self.date_to is not None:
            out &= F.col("date") <= F.to_date(F.lit(self.date_to))
        if self.app is not None:
            out &= F.col("metadata")["app_name"] == F.lit(self.app)
        return out


def matching(events: DataFrame, f: EventFilter) -> DataFrame:
    return events if f.is_empty() else events.filter(f.condition())


def since(events: DataFrame, start: Column, limit: int | None = None, app: str | None = None) -> DataFrame:
    """Events from ``start`` on, newest first; at most ``limit``, counted after the app filter."""
    out = events.filter(F.col("timestamp") >= start)
    if app is not None:
        out = out.filter(F.col("metadata")["app_name"] == app)
    out = out.orderBy(F.desc("timestamp"), "id")
    return out if limit is None else out.limit(limit)


def of_date(events: DataFrame, date: str, uncompacted: bool = False) -> DataFrame:
    out = events.filter(F.col("date") == F.to_date(F.lit(date)))
    return (out.filter(~F.coalesce("compacted", F.lit(False))) if uncompacted else out).orderBy("timestamp", "id")


def newest(events: DataFrame, limit: int, category: str | None = None, uncompacted: bool = False) -> DataFrame:
    out = events if category is None else events.filter(F.col("category") == category)
    out = out.filter(~F.coalesce("compacted", F.lit(False))) if uncompacted else out
    return out.orderBy(F.desc("timestamp"), "id").limit(limit)


def by_ids(events: DataFrame, ids: list[str]) -> DataFrame:
    """The events of these ids in the order asked for (column ``pos``), missing ones left out."""
    asked = events.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return events.join(F.broadcast(asked), "id")  # as many rows as the caller named


def tasks_between(tasks: DataFrame, first: str, last: str) -> DataFrame:
    """Tasks that begin within these days, both included; newest first."""
    day = F.to_date("start_time")
    return tasks.filter((day >= F.to_date(F.lit(first))) & (day <= F.to_date(F.lit(last)))).orderBy(F.desc("start_time"), "id")


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status") == "active").orderBy(F.desc("start_time"), "id")


def tasks_by_prefix(tasks: DataFrame, prefix: str, among: int = 200) -> DataFrame:
    """Of the latest tasks those whose id begins so."""
    return tasks.orderBy(F.desc("start_time"), "id").limit(among).filter(F.col("id").startswith(prefix))


def mentioning(tasks: DataFrame, text: str) -> DataFrame:
    """Tasks with the text in title or description, in any case."""
    return tasks.filter(F.coalesce(F.lower("title").contains(text.lower()), F.lit(False)) | F.coalesce(F.lower("description").contains(text.lower()), F.lit(False)))


def long_enough(events: DataFrame, window_seconds: int = 30, screen_seconds: int = 4) -> DataFrame:
    """Window and screen rows with ``duration_seconds`` of at least so much; other rows stay."""
    d, k = F.col("duration_seconds"), F.col("event_type")
    return events.filter(F.when(k == "window", d >= window_seconds).when(k == "screen", d >= screen_seconds).otherwise(True))


def live_entities(entities: DataFrame, now: Column, days: int = 30, mentions: int = 3) -> DataFrame:
    """Entities without those last seen more than ``days`` ago with fewer than ``mentions``."""
    return entities.filter(~((F.col("last_seen") < now - F.make_interval(days=F.lit(days))) & (F.col("mention_count") < mentions)))


def confident(analyses: DataFrame, least: float = 0.3) -> DataFrame:
    return analyses.filter(F.col("confidence_score") >= least)


def collectable(visits: DataFrame) -> DataFrame:
    """Browser rows but for banking domains and private windows."""
    from ..functions.expr import is_banking, is_private

    return visits.filter(~is_banking("domain") & ~is_private("title"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, the latest of each key."""
    return latest(old.unionByName(new), keys, version)


def updated(events: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """Events with the columns that ``changes`` (id, ...) gives; where it has none or null, as before."""
    c = changes.select(F.col("id").alias("_id"), *(F.col(x).alias(f"_{x}") for x in columns))
    out = events.join(c, events["id"] == c["_id"], "left")
    return out.select(*(F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in events.columns))
