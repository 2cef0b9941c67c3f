"""What users call: the tools and reports, as functions that return DataFrames. ``now`` is always given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import filters, fulltext, rollup, sequence, temporal_graph, vector
from ..operators.filters import EventFilter
from ..operators.tasks import hide_members


def working_memory(events: DataFrame, now: Column, minutes: int = 15, threshold: float = 0.97, limit: int = 500) -> DataFrame:
    """Lines of the last minutes' events, near-duplicate runs as one. Only the newest ``limit`` are looked at, as asked for."""
    e = filters.since(events, now - F.make_interval(mins=F.lit(minutes)), limit).withColumn("_k", F.lit(1))
    return sequence.near_duplicate_runs(e, ["_k"], threshold).drop("_k").withColumn("line", X.line()).orderBy("pos")


def recent_activity(events: DataFrame, now: Column, hours: int = 3, app: str | None = None, threshold: float = 0.97, limit: int = 1000) -> DataFrame:
    """Lines of the last hours' events, of one app if named."""
    e = filters.since(events, now - F.make_interval(hours=F.lit(hours)), limit, app).withColumn("_k", F.lit(1))
    return sequence.near_duplicate_runs(e, ["_k"], threshold).drop("_k").withColumn("line", X.line()).orderBy("pos")


def search_activity(events: DataFrame, query: str, query_vector: list[float] | None, now: Column, limit: int = 10, pool: int = 40, where: EventFilter | None = None, floor: float = 0.0, weight: float = 0.02, days: float = 30.0, scorer: Callable | None = None) -> DataFrame:
    """Events by meaning and keywords: both arms' ranks fused, recency added, and the pool re-ranked if a scorer is given."""
    e = filters.matching(events, where or EventFilter())
    pool = max(pool, limit)
    text = fulltext.bm25(e.withColumn("text", X.fts_text()), query, pool)
    vec = vector.nearest(e, query_vector, pool, floor).select("id", "score") if query_vector else e.select("id", F.lit(0.0).alias("score")).limit(0)
    out = vector.hybrid(vec, text, e, now, pool if scorer else limit, pool, weight, days)
    out = vector.rerank(out, scorer, limit, X.rerank_text()) if scorer else out
    return out.withColumn("text", X.detail())


def activity_context(events: DataFrame, keys: list[str], app: str | None = None, at: Column | None = None, direction: str = "both", count: int = 3) -> DataFrame:
    """What came before and after an event of its session."""
    e = temporal_graph.with_sessions(events, keys)
    return temporal_graph.context(e, keys, temporal_graph.anchor(e, app, at), direction, count).withColumn("line", X.line()).orderBy("step")


def session_report(events: DataFrame, keys: list[str], app: str | None = None, at: Column | None = None) -> DataFrame:
    """All events of the anchor's session in order, with the session's span and apps."""
    e = temporal_graph.with_sessions(events, keys)
    a = temporal_graph.anchor(e, app, at).select("session_id")
    s = e.join(F.broadcast(a), "session_id", "left_semi")
    span = s.groupBy("session_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.array_sort(F.collect_set(F.col("metadata")["app_name"])).alias("apps"))
    return s.join(F.broadcast(span), "session_id").orderBy("timestamp", "id")


def connected(events: DataFrame, keys: list[str], file: str | None = None, project: str | None = None, url: str | None = None, app: str | None = None) -> DataFrame:
    """Events that touch a file, else a project, an address or an app: the first that is named."""
    for kind, target in (("file", file), ("project", project), ("url", url), ("app", app)):
        if target is not None:
            e = temporal_graph.with_sessions(events, keys)
            return temporal_graph.touching(temporal_graph.edges(e, keys), events, kind, target)
    raise ValueError("name a file, project, url or app")


def timeline(events: DataFrame, stored_hours: DataFrame, date: str) -> DataFrame:
    """The hours of a day."""
    day = F.to_date(F.lit(date))
    return rollup.timeline(events.filter(F.to_date("timestamp") == day), stored_hours.filter(F.col("date") == day)).orderBy("hour")


def task_search(tasks: DataFrame, query_vector: list[float] | None, keyword: str | None, limit: int = 10) -> DataFrame:
    """Tasks by vector, and by keyword if one is given: with both, the keyword filters."""
    t = tasks if keyword is None else filters.mentioning(tasks, keyword)
    if query_vector is None:
        return t.orderBy(F.desc("start_time"), "id").limit(limit)
    return vector.nearest(t, query_vector, limit)


def contextual_search(events: DataFrame, tasks: DataFrame, query_vector: list[float], mode: str = "both", limit: int = 10) -> DataFrame:
    """(kind, id, score, title): tasks, activities, or both, in which case half are tasks and activities that belong to one of
    them are left out."""
    t = task_search(tasks, query_vector, None, limit // 2 if mode == "both" else limit)
    shown = t.select(F.lit("task").alias("kind"), "id", "score", "title")
    if mode == "tasks":
        return shown
    e = hide_members(events, t) if mode == "both" else events
    found = vector.nearest(e, query_vector, limit - limit // 2 if mode == "both" else limit).select(F.lit("activity").alias("kind"), "id", "score", X.line().alias("title"))
    return found if mode == "activities" else shown.unionByName(found)


def rag_context(members: DataFrame, events: DataFrame, k: int = 5) -> DataFrame:
    """The events nearest to the mean of some members' vectors, with their summaries; the members themselves are left out."""
    m = rollup.mean_vector(members.withColumn("_k", F.lit(1)), ["_k"]).first()
    if m is None:
        return events.limit(0).withColumn("score", F.lit(0.0))
    return vector.nearest(events.join(members.select("id"), "id", "left_anti"), list(m.embedding), k)


def graph_rag(events: DataFrame, query_vector: list[float], query_entities: DataFrame, relations: DataFrame, limit: int = 10, weight: float = 0.6) -> DataFrame:
    """(kind, id, score): events by weighted reciprocal rank, and up to ``limit`` entities within two steps of the query's."""
    from pyspark.sql import Window

    from ..operators.entity_graph import neighbours

    v = vector.nearest(events, query_vector, limit)
    v = v.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select(F.lit("event").alias("kind"), "id", (F.lit(weight) / (60 + F.col("_r"))).alias("score"))
    g = neighbours(relations, query_entities, 2).orderBy("depth", "id").limit(limit).select(F.lit("entity").alias("kind"), "id", F.lit(None).cast("double").alias("score"))
    return v.unionByName(g)


def patterns(events: DataFrame, now: Column, days: int = 30) -> dict[str, DataFrame]:
    """Types, projects, hours and active days of the last days."""
    e = filters.since(events, now - F.make_interval(days=F.lit(days)))
    return {"types": rollup.type_breakdown(e), "projects": rollup.top(e, F.col("project"), "project", 10), "hours": rollup.top(e, F.hour("timestamp"), "hour", 5), "active": rollup.active_days(e)}


def observe(events: DataFrame, keys: list[str], gap: float = sequence.GAP) -> DataFrame:
    """Sessions with their span, events, dominant type and counts by type."""
    return sequence.session_table(sequence.gap_sessions(events, keys, gap), keys)


def range_search(tasks: DataFrame, text: str, first: str, last: str) -> DataFrame:
    """Tasks of these days that mention the text."""
    return filters.mentioning(filters.tasks_between(tasks, first, last), text)


def identify_tasks(events: DataFrame, now: Column, threshold: float = 0.7, least: int = 3, most: int = 30) -> DataFrame:
    """Tasks from the clusters of each project."""
    from ..operators.cluster import project_clusters
    from ..operators.tasks import build_tasks

    return build_tasks(project_clusters(events, threshold, least, most), ["project", "cluster", "block"], now)


def analyze_graph(entities: DataFrame, relations: DataFrame, now: Column, days: int = 7, most: int = 10) -> dict[str, DataFrame]:
    """Entities and relations of the last days by type, and the entities mentioned most."""
    from ..operators.entity_graph import graph_stats

    start = now - F.make_interval(days=F.lit(days))
    e = entities.filter(F.col("last_seen") >= start)
    return {"stats": graph_stats(e, relations.filter(F.col("last_seen") >= start)), "top": e.orderBy(F.desc("mention_count"), "id").limit(most)}


def reembed(events: DataFrame, embed: Callable, date: str | None = None) -> DataFrame:
    """Events, of one day if named, with new vectors of their summary, else their content."""
    from ..streaming.ingest import embedded

    e = events if date is None else events.filter(F.col("date") == F.to_date(F.lit(date)))
    return embedded(e.drop("embedding").withColumn("chunk", F.coalesce("summary", "raw_content")), embed).drop("chunk")


def shaped_tasks(tasks: DataFrame) -> DataFrame:
    """The fields of tasks that a search shows."""
    return tasks.select("id", "title", "description", "status", "category", "project", "start_time", "duration_minutes")


def shaped_events(events: DataFrame) -> DataFrame:
    """The fields of events that a search shows."""
    return events.select("id", "timestamp", "event_type", "project", "category", F.coalesce("summary", F.left("raw_content", F.lit(200))).alias("text"))
