"""The temporal activity graph: nodes, edges, and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import domain_of, slug
from ..schema import latest
from .sequence import GAP, gap_sessions

# Labels of event nodes.
LABELS = {"window": "WindowEvent", "screen": "ScreenEvent", "browser": "BrowserEvent", "terminal": "TerminalCommand", "git_commit": "GitCommit", "git_stash": "GitCommit", "git_staged": "GitCommit", "note": "ScreenEvent"}


def with_sessions(events: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` with session_id, by the incremental rule: more than 600 whole seconds since the event before."""
    e = gap_sessions(events, keys, whole_seconds=True)
    return e.withColumn("session_id", F.concat_ws(":", F.lit("session"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.col("session").cast("string")))


def event_nodes(events: DataFrame) -> DataFrame:
    """A node for each event: its metadata, time and project as properties."""
    label = F.coalesce(F.create_map(*(F.lit(x) for p in LABELS.items() for x in p))[F.col("event_type")], F.lit("WindowEvent"))
    own = F.create_map(F.lit("timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("ts_ms"), F.unix_millis("timestamp").cast("string"), F.lit("type"), F.col("event_type"), F.lit("project"), F.coalesce("project", F.lit("")))
    meta = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("timestamp", "ts_ms", "type", "project") & v.isNotNull())
    return events.select("id", label.alias("label"), F.map_concat(meta, own).alias("props"), F.col("timestamp").alias("ts"))


def continued(events: DataFrame, tails: DataFrame, key: str, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """``events`` of one batch with ``session_id`` and ``previous`` (the event before in the session), and the tails (key,
    session, session_id, last_second, last_id) of the sources seen, as they are after the batch.

    ``tails`` are those that the batches before have left: one row for each value of ``key``, and all that is read of them.
    Within a batch events are in order of time. A session begins where more than ``gap`` whole seconds lie between an event and the
    latest one before it, in this batch or any other; so an event that comes late joins the session that is open.
    Batches in order of time give the sessions and chains that ``with_sessions`` gives for all rows at once."""
    t = tails.select(F.col("key").alias("_key"), F.col("session").alias("_session"), F.col("session_id").alias("_open"), F.col("last_second").alias("_second"), F.col("last_id").alias("_last"))
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    e = events.withColumn("_own", own).join(t, F.col("_own") == F.col("_key"), "left")
    w = Window.partitionBy("_own").orderBy("timestamp", "id")
    second = F.unix_timestamp("timestamp")
    before = F.greatest(F.max(second).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_second"))
    e = e.withColumn("_new", F.coalesce(second - before > gap, F.lit(True)))
    e = e.withColumn("_n", F.coalesce("_session", F.lit(0)) + F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("session_id", F.concat_ws(":", F.lit("session"), "_own", F.col("_n").cast("string")))
    e = e.withColumn("previous", F.when(~F.col("_new"), F.coalesce(F.lag("id").over(w), F.col("_last"))))
    last = F.max_by(F.struct("_n", "session_id", "id"), F.struct("timestamp", "id"))
    after = e.groupBy("_own").agg(last.alias("r"), F.greatest(F.max(second), F.max("_second")).alias("last_second"))
    after = after.select(F.col("_own").alias("key"), F.col("r._n").alias("session"), "r.session_id", "last_second", F.col("r.id").alias("last_id"))
    return e.drop("_own", "_key", "_session", "_open", "_second", "_last", "_new", "_n"), after


def edges(events: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (src_id, dst_id, type) of ``events`` with sessions: DURING, ON_APP, IN_WINDOW, IN_PROJECT, VISITED, MODIFIED
    (a commit's first ten files) and FOLLOWED_BY, which leads from each event to the next of its session, or to each from its
    ``previous`` where events have that column.

    One pass makes all edges of an event; only the chain needs its session's order."""
    m, raw = F.col("metadata"), F.col("raw_content")
    files = F.slice(F.coalesce("files_changed", F.from_json(F.get_json_object(raw, "$.files_changed"), "array<string>"), F.array().cast("array<string>")), 1, 10)
    url = F.coalesce(m["url"], F.get_json_object(raw, "$.url"))
    edge = lambda kind, dst, when=F.lit(True): F.when(when & dst.isNotNull(), F.struct(F.lit(kind).alias("type"), dst.alias("dst_id")))
    app, title = m["app_name"], m["window_title"]
    made = F.array(
        edge("DURING", F.col("session_id")),
        edge("ON_APP", F.concat(F.lit("app:"), slug(app)), app != ""),
        edge("IN_WINDOW", F.concat(F.lit("window:"), F.sha2(F.concat_ws("|", app, title), 256)), title != ""),
        edge("IN_PROJECT", F.concat(F.lit("project:"), slug("project")), F.col("project") != ""),
        edge("VISITED", F.concat(F.lit("url:"), F.sha2(url, 256)), (F.col("event_type") == "browser") & (url != "")),
    )
    changed = F.when(F.col("event_type") == "git_commit", F.transform(files, lambda f: F.struct(F.lit("MODIFIED").alias("type"), F.concat(F.lit("file:"), f).alias("dst_id")))).otherwise(F.array().cast("array<struct<type:string,dst_id:string>>"))
    out = events.select(F.col("id").alias("src_id"), F.explode(F.concat(F.filter(made, lambda x: x.isNotNull()), changed)).alias("e")).select("src_id", "e.dst_id", "e.type")
    if "previous" in events.columns:
        chain = events.select(F.col("previous").alias("src_id"), F.col("id").alias("dst_id"))
    else:
        w = Window.partitionBy(*keys, "session_id").orderBy("timestamp", "id")
        chain = events.select(F.col("id").alias("src_id"), F.lead("id").over(w).alias("dst_id"))
    chain = chain.filter("src_id is not null and dst_id is not null").withColumn("type", F.lit("FOLLOWED_BY"))
    return out.unionByName(chain).distinct()


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id, the newest properties replacing older ones."""
    return latest(old.unionByName(new), ["id"], "ts")


def anchor(events: DataFrame, app: str | None = None, at: Column | None = None) -> DataFrame:
    """One event: of the app (in any case) if named, nearest to ``at`` in whole seconds if given, else the latest."""
    e = events if app is None else events.filter(F.lower(F.col("metadata")["app_name"]) == app.lower())
    if at is None:
        return e.orderBy(F.desc("timestamp"), "id").limit(1)
    away = F.abs(F.floor(F.unix_millis("timestamp") / 1000) - F.floor(F.unix_millis(at) / 1000))
    return e.orderBy(away, "timestamp", "id").limit(1)


def session_apps(edge_table: DataFrame) -> DataFrame:
    """(session_id, apps): the distinct apps of each session's events, sorted. Two edges of one event meet on its id."""
    during = edge_table.filter("type = 'DURING'").select("src_id", F.col("dst_id").alias("session_id"))
    on = edge_table.filter("type = 'ON_APP'").select("src_id", F.col("dst_id").alias("app"))
    return during.join(on, "src_id").select("session_id", "app").distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("app")).alias("apps"))


def touching(edge_table: DataFrame, events: DataFrame, kind: str, target: str) -> DataFrame:
    """Events with an edge of any type to one node: kind is file, project, url or app."""
    node = {"file": f"file:{target}", "project": "project:" + target.lower().replace(" ", "_"), "app": "app:" + target.lower().replace(" ", "_")}
    dst = F.concat(F.lit("url:"), F.sha2(F.lit(target), 256)) if kind == "url" else F.lit(node[kind])
    hit = edge_table.filter(F.col("dst_id") == dst).select(F.col("src_id").alias("id")).distinct()
    return events.join(hit, "id", "left_semi").orderBy("timestamp", "id")


def context(events: DataFrame, keys: list[str], the_anchor: DataFrame, direction: str = "both", count: int = 3) -> DataFrame:
    """The anchor and up to ``count`` events before and after it in its session, in order, with ``step``.

    ``events`` have session_id; the anchor is one row, so only its session is read on."""
    a = the_anchor.select("session_id", F.col("id").alias("_anchor"))
    s = events.join(F.broadcast(a), "session_id")
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    s = s.withColumn("_rn", F.row_number().over(w))
    s = s.withColumn("step", F.col("_rn") - F.min(F.when(F.col("id") == F.col("_anchor"), F.col("_rn"))).over(Window.partitionBy("session_id")))
    lo = -count if direction in ("before", "both") else 0
    hi = count if direction in ("after", "both") else 0
    return s.filter(F.col("step").between(lo, hi)).drop("_rn", "_anchor")


def nodes_of_pages(events: DataFrame) -> DataFrame:
    """Nodes of visited addresses with their domains."""
    url = F.coalesce(F.col("metadata")["url"], F.get_json_object("raw_content", "$.url"))
    p = events.select(url.alias("url"), "timestamp").filter("url <> ''").groupBy("url").agg(F.min("timestamp").alias("ts"))
    return p.select(F.concat(F.lit("url:"), F.sha2("url", 256)).alias("id"), F.lit("Url").alias("label"), F.create_map(F.lit("url"), F.col("url"), F.lit("domain"), domain_of("url")).alias("props"), "ts")
