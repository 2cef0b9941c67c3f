"""Every operator over the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adapter import EV, NOW, TASKS, documents, events, read, tasks
from .functions import expr as X
from .operators import asof, cluster, entity_graph, filters, fulltext, rollup, sequence, temporal_graph, vector
from .operators import tasks as task_ops
from .operators.filters import EventFilter
from .plans import api, compaction, prompts, sql
from .sources import history, logs, sinks
from .sources.textindex import TextIndex

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"

def now() -> F.Column:
    return F.to_timestamp(F.lit(NOW))


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query, and its SQL with the common table expressions that it reads."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            word = "with recursive " if any(c.startswith("recursive ") for c in ctes) else "with "
            ORACLE_SQL[name] = (word + ", ".join(c.removeprefix("recursive ") for c in ctes) + " " if ctes else "") + sql
        return f

    return put


def ts(c: str = "timestamp") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sts(c: str = "timestamp") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def joined(c, sep: str = ",") -> F.Column:
    return F.array_join(c, sep)


# ---- sources ----


@query("s1_events", f"select id, {sts()} as ts, strftime(date, '%Y-%m-%d') as date, event_type, source, project, category, summary, raw_content, app, title from ev", EV)
def s1(spark, d):
    return events(spark, d).select("id", ts().alias("ts"), F.date_format("date", "yyyy-MM-dd").alias("date"), "event_type", "source", "project", "category", "summary", "raw_content", "app", "title")


URLS = "urls as (select url, case when page_id % 5 = 0 then null else 'Page ' || page_id end as title, (1704067200 + page_id * 60 + 11644473600) * 1000000 as last_visit_time, page_id % 9 + 1 as visit_count from pages)"
CHROME = "chrome as (select make_timestamp(last_visit_time - 11644473600000000) as timestamp, coalesce(title, 'Untitled') as title, url, split_part(case when contains(url, '//') then split_part(url, '//', 2) else url end, '/', 1) as domain, visit_count, 'chrome' as browser from urls)"
SAFARI = "safari as (select date_trunc('second', e.ts) as timestamp, 'Untitled' as title, 'https://site' || (c_custkey % 50) || '.example.com/x' as url, 'site' || (c_custkey % 50) || '.example.com' as domain, c_custkey % 7 as visit_count, 'safari' as browser from events e join customer on c_custkey = user_id where event_type = 'click')"


def _chrome(spark, d):
    u = read(spark, d, "pages").select("url", F.expr("case when page_id % 5 = 0 then null else 'Page ' || page_id end").alias("title"), F.expr("(1704067200 + page_id * 60 + 11644473600) * 1000000").alias("last_visit_time"), F.expr("page_id % 9 + 1").alias("visit_count"))
    return history.chromium(u, F.to_timestamp(F.lit("2024-01-01 01:00:00")), "chrome", None)


def _safari(spark, d):
    e = read(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("history_item"), (F.unix_timestamp(F.col("ts").cast("timestamp")) - 978307200).alias("visit_time"), F.lit(None).cast("string").alias("title"))
    i = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("'https://site' || (c_custkey % 50) || '.example.com/x'").alias("url"), F.expr("c_custkey % 7").alias("visit_count"))
    return history.safari(e, i, F.to_timestamp(F.lit("2024-01-01 00:00:00")), None)


_bank = "not regexp_matches(lower(domain), 'bank|chase|wellsfargo|citibank|bofa|capitalone|discover|paypal|venmo|cashapp|zelle|schwab|fidelity|vanguard|robinhood|etrade|tdameritrade|coinbase|binance|kraken')"
HISTORY = f"history as (select * from chrome where timestamp > timestamp '2024-01-01 01:00:00' and {_bank} union all select * from safari)"


@query("s2_epoch_shift", f"select {sts()} as ts, title, url, domain, visit_count from history where browser = 'chrome'", URLS, CHROME, SAFARI, HISTORY)
def s2(spark, d):
    return _chrome(spark, d).select(ts().alias("ts"), "title", "url", "domain", "visit_count")


@query("s3_history_join", f"select {sts()} as ts, title, url, domain, visit_count from history where browser = 'safari'", URLS, CHROME, SAFARI, HISTORY)
def s3(spark, d):
    return _safari(spark, d).select(ts().alias("ts"), "title", "url", "domain", "visit_count")


@query("u1_union_sources", f"select browser, count(*) as n, {sts('max(timestamp)')} as newest from history group by browser", URLS, CHROME, SAFARI, HISTORY)
def u1(spark, d):
    return history.union([_chrome(spark, d), _safari(spark, d)]).groupBy("browser").agg(F.count("*").alias("n"), ts(F.max("timestamp")).alias("newest"))


@query("s15_retention", f"select id, event_type from (select *, row_number() over (partition by event_type order by timestamp desc, id) as n from ev) where n <= 100", EV)
def s15(spark, d):
    return logs.retained(events(spark, d), ["event_type"], 100, "id").select("id", "event_type")


@query("s18_upsert_latest", f"select user_id, max(event_id) as event_id, arg_max(event_type, (ts, event_id)) as event_type, {sts('max(ts)')} as ts from events group by user_id")
def s18(spark, d):
    from .schema import latest

    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return latest(e.select("user_id", "ts", "event_type", F.col("event_id").alias("v")), ["user_id"], "ts", "v").join(newest, "user_id").select("user_id", "event_id", "event_type", ts("ts").alias("ts"))


@query("s19_point_updates", "select id, case when id % 4 = 0 then 'new ' || id else summary end as summary, case when id % 4 = 0 and id % 8 = 0 then 'Writing' else category end as category from (select cast(id as bigint) as id, summary, category from ev)", EV)
def s19(spark, d):
    e = events(spark, d)
    c = e.filter(F.col("id").cast("long") % 4 == 0).select("id", F.concat(F.lit("new "), "id").alias("summary"), F.when(F.col("id").cast("long") % 8 == 0, "Writing").alias("category"))
    return filters.updated(e, c, "summary", "category").select(F.col("id").cast("long").alias("id"), "summary", "category")


def _folder(spark) -> str:
    """A new folder in that which the cluster shares."""
    import tempfile
    import uuid

    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{path or tempfile.gettempdir()}/store-{uuid.uuid4().hex}"


def _store(spark) -> sinks.Store:
    """A store of its own, which goes when the application ends."""
    return sinks.Store(spark, _folder(spark)).passing()


_INDEXES: dict[tuple, TextIndex] = {}


def _index(spark, d) -> TextIndex:
    """The kept index of the documents of ``d``: made by the application's first search, in two deltas, and then only read. Files
    that are new or changed make a new one."""
    t = read(spark, d, "documents")
    jvm, conf, known = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(t.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        known.append((f, s.getLen(), s.getModificationTime()))
    key = (spark.sparkContext.applicationId, *known)
    if key not in _INDEXES:
        index = TextIndex(spark, _folder(spark)).passing()
        docs = documents(spark, d)
        half = F.col("id").cast("long") % 2 == 0
        index.add(docs.filter(half), writer="documents", batch=0)
        index.add(docs.filter(~F.coalesce(half, F.lit(False))), writer="documents", batch=1)
        _INDEXES[key] = index
    return _INDEXES[key]


@query("s17_pending_queue", "select id, compacted from (select id, id % 3 = 0 as compacted from (select cast(id as bigint) as id from ev where event_type = 'terminal'))", EV)
def s17(spark, d):
    """Rows wait, and those of a later write are done: each id's newest row counts."""
    s = _store(spark)
    e = events(spark, d).filter("event_type = 'terminal'").drop("compacted")
    s.append("pending", e.withColumn("compacted", F.lit(False)), s.version("cycle", 9))
    s.append("pending", e.filter("cast(id as bigint) % 3 = 0").withColumn("compacted", F.lit(True)), s.version("renewed", 0))
    return s.read("pending").select(F.col("id").cast("long").alias("id"), "compacted")


@query("s18_store_upsert", "select cast(id as bigint) as id, case when k % 2 = 0 then 'third' when k % 3 = 0 then 'second' else summary end as summary from ev", EV)
def s18_store(spark, d):
    """Three writers, of which the newest write of a row counts, whatever their batches' numbers."""
    s = _store(spark)
    e = events(spark, d)
    k = read(spark, d, "events").select(F.expr("'' || event_id").alias("_id"), F.get_json_object("props", "$.k").cast("long").alias("_k"))
    e = e.join(k, F.col("id") == F.col("_id")).drop("_id")
    s.append("events", e, s.version("cycle", 41))
    s.append("events", e.filter("_k % 3 = 0 or _k % 2 = 0").withColumn("summary", F.lit("second")), s.version())
    s.append("events", e.filter("_k % 2 = 0").withColumn("summary", F.lit("third")), s.version("renewed", 0))
    return s.read("events").select(F.col("id").cast("long").alias("id"), "summary")


@query("s20_delete_day", "select event_type, count(*) as n from ev where date <> date '2024-01-05' group by event_type", EV)
def s20(spark, d):
    s = _store(spark)
    s.append("events", events(spark, d), s.version())
    s.delete_day("2024-01-05")
    return s.read("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s20_replace_days", "select cast(id as bigint) as id, case when date = date '2024-01-05' then 'again' else summary end as summary from ev where date <> date '2024-01-05' or event_type = 'browser'", EV)
def s20_replace(spark, d):
    """A day is replaced by what is read from it, and its versions are folded."""
    s = _store(spark)
    s.append("events", events(spark, d), s.version())
    s.replace_days(s.read("events", ["2024-01-05"]).filter("event_type = 'browser'").withColumn("summary", F.lit("again")))
    s.fold("events", ["2024-01-05"])
    return s.read("events").select(F.col("id").cast("long").alias("id"), "summary")


@query("s23_summarized_hours", "select hour(ts) as hour, count(distinct cast(ts as date)) as days, count(*)::bigint as events from events where event_type = 'purchase' group by 1")
def s23(spark, d):
    """Summaries of hours are stored, and read back as the hours that have one."""
    s = _store(spark)
    e = rollup.hours(events(spark, d).filter("event_type = 'git_commit'"))
    s.append("hours", rollup.hour_aggregate(e).withColumn("title", F.array_join("apps", ", ")), s.version())
    done = s.read("hours")
    return done.groupBy(F.col("hour").cast("long").alias("hour")).agg(F.count("*").alias("days"), F.sum("event_count").alias("events"))


@query("s24_exclusions", "select id from ev where event_type <> 'browser' or 'd' || (k % 13) || '.example.org' not in ('d1.example.org', 'd2.example.org')", EV)
def s24(spark, d):
    from .sources.sinks import not_excluded

    e = events(spark, d).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("domain"), F.coalesce(F.get_json_object("raw_content", "$.domain"), F.lit("")))))
    return not_excluded(e, spark.createDataFrame([("D1.example.org",), ("d2.example.org",)], "domain string")).select("id")


# ---- filters ----


@query("p1_event_filter", "select id from ev where event_type = 'browser' and app = 'app1' and project = 'p3' and date between date '2024-01-05' and date '2024-01-20'", EV)
def p1(spark, d):
    f = EventFilter(date_from="2024-01-05", date_to="2024-01-20", event_type="browser", project="p3", app="app1")
    return filters.matching(events(spark, d), f).select("id")


_DOMAIN = "case c_custkey % 6 when 0 then 'www.Chase.com' when 1 then 'my' || c_custkey || '.org' when 2 then 'BANK' || c_custkey || '.de' when 3 then 'pay.paypal.com' when 4 then 'news.example.com' end"


@query("p2_domain_blocklist", f"select c_custkey as id, {_DOMAIN} as domain, coalesce(regexp_matches(lower({_DOMAIN}), 'bank|chase|paypal'), false) as banking from customer")
def p2(spark, d):
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_DOMAIN).alias("domain"))
    return t.withColumn("banking", X.is_banking("domain"))


_TITLE = "case c_custkey % 4 when 0 then 'New Incognito Tab' when 1 then 'Docs (Private)' when 2 then 'Mail' end"


@query("p3_private_title", f"select c_custkey as id, coalesce(regexp_matches(lower({_TITLE}), 'incognito|private'), false) as private from customer")
def p3(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.is_private(F.expr(_TITLE)).alias("private"))


_APP = "case c_custkey % 5 when 0 then 'Finder' when 1 then 'Dock' when 2 then '' when 3 then 'Editor' end"


@query("p4_skipped_apps", f"select c_custkey as id, coalesce({_APP}, '') in ('Finder', 'Dock', '') as skipped from customer")
def p4(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.is_skipped_app(F.expr(_APP)).alias("skipped"))


@query("p5_similarity_floor", "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) as score from embeddings where list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) >= 0.2")
def p5(spark, d):
    return vector.similar(_vectors(spark, d), _vector(spark, d, 7), 0.2).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


@query("p6_recent_topn", f"select id, {sts()} as ts from ev where timestamp >= timestamp '2024-01-29 00:00:00' order by timestamp desc, id limit 50", EV)
def p6(spark, d):
    return filters.since(events(spark, d), F.to_timestamp(F.lit("2024-01-29 00:00:00")), 50).select("id", ts().alias("ts"))


@query("p7_since_app", f"select id, {sts()} as ts from ev where timestamp >= timestamp '2024-01-25 00:00:00' and app = 'app2' order by timestamp desc, id limit 50", EV)
def p7(spark, d):
    return filters.since(events(spark, d), F.to_timestamp(F.lit("2024-01-25 00:00:00")), 50, "app2").select("id", ts().alias("ts"))


@query("p8_by_date", "select id, row_number() over (order by timestamp, id) as n from ev where date = date '2024-01-10'", EV)
def p8(spark, d):
    e = filters.of_date(events(spark, d), "2024-01-10", uncompacted=True)
    return e.select("id", F.row_number().over(Window.orderBy("timestamp", "id")).cast("long").alias("n"))


@query("p9_ids_in_order", "select i.pos - 1 as pos, id from ev join (select unnest(['30', 'none', '2', '17']) as want, generate_subscripts(['30', 'none', '2', '17'], 1) as pos) i on id = want", EV)
def p9(spark, d):
    return filters.by_ids(events(spark, d), ["30", "none", "2", "17"]).select(F.col("pos").cast("long").alias("pos"), "id")


@query("p10_task_ranges", f"select id, title, status, {sts('start_time')} as start from tasks where cast(start_time as date) between date '1995-03-01' and date '1995-03-31'", TASKS)
def p10(spark, d):
    return filters.tasks_between(tasks(spark, d), "1995-03-01", "1995-03-31").select("id", "title", "status", ts("start_time").alias("start"))


@query("p10_active_tasks", "select project, count(*) as n from tasks where status = 'active' group by project", TASKS)
def p10b(spark, d):
    return filters.active_tasks(tasks(spark, d)).groupBy("project").agg(F.count("*").alias("n"))


@query("p10_task_prefix", "select id from (select * from tasks order by start_time desc, id limit 200) where id like '1%'", TASKS)
def p10c(spark, d):
    return filters.tasks_by_prefix(tasks(spark, d), "1").select("id")


@query("p11_substring", "select id, title from tasks where lower(title) like '%order 12%' or lower(description) like '%urgent%'", TASKS)
def p11(spark, d):
    t = tasks(spark, d)
    return filters.mentioning(t, "Order 12").unionByName(filters.mentioning(t, "URGENT")).select("id", "title").distinct()


@query("p13_stale_entities", "select 'app' || (k % 5) || '-' || user_id as id, count(*) as n from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1 having not (max(ts) < timestamp '2024-01-31 00:00:00' - interval 10 day and count(*) < 8)")
def p13(spark, d):
    e = events(spark, d)
    t = e.groupBy(F.concat("app", F.lit("-"), F.col("user_id").cast("string")).alias("id")).agg(F.count("*").alias("mention_count"), F.max("timestamp").alias("last_seen"))
    return filters.live_entities(t, now(), 10, 8).select("id", F.col("mention_count").alias("n"))


@query("p14_confident", "select id from (select id, (k % 10) / 10.0 as confidence_score from ev) where confidence_score >= 0.3", EV)
def p14(spark, d):
    k = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), (F.get_json_object("props", "$.k").cast("long") % 10 / 10.0).alias("confidence_score"))
    return filters.confident(k).select("id")


# ---- projections ----

_SUFFIX = "case when coalesce(project, '') <> '' then ' [' || project || ']' else '' end"
_EMBED = f"case event_type when 'browser' then json_extract_string(raw_content, '$.title') || ' | ' || json_extract_string(raw_content, '$.domain') when 'terminal' then json_extract_string(raw_content, '$.command') when 'git_commit' then json_extract_string(raw_content, '$.message') || ' | files: ' || array_to_string(json_extract_string(raw_content, '$.files_changed[*]'), ', ') || ' | ' else raw_content end"


@query("f1_embedding_text", f"select id, trim({_EMBED}) || {_SUFFIX} as text from ev", EV)
def f1(spark, d):
    return events(spark, d).select("id", X.embedding_text().alias("text"))


_LINE = "case event_type when 'browser' then json_extract_string(raw_content, '$.title') || ' | ' || json_extract_string(raw_content, '$.domain') when 'terminal' then json_extract_string(raw_content, '$.command') when 'git_commit' then json_extract_string(raw_content, '$.message') || ' | ' || array_to_string(json_extract_string(raw_content, '$.files_changed[*]'), ', ') when 'window' then coalesce(gist, app || ' — ' || title) else raw_content end"
_FULL = f"'[' || strftime(timestamp, '%Y-%m-%d %H:%M') || '] ' || event_type || ': ' || {_LINE}"


@query("f2_line_format", f"select id, {_FULL} as line from ev", EV)
def f2(spark, d):
    return events(spark, d).select("id", X.line().alias("line"))


_DETAIL = f"case event_type when 'git_commit' then '[' || strftime(timestamp, '%Y-%m-%d %H:%M') || '] git_commit: ' || json_extract_string(raw_content, '$.message') || coalesce(' [' || project || ']', '') || chr(10) || 'Files: ' || array_to_string(json_extract_string(raw_content, '$.files_changed[*]'), ', ') when 'window' then {_FULL} || chr(10) || split_part(raw_content, ': ', 2) else {_FULL} end"


@query("f3_detail_format", f"select id, {_DETAIL} as detail from ev", EV)
def f3(spark, d):
    return events(spark, d).select("id", X.detail().alias("detail"))


@query("f4_strip_prefix", f"select id, substr({_FULL}, instr({_FULL}, '] ') + 2) as line from ev", EV)
def f4(spark, d):
    return events(spark, d).select("id", X.strip_prefix(X.line()).alias("line"))


@query("f5_rerank_text", f"select id, left(substr({_DETAIL}, instr({_DETAIL}, '] ') + 2), 2000) as text from ev", EV)
def f5(spark, d):
    return events(spark, d).select("id", X.rerank_text().alias("text"))


@query("f6_node_line", "select id, '[' || strftime(timestamp, '%Y-%m-%d %H:%M') || '] ' || event_type || ': ' || coalesce(gist, app || ' — ' || title) as line from ev", EV)
def f6(spark, d):
    n = temporal_graph.event_nodes(events(spark, d))
    return n.select("id", X.node_line().alias("line"))


@query("f8_chunk_prompt", "select strftime(date, '%Y-%m-%d') as date, source, md5(string_agg(n || '. ' || raw_content, chr(10) order by n)) as prompt from (select *, row_number() over (partition by date, source order by timestamp, id) as n from ev) group by 1, 2", EV)
def f8(spark, d):
    return task_ops.chunk_prompt(events(spark, d), ["date", "source"], F.col("raw_content")).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "source", F.md5("prompt").alias("prompt"))


@query("f9_fts_text", "select id, raw_content || ' ' || coalesce(summary, '') || ' ' || app || ' ' || title || ' ' || coalesce(gist, '') || ' ' as text from ev", EV)
def f9(spark, d):
    return events(spark, d).select("id", X.fts_text().alias("text"))


@query("f11_event_nodes", "select id, case event_type when 'window' then 'WindowEvent' when 'browser' then 'BrowserEvent' when 'terminal' then 'TerminalCommand' when 'git_commit' then 'GitCommit' else 'ScreenEvent' end as label, epoch_us(timestamp) // 1000 as ts_ms, coalesce(project, '') as project from ev", EV)
def f11(spark, d):
    n = temporal_graph.event_nodes(events(spark, d))
    return n.select("id", "label", F.col("props")["ts_ms"].cast("long").alias("ts_ms"), F.col("props")["project"].alias("project"))


@query("sc_domain", "select page_id, split_part(case when contains(url, '//') then split_part(url, '//', 2) else url end, '/', 1) as domain from pages")
def sc_domain(spark, d):
    return read(spark, d, "pages").select("page_id", X.domain_of("url").alias("domain"))


@query("sc_hour_label", "select distinct hour(ts) as hour, case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end || case when hour(ts) < 12 then ' AM' else ' PM' end as label from events")
def sc_hour(spark, d):
    return events(spark, d).select(F.hour("timestamp").cast("long").alias("hour")).distinct().withColumn("label", X.hour_label("hour"))


@query("sc_json_path", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def sc_json(spark, d):
    return read(spark, d, "events").select("event_id", X.event_text("props", "k").cast("long").alias("k"))


@query("sc_local_day", "select event_id as id, strftime(ts + interval 330 minute, '%Y-%m-%d') as day, strftime(date_trunc('day', ts + interval 330 minute) - interval 330 minute, '%Y-%m-%d %H:%M:%S') as begins from events")
def sc_local_day(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")).withColumn("d", X.local_day("ts", "+05:30"))
    return e.select("id", F.date_format("d", "yyyy-MM-dd").alias("day"), ts(X.local_midnight("d", "+05:30")).alias("begins"))


_VIDEO_URL = "case c_custkey % 3 when 0 then 'https://www.youtube.com/watch?v=ab' || c_custkey when 1 then 'https://youtu.be/xy' || c_custkey else 'https://example.org/' || c_custkey end"
_VIDEO_TITLE = "case c_custkey % 4 when 0 then 'Untitled' when 1 then 'YouTube' when 2 then 'A talk' else '' end"


@query("sc_video_title", f"select c_custkey as id, case when c_custkey % 3 = 2 then {_VIDEO_TITLE} when c_custkey % 4 in (0, 3) then 'YouTube Video (ID: ' || (case c_custkey % 3 when 0 then 'ab' else 'xy' end) || c_custkey || ')' when c_custkey % 4 = 1 then 'YouTube' else 'YouTube: A talk' end as title from customer")
def sc_video(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.video_title(F.expr(_VIDEO_TITLE), F.expr(_VIDEO_URL)).alias("title"))


@query("sc_one_line", r"select doc_id, left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 100) as line from documents")
def sc_one_line(spark, d):
    return read(spark, d, "documents").select("doc_id", X.one_line("text", 100).alias("line"))


# ---- joins ----


def _vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))


def _vector(spark, d, vec_id: int) -> list[float]:
    return list(read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


@query("j1_vector_left_join", "select event_type, count(*) as n, count(embedding) as with_vector from ev group by event_type", EV)
def j1(spark, d):
    return events(spark, d, vectors=True).groupBy("event_type").agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"))


@query("j5_unindexed_antijoin", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def j5(spark, d):
    i = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return fulltext.unindexed(read(spark, d, "documents").select(F.col("doc_id").alias("id")), i).select(F.col("id").alias("doc_id"))


@query("j6_day_vectors", "select vec_id from embeddings where vec_id in (select event_id from events where cast(ts as date) = date '2024-01-03')")
def j6(spark, d):
    day = events(spark, d).filter("date = date '2024-01-03'").select(F.col("id").cast("long").alias("vec_id"))
    return read(spark, d, "embeddings").select("vec_id").join(day, "vec_id", "left_semi")


@query("j7_hide_members", "select id from ev where cast(id as bigint) % 5 <> 0", EV)
def j7(spark, d):
    """Every fifth event belongs to the task of its user and day."""
    e = events(spark, d)
    t = e.filter(F.col("id").cast("long") % 5 == 0).groupBy("source", "date").agg(F.collect_list("id").alias("activity_ids"))
    return task_ops.hide_members(e, t).select("id")


@query("j8_keyed_union", "select coalesce(a.project, b.project) as project, coalesce(a.n, 0) as events, coalesce(b.n, 0) as tasks from (select project, count(*) as n from ev where project is not null group by 1) a full join (select project, count(*) as n from tasks where project is not null group by 1) b on a.project = b.project", EV, TASKS)
def j8(spark, d):
    a = events(spark, d).filter("project is not null").groupBy("project").agg(F.count("*").alias("events"))
    b = tasks(spark, d).filter("project is not null").groupBy("project").agg(F.count("*").alias("tasks"))
    return a.join(b, "project", "full").select("project", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("tasks", F.lit(0)).alias("tasks"))


@query("j13_nearest_event", f"select id, {sts()} as ts from ev where app = 'app3' order by abs(epoch_us(timestamp) // 1000000 - epoch_us(timestamp '2024-01-15 12:00:00') // 1000000), timestamp, id limit 1", EV)
def j13(spark, d):
    return temporal_graph.anchor(events(spark, d), "APP3", F.to_timestamp(F.lit("2024-01-15 12:00:00"))).select("id", ts().alias("ts"))


HOURS = "hours as (select date '2024-01-09' as date, h as hour, 'Title ' || h as title, 'stored ' || h as summary from (select unnest([3, 10, 30]) as h))"


def _stored(spark) -> DataFrame:
    return spark.createDataFrame([(h, f"Title {h}", f"stored {h}") for h in (3, 10, 30)], "hour int, title string, summary string").select(F.to_date(F.lit("2024-01-09")).alias("date"), "hour", "title", "summary", F.array().cast("array<string>").alias("apps"), F.array().cast("array<string>").alias("categories"), F.lit(0).cast("long").alias("event_count"))


_FREQ = "(select {k}, string_agg({v}, ',' order by n desc, {v}) as vals from (select {k}, {v}, count(*) as n from ev where {v} is not null and {v} <> '' group by {k}, {v}) group by {k})"
_SEEN = "(select {k}, string_agg({v}, '{s}' order by a, i) as vals from (select {k}, {v}, min(timestamp) as a, arg_min(id, (timestamp, id)) as i from {t} where {v} is not null and {v} <> '' group by {k}, {v}) group by {k})"
_DAY = "day as (select *, hour(timestamp) as h from ev where date = date '2024-01-09')"


@query("j14_timeline", "select coalesce(g.h, s.hour) as hour, s.title, case when s.hour is not null then s.summary else coalesce(m.vals, '') end as summary, case when s.hour is not null then '' else a.vals end as apps, case when s.hour is not null then '' else coalesce(c.vals, '') end as categories, case when s.hour is not null then 0 else g.n end as event_count from (select h, count(*) as n from day group by h) g full join hours s on s.hour = g.h left join " + _FREQ.format(k="h", v="app").replace("from ev", "from day") + " a on a.h = g.h left join " + _SEEN.format(k="h", v="summary", s="; ", t="day") + " m on m.h = g.h left join " + _SEEN.format(k="h", v="category", s=",", t="day") + " c on c.h = g.h", EV, HOURS, _DAY)
def j14(spark, d):
    t = api.timeline(events(spark, d), _stored(spark), "2024-01-09")
    return t.select(F.col("hour").cast("long").alias("hour"), "title", "summary", joined("apps").alias("apps"), joined("categories").alias("categories"), "event_count")


# ---- rollups ----


@query("a1_task_stats", "select coalesce(category, '') as category, count(*) as n, count(*) filter (where status = 'completed') as completed, round(sum(duration_minutes) / 60, 4) as hours, sum(count(*)) over ()::bigint as all_n from tasks where start_time >= timestamp '1998-01-01 00:00:00' group by 1", TASKS)
def a1(spark, d):
    return rollup.task_statistics(tasks(spark, d), F.to_timestamp(F.lit("1998-01-01"))).select("category", "n", "completed", F.round("hours", 4).alias("hours"), "all_n")


@query("a2_graph_stats", "select event_type as type, count(*) as n, (select count(*) from (select distinct user_id, event_type from events)) as entities, (select count(*) from customer) as relations from (select distinct user_id, event_type from events) group by event_type")
def a2(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("type")).distinct()
    return entity_graph.graph_stats(e, read(spark, d, "customer"))


@query("a3_type_breakdown", "select event_type, count(*) as n, cast(floor(100 * count(*) / sum(count(*)) over ()) as bigint) as percent from ev group by event_type", EV)
def a3(spark, d):
    return rollup.type_breakdown(events(spark, d))


@query("a4_top_projects", "select project, n, row_number() over (order by n desc, project) as rank from (select project, count(*) as n from ev where project is not null group by project order by n desc, project limit 10)", EV)
def a4(spark, d):
    return rollup.top(events(spark, d), F.col("project"), "project", 10).withColumn("rank", F.col("rank").cast("long"))


@query("a5_top_hours", "select hour, n, row_number() over (order by n desc, hour) as rank from (select hour(ts) as hour, count(*) as n from events group by 1 order by n desc, hour limit 5)")
def a5(spark, d):
    return rollup.top(events(spark, d), F.hour("timestamp").cast("long"), "hour", 5).withColumn("rank", F.col("rank").cast("long"))


@query("a6_active_days", "select count(distinct cast(ts as date)) as days, count(*) as events, round(count(*) / count(distinct cast(ts as date)), 6) as per_day from events")
def a6(spark, d):
    return rollup.active_days(events(spark, d)).select("days", "events", F.round("per_day", 6).alias("per_day"))


@query("a7_project_type_counts", "select project, cast(sum(n) as bigint) as n, string_agg(event_type || ':' || n, ',' order by n desc, event_type) as types from (select coalesce(project, 'unassigned') as project, event_type, count(*) as n from ev group by 1, 2) group by project", EV)
def a7(spark, d):
    return rollup.project_types(events(spark, d))


SESS = "sess as (select *, sum(case when epoch_us(timestamp) - epoch_us(prev) <= 21600000000 then 0 else 1 end) over (partition by user_id order by timestamp, id rows unbounded preceding)::bigint as session from (select ev.*, cast(substr(source, 2) as bigint) as user_id, lag(timestamp) over (partition by source order by timestamp, id) as prev from ev))"


@query("a8_session_table", f"select user_id, session, {sts('min(a)')} as start, {sts('max(b)')} as stop, cast(sum(n) as bigint) as event_count, arg_max(event_type, (n, -ascii(event_type), -ascii(substr(event_type, 2)))) as dominant, string_agg(event_type || ':' || n, ',' order by n desc, event_type) as by_type from (select user_id, session, event_type, count(*) as n, min(timestamp) as a, max(timestamp) as b from sess group by 1, 2, 3) group by 1, 2", EV, SESS)
def a8(spark, d):
    s = sequence.session_table(sequence.gap_sessions(events(spark, d), ["user_id"], 21600), ["user_id"])
    return s.select("user_id", "session", ts("start").alias("start"), ts("end").alias("stop"), "event_count", "dominant", "by_type")


@query("a9_category_share", "select category, count(*) as n, cast(floor(100 * count(*) / sum(count(*)) over ()) as bigint) as percent, cast(floor(100 * sum(count(category)) over () / sum(count(*)) over ()) as bigint) as categorized_percent from ev group by category", EV)
def a9(spark, d):
    return rollup.category_shares(events(spark, d))


@query("a10_project_analysis", "select event_type, count(*) as n, (select count(*) from tasks where project = 'p2') as tasks, (select string_agg(title, ';' order by start_time desc, id) from (select * from tasks where project = 'p2' order by start_time desc, id limit 10)) as titles from ev where project = 'p2' group by event_type", EV, TASKS)
def a10(spark, d):
    return rollup.project_analysis(events(spark, d), tasks(spark, d), "p2")


_LINES = "(select date, h, string_agg(left(coalesce(nullif(trim(summary), ''), trim(raw_content)), 120), chr(10) order by n) as vals from (select *, row_number() over (partition by date, h order by timestamp, id) as n from eh) where n <= 24 group by date, h)"


@query("a11_hour_aggregate", "select strftime(g.date, '%Y-%m-%d') as date, g.h as hour, g.n as event_count, a.vals as apps, coalesce(c.vals, '') as categories, md5(l.vals) as lines from (select date, h, count(*) as n from eh group by date, h) g left join " + _FREQ.format(k="date, h", v="app").replace("from ev", "from eh") + " a on a.date = g.date and a.h = g.h left join " + _SEEN.format(k="date, h", v="category", s=",", t="eh") + " c on c.date = g.date and c.h = g.h left join " + _LINES + " l on l.date = g.date and l.h = g.h", EV, "eh as (select *, hour(timestamp) as h from ev)")
def a11(spark, d):
    t = rollup.hour_aggregate(events(spark, d))
    return t.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("hour").cast("long").alias("hour"), "event_count", joined("apps").alias("apps"), joined("categories").alias("categories"), F.md5(F.array_join("lines", "\n")).alias("lines"))


@query("a12_hour_buckets", "select strftime(cast(ts as date), '%Y-%m-%d') as date, hour(ts) as hour, count(*) as n from events group by 1, 2")
def a12(spark, d):
    return rollup.hours(events(spark, d)).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("hour").cast("long").alias("hour")).agg(F.count("*").alias("n"))


DAILY = "daily as (select g.date, g.total, c.categories, c.tops as top_categories, coalesce(p.tops, '') as top_projects from (select date, count(*) as total from ev group by date) g join (select date, string_agg(cat || ':' || n || '/' || k, ',' order by n desc, cat) as categories, string_agg(cat, ',' order by n desc, cat) filter (where r <= 3) as tops from (select date, coalesce(category, 'Other') as cat, count(*) as n, count(distinct project) as k, row_number() over (partition by date order by count(*) desc, coalesce(category, 'Other')) as r from ev group by 1, 2) group by date) c on c.date = g.date left join (select date, string_agg(project, ',' order by n desc, project) as tops from (select date, project, count(*) as n, row_number() over (partition by date order by count(*) desc, project) as r from ev where project is not null group by 1, 2) where r <= 5 group by date) p on p.date = g.date)"


@query("a14_daily_summary", "select strftime(date, '%Y-%m-%d') as date, total, categories, top_categories, top_projects from daily", EV, DAILY)
def a14(spark, d):
    return rollup.daily_summary(events(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "total", "categories", "top_categories", "top_projects")


@query("s22_summary_markdown", "select strftime(date, '%Y-%m-%d') as date, concat_ws(chr(10), '# Summary of ' || strftime(date, '%B %d, %Y'), '', 'Events: ' || total, 'Categories: ' || categories, 'Projects: ' || top_projects) as markdown from daily", EV, DAILY)
def s22(spark, d):
    return rollup.daily_summary(events(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), sinks.summary_markdown().alias("markdown"))


@query("a15_daily_tasks", "select strftime(g.date, '%Y-%m-%d') as date, total, completed, minutes, coalesce(p.tops, '') as top_projects from (select cast(start_time as date) as date, count(*) as total, count(*) filter (where status = 'completed') as completed, sum(duration_minutes) as minutes from tasks group by 1) g left join (select date, string_agg(project, ',' order by n desc, project) as tops from (select cast(start_time as date) as date, project, count(*) as n, row_number() over (partition by cast(start_time as date) order by count(*) desc, project) as r from tasks where project is not null group by 1, 2) where r <= 5 group by date) p on p.date = g.date", TASKS)
def a15(spark, d):
    return rollup.daily_tasks(tasks(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "total", "completed", "minutes", "top_projects")


@query("a16_rich_daily", "select id, row_number() over (partition by cast(start_time as date) order by duration_minutes desc, id) as place, count(*) over (partition by cast(start_time as date)) as day_tasks, sum(duration_minutes) over (partition by cast(start_time as date)) as day_minutes from tasks", TASKS)
def a16(spark, d):
    return rollup.rich_daily(tasks(spark, d)).select("id", F.col("place").cast("long").alias("place"), "day_tasks", "day_minutes")


@query("a17_weekly", "select count(*) as total, count(*) filter (where status = 'completed') as completed, round(coalesce(sum(duration_minutes), 0) / 60, 4) as hours, round(case when count(*) > 0 then count(*) filter (where status = 'completed') / count(*) else 0 end, 6) as completion_rate, (select string_agg(v || ':' || n, ',' order by n desc, v) from (select coalesce(category, 'none') as v, count(*) as n from w group by 1)) as by_category, (select string_agg(v || ':' || n, ',' order by n desc, v) from (select coalesce(project, 'none') as v, count(*) as n from w group by 1)) as by_project from w", TASKS, "w as (select * from tasks where cast(start_time as date) >= date '1996-05-06' and cast(start_time as date) < date '1996-05-13')")
def a17(spark, d):
    t = rollup.weekly(tasks(spark, d), "1996-05-06")
    return t.select("total", "completed", F.round("hours", 4).alias("hours"), F.round("completion_rate", 6).alias("completion_rate"), "by_category", "by_project")


@query("a19_mean_vector", "select label, i as pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i")
def a19(spark, d):
    m = rollup.mean_vector(read(spark, d, "embeddings"), ["label"])
    return m.select("label", F.posexplode("embedding").alias("pos", "mean")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("a20_mode", "select source, v as mode from (select source, event_type as v, row_number() over (partition by source order by count(*) desc, event_type) as r from ev group by 1, 2) where r = 1", EV)
def a20(spark, d):
    return rollup.modes(events(spark, d), ["source"], "event_type")


@query("a21_spans", "select source, cast(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60000000) as bigint) as minutes from ev group by source", EV)
def a21(spark, d):
    e = events(spark, d)
    return e.groupBy("source").agg(F.floor((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 60_000_000).cast("long").alias("minutes"))


@query("a23_session_apps", "select user_id, session, string_agg(app, ',' order by app) as apps from (select distinct user_id, session, app from sess) group by 1, 2", EV, SESS)
def a23(spark, d):
    s = sequence.gap_sessions(events(spark, d), ["user_id"], 21600)
    return s.groupBy("user_id", "session").agg(joined(F.array_sort(F.collect_set("app"))).alias("apps"))


@query("a24_review_calendar", "select strftime(day, '%Y-%m-%d') as date, coalesce(n, 0) as total, n is not null as stored from (select unnest(generate_series(date '2023-12-30', date '2024-01-05', interval 1 day))::date as day) left join (select date, count(*) as n from ev where date <> date '2024-01-03' group by date) on date = day", EV)
def a24(spark, d):
    t = events(spark, d).filter("date <> date '2024-01-03'").groupBy("date").agg(F.count("*").alias("total"))
    return rollup.review(t, "2023-12-30", "2024-01-05").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("total", F.lit(0)).alias("total"), F.col("total").isNotNull().alias("stored"))


# ---- sequences ----


@query("w1_sessions", "select id, session from sess", EV, SESS)
def w1(spark, d):
    return sequence.gap_sessions(events(spark, d), ["user_id"], 21600).select("id", "session")


@query("w1_global_sessions", "select id, sum(case when epoch_us(timestamp) - epoch_us(prev) <= 600000000 then 0 else 1 end) over (order by timestamp, id rows unbounded preceding)::bigint as session from (select *, lag(timestamp) over (order by timestamp, id) as prev from ev)", EV)
def w1g(spark, d):
    return sequence.global_sessions(events(spark, d)).select("id", "session")


@query("w2_incremental_sessions", "select id, sum(case when epoch_us(timestamp) // 1000000 - epoch_us(prev) // 1000000 <= 600 then 0 else 1 end) over (partition by source order by timestamp, id rows unbounded preceding)::bigint as session from (select *, lag(timestamp) over (partition by source order by timestamp, id) as prev from ev)", EV)
def w2(spark, d):
    return sequence.gap_sessions(events(spark, d), ["source"], whole_seconds=True).select("id", "session")


RUNS = "runs as (select *, lead(timestamp) over (partition by source order by timestamp, id) as nxt from (select * from (select *, lag(app) over (partition by source order by timestamp, id) as pa from ev) where pa is null or pa <> app))"


@query("w3_focus_runs", f"select source, app, {sts()} as start, epoch_us(nxt) // 1000000 - epoch_us(timestamp) // 1000000 as duration_seconds from runs where epoch_us(nxt) // 1000000 - epoch_us(timestamp) // 1000000 >= 30", EV, RUNS)
def w3(spark, d):
    r = sequence.focus_runs(events(spark, d), ["source"], ["app"])
    return r.select("source", "app", ts("start").alias("start"), "duration_seconds")


@query("w4_row_durations", f"select id, epoch_us(coalesce(nxt, timestamp '{NOW}')) // 1000000 - epoch_us(timestamp) // 1000000 as duration_seconds from (select *, lead(timestamp) over (partition by source order by timestamp, id) as nxt from ev) where epoch_us(coalesce(nxt, timestamp '{NOW}')) // 1000000 - epoch_us(timestamp) // 1000000 >= 4", EV)
def w4(spark, d):
    return sequence.row_durations(events(spark, d), ["source"], now()).select("id", "duration_seconds")


SNAPS = "snaps as (select source, date, list(distinct app order by app) as apps from ev group by source, date), prev as (select *, coalesce(lag(apps) over (partition by source order by date), []) as old from snaps)"


@query("w5_set_diff", "select source, strftime(date, '%Y-%m-%d') as date, array_to_string(list_sort(list_filter(apps, lambda x: not list_contains(old, x))), ',') as added, array_to_string(list_sort(list_filter(old, lambda x: not list_contains(apps, x))), ',') as removed from prev where len(list_filter(apps, lambda x: not list_contains(old, x))) + len(list_filter(old, lambda x: not list_contains(apps, x))) > 0", EV, SNAPS)
def w5(spark, d):
    s = events(spark, d).groupBy("source", F.col("date").alias("timestamp")).agg(F.array_sort(F.collect_set("app")).alias("apps"))
    c = sequence.set_changes(s, "source", "apps")
    return c.select("source", F.date_format("timestamp", "yyyy-MM-dd").alias("date"), joined("added").alias("added"), joined("removed").alias("removed"))


NEAR = "near as (select *, lag(embedding) over (partition by date, event_type order by pos) as pe from (select *, row_number() over (partition by date order by timestamp desc, id desc) as pos from ev) where embedding is not null), isl as (select *, sum(case when list_cosine_similarity(pe::double[], embedding::double[]) >= 0.0 then 0 else 1 end) over (partition by date, event_type order by pos rows unbounded preceding) as island from near)"


@query("w6_neardup_runs", "select arg_max(id, pos) as id, min(pos) as pos from isl group by date, event_type, island union all select id, pos from (select id, embedding, row_number() over (partition by date order by timestamp desc, id desc) as pos from ev) where embedding is null", EV, NEAR)
def w6(spark, d):
    return sequence.near_duplicate_runs(events(spark, d, vectors=True), ["date"], 0.0).select("id", F.col("pos").cast("long").alias("pos"))


@query("w7_chain_walk", "select source, id, n - a as step from (select *, min(case when date >= date '2024-01-15' then n end) over (partition by source) as a from (select *, row_number() over (partition by source order by timestamp, id) as n from ev)) where n - a between -3 and 3", EV)
def w7(spark, d):
    w = sequence.chain_walk(events(spark, d), ["source"], F.col("date") >= F.to_date(F.lit("2024-01-15")), 3, 3)
    return w.select("source", "id", F.col("step").cast("long").alias("step"))


@query("w8_transition", "select id, case when pa is null then 'new' when pa <> app then 'switch' when pt <> title then 'new' else 'same' end as transition from (select *, lag(app) over (partition by source order by timestamp, id) as pa, lag(title) over (partition by source order by timestamp, id) as pt from ev)", EV)
def w8(spark, d):
    return sequence.transitions(events(spark, d), ["source"]).select("id", "transition")


_TRANS = "tr as (select *, row_number() over (partition by source, app order by timestamp, id) as n, case when pa is null then 'new' when pa <> app then 'switch' when pt <> title then 'new' else 'same' end as transition from (select id, source, app, title, timestamp, embedding::double[] as e, lag(app) over (partition by source order by timestamp, id) as pa, lag(title) over (partition by source order by timestamp, id) as pt from ev))"
_SAME = "coalesce(t.transition = 'same' and epoch_us(t.timestamp) - epoch_us(c.at) <= 2592000000000 and list_cosine_similarity(c.vec, t.e) >= 0.0, false)"
CACHE = f"recursive cache as (select source, app, 0::bigint as n, null::double[] as vec, null::timestamp as at, false as dropped from ev group by source, app union all select c.source, c.app, t.n, case when not {_SAME} and t.e is not null then t.e else c.vec end, case when not {_SAME} and t.e is not null then t.timestamp else c.at end, {_SAME} from cache c join tr t on t.source = c.source and t.app = c.app and t.n = c.n + 1)"


@query("w9_visual_drops", "select id, transition, dropped from tr join cache using (source, app, n)", EV, _TRANS, CACHE)
def w9(spark, d):
    e = events(spark, d, vectors=True).select("source", "app", "title", "timestamp", "id", "embedding")
    return sequence.visual_drops(e, ["source"], 0.0, 30 * 86400).select("id", "transition", "dropped")


@query("w11_split_blocks", "select id, (row_number() over (partition by source order by timestamp, id) - 1) // 30 as block from ev", EV)
def w11(spark, d):
    return sequence.blocks(events(spark, d), ["source"]).select("id", F.col("block").cast("long").alias("block"))


_KEY = "case event_type when 'browser' then json_extract_string(raw_content, '$.url') when 'terminal' then json_extract_string(raw_content, '$.command') when 'window' then app || '|' || title else id end"


@query("w12_content_dedup", f"select event_type, arg_max(id, (timestamp, id)) as id, {sts('min(timestamp)')} as first_seen from ev group by source, event_type, {_KEY}", EV)
def w12(spark, d):
    return sequence.content_dedup(events(spark, d), ["source"]).select("event_type", "id", ts("first_seen").alias("first_seen"))


@query("t5_topn_groups", "select source, app, r as rank from (select source, app, row_number() over (partition by source order by count(*) desc, app) as r from ev group by source, app) where r <= 3", EV)
def t5(spark, d):
    f = rollup.by_frequency(events(spark, d), ["source"], "app", 3)
    return f.select("source", F.posexplode("values").alias("p", "app")).select("source", "app", (F.col("p") + 1).cast("long").alias("rank"))


@query("t7_first_n", "select source, array_to_string((list(id order by timestamp, id))[1:5], ',') as ids from ev group by source", EV)
def t7(spark, d):
    e = events(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("timestamp", "id"))).filter("r <= 5")
    return e.groupBy("source").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])).alias("ids"))


@query("u3_array_except", "select source, len(list_filter(list(distinct app), lambda x: x not in ('app1', 'app2'))) as n from ev group by source", EV)
def u3(spark, d):
    return events(spark, d).groupBy("source").agg(F.size(F.array_except(F.collect_set("app"), F.array(F.lit("app1"), F.lit("app2")))).cast("long").alias("n"))


# ---- vectors ----

_COS = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = {}))"


@query("j3_knn_chunks", f"select id, max(round({_COS.format(7)}, 6)) as score, arg_max(chunk, ({_COS.format(7)}, -chunk)) as chunk from (select *, vec_id // 3 as id, vec_id % 3 as chunk from embeddings) group by id order by max({_COS.format(7)}) desc, cast(id as varchar) limit 20")
def j3_chunks(spark, d):
    """Three vectors to a text: a text is found once, by its best chunk."""
    v = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("string").alias("id"), (F.col("vec_id") % 3).cast("int").alias("chunk_index"), "embedding")
    return vector.nearest(v, _vector(spark, d, 7), 20).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"), F.col("chunk_index").cast("long").alias("chunk"))


@query("v1_knn", f"select vec_id as id, round({_COS.format(7)}, 6) as score from embeddings order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 10")
def v1(spark, d):
    return vector.nearest(_vectors(spark, d), _vector(spark, d, 7), 10).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


@query("v1_knn_filtered", f"select vec_id as id, round({_COS.format(7)}, 6) as score from embeddings where label = 3 order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 10")
def v1f(spark, d):
    return vector.nearest(_vectors(spark, d), _vector(spark, d, 7), 10, where=F.col("label") == 3).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


PAIRS = "pairs as (select a.vec_id as query_id, b.vec_id as id, 'c' || b.label as category, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0), top as (select *, row_number() over (partition by query_id order by round(score, 12) desc, cast(id as varchar)) as rank from pairs)"


@query("v1_knn_batch", "select query_id, id, round(score, 6) as score, rank from top where rank <= 5", PAIRS)
def v1b(spark, d):
    return _batch(spark, d, 5).select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _batch(spark, d, k: int) -> DataFrame:
    v = _vectors(spark, d)
    q = v.filter(F.col("id").cast("long") % 100 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    n = vector.nearest_of_each(q, v, k + 1).filter("query_id <> id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@query("v3_cosine_pairs", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def v3(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.join(b, e["vec_id"] == b["a"]).select("a", "b", F.round(X.cosine("embedding", "v"), 6).alias("score"))


@query("v4_normalized", "select vec_id, round(list_sum(list_transform(embedding, lambda x: (3 * x::double) / sqrt(list_sum(list_transform(embedding, lambda y: 9 * y::double * y::double))))), 5) as total from embeddings")
def v4(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return read(spark, d, "embeddings").withColumn("v", v).select("vec_id", F.round(F.aggregate(X.normalized("v"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("v5_category_vote", "select query_id, category, round(s / total + least(0.2, 0.2 * k / n), 6) as confidence, case when s / total + least(0.2, 0.2 * k / n) >= 0.4 then 'rag' else 'fallback' end as kind from (select *, row_number() over (partition by query_id order by s desc, category) as r, sum(s) over (partition by query_id) as total, sum(k) over (partition by query_id) as n from (select query_id, category, sum(score) as s, count(*) as k from top where rank <= 10 group by 1, 2)) where r = 1", PAIRS)
def v5(spark, d):
    c = _vectors(spark, d).select("id", "category")
    n = _batch(spark, d, 10).join(c, "id")
    return vector.vote(n, 0.4).select(F.col("query_id").cast("long").alias("query_id"), "category", F.round("confidence", 6).alias("confidence"), "kind")


def _timed_vectors(spark, d) -> DataFrame:
    return events(spark, d, vectors=True).filter("embedding is not null")


def _clusters(p: str, eps: float = 1.15, least: int = 3) -> list[str]:
    """Density clusters of the rows (grp, id, timestamp, e) of ``p`` as common table expressions; the last, ``{p}_label``, has
    every row's cluster."""
    return [
        f"{p}_n as (select *, row_number() over (partition by grp order by timestamp, id) as n from {p})",
        f"{p}_near as (select a.grp, a.n as a, b.n as b from {p}_n a join {p}_n b on a.grp = b.grp and a.n <> b.n where 2 - 2 * list_cosine_similarity(a.e, b.e) <= {eps} * {eps} + 1e-9)",
        f"{p}_core as (select grp, a as n from {p}_near group by grp, a having count(*) >= {least})",
        f"{p}_edge as (select x.* from {p}_near x join {p}_core c on c.grp = x.grp and c.n = x.a join {p}_core d on d.grp = x.grp and d.n = x.b)",
        f"recursive {p}_reach as (select grp, n as root, n as here from {p}_core union select r.grp, r.root, x.b from {p}_reach r join {p}_edge x on x.grp = r.grp and x.a = r.here)",
        f"{p}_head as (select grp, n, dense_rank() over (partition by grp order by h) - 1 as c from (select grp, here as n, min(root) as h from {p}_reach group by grp, here))",
        f"{p}_border as (select x.grp, x.a as n, min(h.c) as c from {p}_near x join {p}_head h on h.grp = x.grp and h.n = x.b where not exists (select 1 from {p}_core o where o.grp = x.grp and o.n = x.a) group by 1, 2)",
        f"{p}_label as (select p.*, coalesce(h.c, b.c, -1) as cluster from {p}_n p left join {p}_head h on h.grp = p.grp and h.n = p.n left join {p}_border b on b.grp = p.grp and b.n = p.n)",
    ]


def _in_blocks(p: str) -> list[str]:
    """Of ``_clusters`` those of groups of three vectors or more, a group without a cluster as one, cut in thirties: ``{p}_block``."""
    return [
        f"{p}_kept as (select *, max(cluster) over (partition by grp) as any_c, count(*) over (partition by grp) as size from {p}_label)",
        f"{p}_block as (select *, (row_number() over (partition by grp, c order by timestamp, id) - 1) // 30 as block from (select *, greatest(cluster, 0) as c from {p}_kept where size >= 3 and (cluster >= 0 or any_c < 0)))",
    ]


def _greedy(p: str, threshold: float, least: int = 50) -> list[str]:
    """Rows (grp, id, timestamp, e) of ``p`` that resemble no kept one before them: ``{p}_kept_rows``."""
    like = f"len(list_filter(g.kept, lambda k: list_cosine_similarity(k, p.e) >= {threshold})) > 0"
    return [
        f"{p}_seq as (select *, row_number() over (partition by grp order by timestamp, id) as n from {p} where e is not null)",
        f"recursive {p}_scan as (select grp, 0::bigint as n, []::double[][] as kept, true as keep from {p}_seq group by grp union all select g.grp, p.n, case when {like} then g.kept else list_append(g.kept, p.e) end, not ({like}) from {p}_scan g join {p}_seq p on p.grp = g.grp and p.n = g.n + 1)",
        f"{p}_kept_rows as (select p.* exclude (total) from (select *, count(*) over (partition by grp) as total from {p}) p left join (select grp, id, keep from {p}_seq join {p}_scan using (grp, n)) k on k.grp = p.grp and k.id = p.id where p.total <= {least} or p.e is null or k.keep)",
    ]


VECS = "vecs as (select id, event_type as grp, project, timestamp, embedding::double[] as e from ev where embedding is not null)"
BY_PROJECT = "projects as (select id, coalesce(project, '') as grp, project, timestamp, embedding::double[] as e from ev where embedding is not null)"


@query("v6_dbscan", "select id, cluster::bigint as cluster from vecs_label", EV, VECS, *_clusters("vecs"))
def v6(spark, d):
    return cluster.dbscan(_timed_vectors(spark, d), ["event_type"], 1 - 1.15, 3).select("id", F.col("cluster").cast("long").alias("cluster"))


ALL_VECS = "everything as (select id, 1 as grp, project, timestamp, embedding::double[] as e from ev where embedding is not null)"


@query("v6_dbscan_all", "select id, cluster::bigint as cluster from everything_label", EV, ALL_VECS, *_clusters("everything", 1.05))
def v6_all(spark, d):
    """One group of all vectors, dealt out to many tasks."""
    return cluster.dbscan(_timed_vectors(spark, d), [], 1 - 1.05, 3, block=256).select("id", F.col("cluster").cast("long").alias("cluster"))


@query("v8_project_clusters", "select id, project, c::bigint as cluster, block::bigint as block from projects_block", EV, BY_PROJECT, *_clusters("projects"), *_in_blocks("projects"))
def v8(spark, d):
    c = cluster.project_clusters(_timed_vectors(spark, d), 1 - 1.15, 3)
    return c.select("id", "project", F.col("cluster").cast("long").alias("cluster"), F.col("block").cast("long").alias("block"))


@query("v9_greedy_dedup", "select id from vecs_kept_rows", EV, VECS, *_greedy("vecs", 0.35))
def v9(spark, d):
    return vector.greedy_dedup(_timed_vectors(spark, d), ["event_type"], 0.35).select("id")


@query("v9_dedup_all", "select id from everything_kept_rows", EV, ALL_VECS, *_greedy("everything", 0.4))
def v9_all(spark, d):
    """One group of all vectors, decided in rounds by many tasks."""
    return vector.greedy_dedup(_timed_vectors(spark, d), [], 0.4, block=256).select("id")


# one search text of frequent words
SEARCH = "the of and ing re"
_T = ("the", "of", "and", "ing", "re")
def _bm25(p: str, texts: str, terms: tuple[str, ...]) -> list[str]:
    """BM25 scores of ``texts`` (rows id, text) as common table expressions, the last of them ``{p}bm`` (id, score)."""
    d, idf = range(len(terms)), "ln((n - d{0} + 0.5) / (d{0} + 0.5))"
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(terms))
    score = " + ".join(f"greatest({idf.format(i)}, case when {idf.format(i)} > 0 then -1e9 else 1e-6 end) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in d)
    return [
        f"{p}toks as (select id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2) as w from ({texts}))",
        f"{p}tf as (select id, len(w) as dl, {counts} from {p}toks)",
        f"{p}st as (select count(*) as n, avg(dl) as avgdl, " + ", ".join(f"count(*) filter (where t{i} > 0) as d{i}" for i in d) + f" from {p}tf)",
        f"{p}bm as (select id, {score} as score from {p}tf, {p}st where " + " + ".join(f"t{i}" for i in d) + " > 0)",
    ]


TERMS = ", ".join(_bm25("", "select cast(doc_id as varchar) as id, text from documents", _T))


@query("x1_query_terms", "select doc_id, list_sort(list_distinct(list_filter(w, lambda x: octet_length(encode(x)) >= 2))) as terms from (select doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') as w from documents)")
def x1(spark, d):
    """Every document as a search text: its terms, in order."""
    return read(spark, d, "documents").select("doc_id", F.array_sort(X.search_terms("text")).alias("terms"))


@query("x3_bm25", "select id, round(score, 6) as score from bm order by score desc, id limit 40", TERMS)
def x3(spark, d):
    """By the kept index: no text is read once it is there."""
    return _index(spark, d).search(SEARCH, 40, digits=6)


@query("x3_bm25_scan", "select id, round(score, 6) as score from bm order by score desc, id limit 40", TERMS)
def x3_scan(spark, d):
    return fulltext.bm25(documents(spark, d), SEARCH, 40, digits=6)


@query("x4_index_deltas", r"select term, count(*) as docs, cast(sum(tf) as bigint) as total from (select id, term, count(*) as tf from (select id, unnest(case when id::bigint % 5 = 1 then ['changed', 'text'] else w end) as term from toks where id::bigint % 7 <> 0) group by 1, 2) group by term", TERMS)
def x4_deltas(spark, d):
    """Every document indexed, every fifth anew with another text, every seventh removed, and what is left folded."""
    index = TextIndex(spark, _folder(spark)).passing()
    docs = documents(spark, d)
    index.add(docs)
    index.add(docs.filter("cast(id as bigint) % 5 = 1").withColumn("text", F.lit("changed text")))
    index.remove(docs.filter("cast(id as bigint) % 7 = 0"))
    index.refold()
    return index.postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


@query("x4_postings", r"select term, count(*) as docs, cast(sum(tf) as bigint) as total from (select id, term, count(*) as tf from (select id, unnest(w) as term from toks) group by 1, 2) group by term", TERMS)
def x4(spark, d):
    return fulltext.postings(documents(spark, d)).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


# texts and vectors share ids: vector i stands for document i
_AGE = f"((epoch_us(timestamp '{NOW}') // 1000000 - epoch_us(timestamp) // 1000000) / 86400.0)"
HYB = "docs as (select cast(doc_id as varchar) as id, timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 700 as int)) as timestamp from documents), va as (select cast(vec_id as varchar) as id, row_number() over (order by " + _COS.format(7) + " desc, cast(vec_id as varchar)) as r from embeddings where vec_id in (select doc_id from documents)), ta as (select id, row_number() over (order by score desc, id) as r from bm), fused as (select id, sum(1.0::double / (60 + r)) as s from (select * from va where r <= 40 union all select * from ta where r <= 40) group by id order by s desc, id limit 40)"


def _timed_documents(spark, d) -> DataFrame:
    return documents(spark, d).withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("id").cast("long") % 700 * 3600))


def _searchable(spark, d) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return _timed_documents(spark, d).join(v, "id", "left")


@query("v10_hybrid_rrf", f"select id, round(s + 0.02 * exp(-{_AGE} / 30), 6) as score from fused join docs using (id) order by s + 0.02 * exp(-{_AGE} / 30) desc, id limit 10", TERMS, HYB)
def v10(spark, d):
    vec = vector.nearest(_searchable(spark, d), _vector(spark, d, 7), 40).select("id", "score")
    return vector.hybrid(vec, _index(spark, d).search(SEARCH, 40), _timed_documents(spark, d), now(), 10).select("id", F.round("score", 6).alias("score"))


@query("v11_recency", f"select id, round(0.02 * exp(-greatest(0, epoch_us(timestamp '{NOW}') // 1000000 - epoch_us(timestamp) // 1000000) / 86400.0 / 30), 8) as boost from ev", EV)
def v11(spark, d):
    return events(spark, d).select("id", F.round(X.recency("timestamp", now(), 0.02, 30), 8).alias("boost"))


@query("v12_rerank", f"select id, length(text)::double as score, 'rerank' as score_kind from (select cast(vec_id as varchar) as id, text from embeddings join documents on doc_id = vec_id order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 40) order by length(text) desc, id limit 10")
def v12(spark, d):
    p = vector.nearest(_searchable(spark, d), _vector(spark, d, 7), 40).select("id", "score", "text")
    return vector.rerank(p, lambda texts: [len(t) for t in texts], 10, F.col("text")).select("id", "score", "score_kind")


@query("v13_rag_context", "select vec_id as id, round(list_cosine_similarity(embedding::double[], m), 6) as score from embeddings, (select list(x order by i) as m from (select i, avg(x) as x from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where label = 4) group by i)) where label <> 4 order by list_cosine_similarity(embedding::double[], m) desc, cast(vec_id as varchar) limit 5")
def v13(spark, d):
    v = _vectors(spark, d)
    return api.rag_context(v.filter("label = 4"), v).select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


@query("v14_graph_rag", f"with r as (select distinct 'u' || user_id as a, 't' || event_type as b from events), sym as (select a, b from r union select b, a from r) select 'event' as kind, id, round(0.6::double / (60 + n), 8) as score from (select cast(vec_id as varchar) as id, row_number() over (order by {_COS.format(7)} desc, cast(vec_id as varchar)) as n from embeddings) where n <= 10 union all select * from (select 'entity' as kind, id, 0.0::double as score from (select id, min(depth) as depth from (select b as id, 1 as depth from sym where a = 'u1' union all select y.b, 2 from sym x join sym y on y.a = x.b where x.a = 'u1') where id <> 'u1' group by id) order by depth, id limit 10)")
def v14(spark, d):
    r = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_entity_id"), F.concat(F.lit("t"), F.col("event_type")).alias("target_entity_id")).distinct()
    q = spark.createDataFrame([("u1",)], "id string")
    return api.graph_rag(_vectors(spark, d), _vector(spark, d, 7), q, r).select("kind", "id", F.coalesce(F.round("score", 8), F.lit(0.0)).alias("score"))


@query("v15_task_aware", f"select * from (select 'task' as kind, vec_id as id, round({_COS.format(7)}, 6) as score from embeddings where label = 2 order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 5) union all select * from (select 'activity' as kind, vec_id as id, round({_COS.format(7)}, 6) as score from embeddings where vec_id % 2 = 0 or vec_id // 50 not in (select vec_id // 50 from (select vec_id from embeddings where label = 2 order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 5)) order by {_COS.format(7)} desc, cast(vec_id as varchar) limit 5)")
def v15(spark, d):
    v, e = _vectors(spark, d), _timed_vectors(spark, d)
    block = F.floor(F.col("id").cast("long") / 50)  # a task's activities: the odd ones of its fifty
    odd = v.filter(F.col("id").cast("long") % 2 == 1).groupBy(block.alias("block")).agg(F.collect_list("id").alias("activity_ids"))
    t = v.filter("label = 2").withColumn("title", F.col("id")).withColumn("block", block).join(odd, "block")
    out = api.contextual_search(e, t, _vector(spark, d, 7))
    return out.select("kind", F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


# ---- what users ask for most ----


def _runs(base: str, threshold: float) -> list[str]:
    """Lines of ``base`` (rows of ev) newest first, runs of like vectors as their last row: ``{base}_lines``."""
    return [
        f"{base}_pos as (select *, row_number() over (order by timestamp desc, id desc) as pos from {base})",
        f"{base}_isl as (select *, sum(case when list_cosine_similarity(pe::double[], embedding::double[]) >= {threshold} then 0 else 1 end) over (partition by event_type order by pos rows unbounded preceding) as island from (select *, lag(embedding) over (partition by event_type order by pos) as pe from {base}_pos where embedding is not null))",
        f"{base}_lines as (select id, pos, {_FULL} as line from (select arg_max(id, pos) as run, min(pos) as first_pos from {base}_isl group by event_type, island) join (select * exclude (pos) from {base}_pos) on id = run, lateral (select first_pos as pos) union all select id, pos, {_FULL} as line from {base}_pos where embedding is null)",
    ]


LAST = "lately as (select * from ev where timestamp >= timestamp '2024-01-03 12:00:00' - interval 15 minute order by timestamp desc, id limit 500)"
HOURS3 = "hours3 as (select * from ev where timestamp >= timestamp '2024-01-04 00:00:00' - interval 3 hour and app = 'app1' order by timestamp desc, id limit 1000)"


@query("e1_working_memory", "select id, pos, line from lately_lines", EV, LAST, *_runs("lately", 0.0))
def e1(spark, d):
    m = api.working_memory(events(spark, d, vectors=True), F.to_timestamp(F.lit("2024-01-03 12:00:00")), threshold=0.0)
    return m.select("id", F.col("pos").cast("long").alias("pos"), "line")


@query("e1_recent_activity", "select id, pos, line from hours3_lines", EV, HOURS3, *_runs("hours3", 0.0))
def e1b(spark, d):
    m = api.recent_activity(events(spark, d, vectors=True), F.to_timestamp(F.lit("2024-01-04 00:00:00")), app="app1", threshold=0.0)
    return m.select("id", F.col("pos").cast("long").alias("pos"), "line")


_FTS = "select id, raw_content || ' ' || coalesce(summary, '') || ' ' || app || ' ' || title || ' ' || coalesce(gist, '') as text from found"
_COS_E = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7))"


@query("e2_search_activity", f"select id, round(s + 0.02 * exp(-{_AGE} / 30), 6) as score, {_DETAIL} as text from fused join found using (id) order by s + 0.02 * exp(-{_AGE} / 30) desc, id limit 10", EV, "found as (select * from ev where app = 'app2')", *_bm25("e", _FTS, ("gist", "python", "debug")), f"fused as (select id, sum(1.0::double / (60 + r)) as s from (select * from (select id, row_number() over (order by {_COS_E} desc, id) as r from found where embedding is not null and {_COS_E} >= 0.01) where r <= 40 union all select * from (select id, row_number() over (order by score desc, id) as r from ebm) where r <= 40) group by id order by s desc, id limit 40)")
def e2(spark, d):
    out = api.search_activity(events(spark, d, vectors=True), "gist python debug", _vector(spark, d, 7), now(), where=EventFilter(app="app2"), floor=0.01)
    return out.select("id", F.round("score", 6).alias("score"), "text")


# ---- temporal graph ----

GSESS = "gs as (select *, 'session:' || source || ':' || session as session_id from (select *, sum(case when epoch_us(timestamp) // 1000000 - epoch_us(prev) // 1000000 <= 600 then 0 else 1 end) over (partition by source order by timestamp, id rows unbounded preceding)::bigint as session from (select *, lag(timestamp) over (partition by source order by timestamp, id) as prev from ev)))"
GEDGES = "ge as (select id as src_id, session_id as dst_id, 'DURING' as type from gs union all select id, 'app:' || app, 'ON_APP' from gs union all select id, 'window:' || sha256(app || '|' || title), 'IN_WINDOW' from gs union all select id, 'project:' || project, 'IN_PROJECT' from gs where project is not null union all select id, 'url:' || sha256(json_extract_string(raw_content, '$.url')), 'VISITED' from gs where event_type = 'browser' union all select id, 'file:' || unnest(json_extract_string(raw_content, '$.files_changed[*]')), 'MODIFIED' from gs where event_type = 'git_commit' union all select id, nxt, 'FOLLOWED_BY' from (select id, lead(id) over (partition by session_id order by timestamp, id) as nxt from gs) where nxt is not null)"


def _sessions(spark, d) -> DataFrame:
    return temporal_graph.with_sessions(events(spark, d), ["source"])


@query("g1_edges", "select distinct src_id, dst_id, type from ge", EV, GSESS, GEDGES)
def g1(spark, d):
    return temporal_graph.edges(_sessions(spark, d), ["source"])


@query("g2_latest_nodes", "select 'app:' || app as id, arg_max(title, (timestamp, id)) as title from ev group by 1", EV)
def g2(spark, d):
    from .schema import latest

    n = events(spark, d).select(F.concat(F.lit("app:"), "app").alias("id"), F.create_map(F.lit("title"), F.col("title")).alias("props"), F.col("timestamp").alias("ts"), F.col("id").alias("v"))
    return latest(n, ["id"], "ts", "v").select("id", F.col("props")["title"].alias("title"))


@query("j13_nearest_all", "select a.id, a.source, e.id as nearest_id, abs(epoch_us(e.timestamp) // 1000000 - epoch_us(a.timestamp) // 1000000) as seconds from (select * from ev where event_type = 'git_commit') a left join (select * from ev where event_type = 'browser') e on e.source = a.source qualify row_number() over (partition by a.id order by abs(epoch_us(e.timestamp) // 1000000 - epoch_us(a.timestamp) // 1000000), e.timestamp, e.id) = 1", EV)
def j13_all(spark, d):
    """For every purchase the nearest click of its user."""
    e = events(spark, d)
    return asof.nearest_in_time(e.filter("event_type = 'git_commit'"), e.filter("event_type = 'browser'"), ["source"]).select("id", "source", "nearest_id", "seconds")


@query("j13_nearest_stream", "select a.id, e.id as nearest_id, abs(epoch_us(e.timestamp) // 1000000 - epoch_us(a.timestamp) // 1000000) as seconds from (select * from ev where event_type = 'git_commit') a left join (select * from ev where event_type = 'terminal') e on true qualify row_number() over (partition by a.id order by abs(epoch_us(e.timestamp) // 1000000 - epoch_us(a.timestamp) // 1000000), e.timestamp, e.id) = 1", EV)
def j13_stream(spark, d):
    """The same for a single key that has all rows, in blocks of an hour."""
    e = events(spark, d)
    return asof.nearest_in_time(e.filter("event_type = 'git_commit'"), e.filter("event_type = 'terminal'"), [], 3600).select("id", "nearest_id", "seconds")


@query("w1_sessions_blocks", ORACLE_SQL["w1_sessions"])
def w1_blocks(spark, d):
    return asof.long_sessions(events(spark, d), ["user_id"], 21600, width=7 * 86400).select("id", "session")


@query("w1_stream_blocks", ORACLE_SQL["w1_global_sessions"])
def w1_stream(spark, d):
    """All rows under one key, in blocks of an hour."""
    return asof.long_sessions(events(spark, d), [], width=3600).select("id", "session")


@query("w3_focus_blocks", ORACLE_SQL["w3_focus_runs"])
def w3_blocks(spark, d):
    r = asof.long_focus_runs(events(spark, d), ["source"], ["app"])
    return r.select("source", "app", ts("start").alias("start"), "duration_seconds")


@query("w4_duration_blocks", ORACLE_SQL["w4_row_durations"])
def w4_blocks(spark, d):
    return asof.long_row_durations(events(spark, d), ["source"], now()).select("id", "duration_seconds")


@query("g3_anchor", f"select id, {sts()} as ts from ev order by timestamp desc, id limit 1", EV)
def g3(spark, d):
    return temporal_graph.anchor(events(spark, d)).select("id", ts().alias("ts"))


@query("g5_session_apps", "select session_id, string_agg(app, ',' order by app) as apps from (select distinct session_id, 'app:' || app as app from gs) group by session_id", EV, GSESS)
def g5(spark, d):
    s = temporal_graph.session_apps(temporal_graph.edges(_sessions(spark, d), ["source"]))
    return s.select("session_id", joined("apps").alias("apps"))


@query("g6_connected", "select id from ev where event_type = 'git_commit' and list_contains(json_extract_string(raw_content, '$.files_changed[*]'), 'src/f3.py')", EV)
def g6(spark, d):
    return api.connected(events(spark, d), ["source"], file="src/f3.py").select("id")


@query("g7_context", "select id, step from (select *, n - max(case when id = aid then n end) over () as step from (select gs.*, a.id as aid, row_number() over (order by gs.timestamp, gs.id) as n from gs join a on a.session_id = gs.session_id)) where step between -3 and 3", EV, GSESS, "a as (select id, session_id from gs where app = 'app3' order by abs(epoch_us(timestamp) // 1000000 - epoch_us(timestamp '2024-01-15 12:00:00') // 1000000), timestamp, id limit 1)")
def g7(spark, d):
    c = api.activity_context(events(spark, d), ["source"], "app3", F.to_timestamp(F.lit("2024-01-15 12:00:00")))
    return c.select("id", F.col("step").cast("long").alias("step"))


@query("g8_session_report", "select id, (select string_agg(distinct app, ',' order by app) from gs where session_id = (select session_id from a)) as apps from gs where session_id = (select session_id from a)", EV, GSESS, "a as (select id, session_id from gs where app = 'app2' order by timestamp desc, id limit 1)")
def g8(spark, d):
    return api.session_report(events(spark, d), ["source"], "app2").select("id", joined("apps").alias("apps"))


# ---- entities ----

RELS = "rels as (select distinct 'u' || user_id as a, 'k' || (k % 97) as b from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)), sym as (select a, b from rels union select b, a from rels)"


def _relations(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 97
    return read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_entity_id"), F.concat(F.lit("k"), k.cast("string")).alias("target_entity_id"))


@query("g9_bfs2", "select id, min(depth) as depth from (select b as id, 1 as depth from sym where a = 'u3' union all select y.b, 2 from sym x join sym y on y.a = x.b where x.a = 'u3') where id <> 'u3' group by id", RELS)
def g9(spark, d):
    return entity_graph.neighbours(_relations(spark, d), spark.createDataFrame([("u3",)], "id string"), 2)


_MENTION = "select case when k % 3 = 0 then 'Alpha' when k % 3 = 1 then 'ALPHA' else 'beta' || (k % 5) end as name, case when k % 2 = 0 then 'project' else 'tool' end as type, (k % 10) / 10.0 as confidence, ts from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


@query("g10_entity_rollup", f"select lower(name) as name, type, count(*) as mention_count, round(max(confidence), 6) as confidence, string_agg(distinct name, ',' order by name) as aliases, {sts('min(ts)')} as first_seen, {sts('max(ts)')} as last_seen from ({_MENTION}) group by 1, 2")
def g10(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    m = read(spark, d, "events").select(F.when(k % 3 == 0, "Alpha").when(k % 3 == 1, "ALPHA").otherwise(F.concat(F.lit("beta"), (k % 5).cast("string"))).alias("name"), F.when(k % 2 == 0, "project").otherwise("tool").alias("type"), (k % 10 / 10.0).alias("confidence"), F.col("ts").cast("timestamp").alias("timestamp"))
    return entity_graph.merged_entities(m).select("name", "type", "mention_count", F.round("confidence", 6).alias("confidence"), joined("aliases").alias("aliases"), ts("first_seen").alias("first_seen"), ts("last_seen").alias("last_seen"))


@query("g12_relationship_strength", "select 'u' || user_id as source_entity_id, event_type as target_entity_id, round(1.0::double + 0.1::double * (count(*) - 1), 6) as strength from events group by 1, 2")
def g12(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_entity_id"), F.col("event_type").alias("target_entity_id"), F.lit("USES").alias("type"), F.lit(0.7).alias("confidence"), F.col("ts").alias("timestamp"))
    return entity_graph.merged_relations(e).select("source_entity_id", "target_entity_id", F.round("strength", 6).alias("strength"))


@query("g13_entity_search", "select id, depth from (select 'u3' as id, 0 as depth union all select id, min(depth) from (select b as id, 1 as depth from sym where a = 'u3' union all select y.b, 2 from sym x join sym y on y.a = x.b where x.a = 'u3') where id <> 'u3' group by id) order by depth, id limit 10", RELS)
def g13(spark, d):
    r = _relations(spark, d)
    e = r.select(F.col("source_entity_id").alias("id")).union(r.select("target_entity_id")).distinct().withColumn("name", F.upper("id"))
    return entity_graph.search_entities(e, r, "U3").select("id", "depth")


_LISTS = "[" + ", ".join(f"'{x}'" for x in entity_graph.TECHNOLOGIES) + "]", "[" + ", ".join(f"'{x}'" for x in entity_graph.CONCEPTS) + "]"


@query("g14_entity_rules", f"select name, type, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(list_filter({_LISTS[0]}, lambda x: contains(lower(text), x))) as name, 'technology' as type from documents union all select doc_id, unnest(list_filter({_LISTS[1]}, lambda x: contains(lower(text), x))), 'concept' from documents) group by 1, 2")
def g14(spark, d):
    e = entity_graph.rule_entities(documents(spark, d)).filter("type <> 'project'")
    return e.groupBy("name", "type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"))


_SKIP = "(" + ", ".join(f"'{x}'" for x in entity_graph.NO_NAMES) + ")"


@query("g14_names", r"select name, count(*) as n from (select unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{2,}$'))) as name from documents) where name not in " + _SKIP + " group by name")
def g14n(spark, d):
    e = entity_graph.rule_entities(documents(spark, d)).filter("type = 'project'")
    return e.groupBy("name").agg(F.count("*").alias("n"))


@query("u6_model_entities", f"select id, name, count(*) as n from (select doc_id as id, unnest(list_concat(list_filter({_LISTS[0]}, lambda x: contains(lower(text), x)), list_filter({_LISTS[1]}, lambda x: contains(lower(text), x)))) as name from documents union all select doc_id, 'Vision' from documents) group by 1, 2")
def u6(spark, d):
    """All technologies and concepts by rule, and what a model adds that no rule has found in any case."""
    t = documents(spark, d)
    rule = entity_graph.rule_entities(t).filter("type <> 'project'")
    model = t.select("id", F.explode(F.array(F.lit("Vision"), F.when(F.lower("text").contains("api"), F.lit("API")))).alias("name")).filter("name is not null").select("id", "name", F.lit("concept").alias("type"), F.lit(0.8).alias("confidence"))
    return entity_graph.with_model_entities(rule, model).groupBy(F.col("id").cast("long").alias("id"), "name").agg(F.count("*").alias("n"))


# ---- tasks ----

_GROUP = "select *, row_number() over (partition by source order by timestamp, id) as n from ev"


@query("k3_task_from_cluster", f"select source, mode_c as category, mode_p as project, {sts('a')} as start, {sts('b')} as stop, cast(floor((epoch_us(b) - epoch_us(a)) / 60000000) as double) as minutes, n as activity_count, case when b < timestamp '2024-01-30 00:00:00' - interval 1 hour then 'completed' else 'active' end as status from (select source, min(timestamp) as a, max(timestamp) as b, count(*) as n from ev group by source) left join (select source, category as mode_c from (select source, category, row_number() over (partition by source order by count(*) desc, category) as r from ev where category is not null group by 1, 2) where r = 1) using (source) left join (select source, project as mode_p from (select source, project, row_number() over (partition by source order by count(*) desc, project) as r from ev where project is not null group by 1, 2) where r = 1) using (source)", EV)
def k3(spark, d):
    t = task_ops.build_tasks(events(spark, d, vectors=True), ["source"], F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    return t.select("source", "category", "project", ts("start_time").alias("start"), ts("end_time").alias("stop"), F.col("duration_minutes").alias("minutes"), F.col("activity_count").cast("long").alias("activity_count"), "status")


@query("k4_fallback", f"select source, string_agg(t, '; ' order by n) as description, left(min(case when n = 1 then t end), 50) as title from (select source, left(coalesce(summary, raw_content), 120) as t, n from ({_GROUP})) where n <= 3 group by source", EV)
def k4(spark, d):
    return task_ops.fallback_analysis(events(spark, d), ["source"]).select("source", "description", "title")


@query("k9_rule_category", "select id, case event_type when 'git_commit' then 'Coding' when 'terminal' then (case when contains(lower(raw_content), 'test') or contains(lower(raw_content), 'debug') then 'Debugging' else 'Coding' end) when 'note' then 'Writing' else 'Other' end as category from ev", EV)
def k9(spark, d):
    return events(spark, d).select("id", X.rule_category().alias("category"))


@query("k8_complete_task", "select id, case when id = '1' then 'completed' else status end as status from tasks", TASKS)
def k8(spark, d):
    return task_ops.completed(tasks(spark, d), "1", now()).select("id", "status")


@query("k10_pending_hours", "select strftime(date, '%Y-%m-%d') as date, h as hour from (select distinct date, hour(timestamp) as h from ev where (date = date '2024-01-29' or (date = date '2024-01-30' and hour(timestamp) < 5))) where h not in (0, 2) order by date, h limit 4", EV)
def k10(spark, d):
    done = spark.createDataFrame([("2024-01-29", 0), ("2024-01-29", 2), ("2024-01-30", 0), ("2024-01-30", 2)], "date string, hour int").withColumn("date", F.to_date("date"))
    p = task_ops.pending_hours(events(spark, d), done, F.to_timestamp(F.lit("2024-01-30 05:30:00")))
    return p.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("hour").cast("long").alias("hour"))


DAYS = f"days as (select * from ev where date < date '{NOW[:10]}')"
UNLIKE = f"unlike as (select max_id as id, date as grp, date, project, timestamp, embedding::double[] as e from (select arg_max(id, (timestamp, id)) as max_id from days group by date, event_type, {_KEY}) join days on id = max_id)"
TOGETHER = "together as (select id, strftime(date, '%Y-%m-%d') || coalesce('/' || project, '') as grp, date, timestamp, e from unlike_kept_rows where e is not null)"


@query("k1_compact_days", "select strftime(a.date, '%Y-%m-%d') as date, a.n as event_count, coalesce(b.n, 0) as kept_count, coalesce(c.n, 0) as task_count from (select date, count(*) as n from days group by date) a left join (select date, count(*) as n from unlike_kept_rows group by date) b on b.date = a.date left join (select date, count(distinct grp || '/' || c || '/' || block) as n from together_block group by date) c on c.date = a.date", EV, DAYS, UNLIKE, *_greedy("unlike", 0.95), TOGETHER, *_clusters("together"), *_in_blocks("together"))
def k1(spark, d):
    r = compaction.compact(events(spark, d, vectors=True), now(), threshold=1 - 1.15).report
    return r.withColumn("date", F.date_format("date", "yyyy-MM-dd")).select("date", "event_count", "kept_count", "task_count")


# ---- incremental forms, in batch ----


@query("q_chunks_of", r"select doc_id, count(*) as chunks, sum(words)::bigint as words from (select doc_id, unnest(case when n <= 409 then [n] else list_transform(range(0, n - 100, 309), lambda s: least(409, n - s)) end) as words from (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) as n from documents)) group by doc_id")
def q_chunks_of(spark, d):
    """A table function in SQL: all documents in chunks."""
    sql.register(spark, events(spark, d), ["user_id"])
    read(spark, d, "documents").createOrReplaceTempView("texts")
    return spark.sql("select doc_id, count(*) as chunks, sum(case when chunk = '' then 0 else size(split(chunk, ' ')) end) as words from texts, lateral chunks_of(text, 409, 100) group by doc_id")


@query("q_entities_of", f"select name, type, count(*) as n from (select unnest(list_filter({_LISTS[0]}, lambda x: contains(lower(text), x))) as name, 'technology' as type from documents union all select unnest(list_filter({_LISTS[1]}, lambda x: contains(lower(text), x))), 'concept' from documents) group by 1, 2")
def q_entities_of(spark, d):
    sql.register(spark, events(spark, d), ["user_id"])
    read(spark, d, "documents").createOrReplaceTempView("texts")
    return spark.sql("select name, type, count(*) as n from entities_of(table(select doc_id, text from texts)) group by name, type")


@query("q_tools", "select 'recent' as tool, count(*) as n from ev where timestamp > timestamp '2024-01-05 06:00:00' and timestamp <= timestamp '2024-01-05 09:00:00' union all select 'hours', count(distinct hour(timestamp)) from ev where date = date '2024-01-06' union all select 'apps', count(distinct app) from ev where timestamp > timestamp '2024-01-05 06:00:00' and timestamp <= timestamp '2024-01-05 09:00:00' union all select 'connected', count(*) from ev where app = 'app3'", EV)
def q_tools(spark, d):
    """Tools called in SQL."""
    sql.register(spark, events(spark, d), ["user_id"])
    three = "timestamp '2024-01-05 06:00:00', timestamp '2024-01-05 09:00:00'"
    calls = {"recent": f"recent_activity({three})", "hours": "activity_hours(date '2024-01-06')", "apps": f"activity_apps({three})", "connected": "connected_to('app:app3')"}
    return spark.sql(" union all ".join(f"select '{k}' as tool, count(*) as n from {f}" for k, f in calls.items()))


@query("r8_chunk_fanout", r"select doc_id, case when n <= 409 then 1 else cast(ceil((n - 409) / 309.0) as bigint) + 1 end as chunks from (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) as n from documents)")
def r8(spark, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return read(spark, d, "documents").select("doc_id", F.size(X.chunks(w)).cast("long").alias("chunks"))


@query("r9_debounce", "select id from (select *, lead(timestamp) over (partition by source order by timestamp, id) as nxt from ev) where nxt is null or epoch_us(nxt) - epoch_us(timestamp) >= 3600000000", EV)
def r9(spark, d):
    t = events(spark, d).withColumn("type", F.lit("app_switch"))
    return sequence.debounced(t, ["source"], 3600).select("id")


@query("r11_idle_edges", "select id, case when now_idle then 'WentIdle' else 'Resumed' end as edge from (select *, lag(now_idle, 1, false) over (partition by source order by timestamp, id) as was from (select *, k % 100 >= 60 as now_idle from ev)) where was <> now_idle", EV)
def r11(spark, d):
    k = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), (F.get_json_object("props", "$.k").cast("long") % 100).alias("idle"))
    return sequence.idle_edges(events(spark, d).join(k, "id"), ["source"], 60).select("id", "edge")


@query("r12_trigger_routing", "select id, case app when 'app0' then 'Full' when 'app1' then 'Medium' when 'app2' then 'None' else 'Light' end as depth from ev where app <> 'app4'", EV)
def r12(spark, d):
    kind = F.create_map(*(F.lit(x) for x in ("app0", "app_switch", "app1", "title_change", "app2", "screen_lock", "app3", "poll_tick", "app4", "unknown")))[F.col("app")]
    lines = events(spark, d).select(F.to_json(F.struct(kind.alias("type"), F.col("id").alias("window_title"))).alias("value"))
    return logs.parsed_triggers(lines, now()).select(F.col("window_title").alias("id"), "depth")


@query("r10_background_polls", "select source, epoch_us(a) // 1000000 + 7200 * i as at from (select source, timestamp as a, unnest(generate_series(1, (epoch_us(nxt) - epoch_us(timestamp) - 1) // 7200000000)) as i from (select source, timestamp, lead(timestamp) over (partition by source order by timestamp) as nxt from ev) where nxt is not null)", EV)
def r10(spark, d):
    p = sequence.background_polls(events(spark, d), ["source"], 7200)
    return p.select("source", F.floor(F.unix_micros("timestamp") / 1_000_000).cast("long").alias("at"))


@query("k2_sweep_days", "select strftime(date, '%Y-%m-%d') as date, count(*) as n from ev where date < date '2024-01-20' and date >= date '2024-01-13' group by date", EV)
def k2(spark, d):
    e = compaction.last_days(events(spark, d), F.to_timestamp(F.lit("2024-01-20 10:00:00")))
    return e.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))


@query("k11_day_overview", "select strftime(date, '%Y-%m-%d') as date, 'On ' || strftime(date, '%B %d, %Y') || ' there were ' || total || ' events' || case when top_categories <> '' then ', mostly ' || replace(top_categories, ',', ', ') else '' end || case when top_projects <> '' then '; projects: ' || replace(top_projects, ',', ', ') else '' end || '.' as overview from daily", EV, DAILY)
def k11(spark, d):
    return rollup.daily_summary(events(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), task_ops.day_overview().alias("overview"))


@query("k11_category_texts", "select strftime(date, '%Y-%m-%d') as date, coalesce(category, 'Other') as category, 'Completed ' || count(*) || ' ' || coalesce(category, 'Other') || ' activities.' as narrative from ev group by date, coalesce(category, 'Other')", EV)
def k11c(spark, d):
    return prompts.category_texts(events(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "category", "narrative")


@query("k11_task_texts", "select id, title || ' — ' || coalesce(description, '') as narrative from tasks", TASKS)
def k11t(spark, d):
    return prompts.narrated(tasks(spark, d), "task_summary").select("id", "narrative")


@query("k11_day_texts", "select strftime(d, '%Y-%m-%d') as date, strftime(d, '%B %d, %Y') || ' — ' || n || ' tasks, ' || c || '/' || n || ' completed, ' || printf('%.1f', m / 60.0) || 'h total.' as narrative from (select cast(start_time as date) as d, count(*) as n, count(*) filter (where status = 'completed') as c, sum(duration_minutes)::double as m from tasks group by 1)", TASKS)
def k11d(spark, d):
    return prompts.day_texts(tasks(spark, d)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "narrative")


@query("k12_requests", "select id, 'In one sentence, sum up the task ' || title || ' (' || status || ', ' || coalesce(category, '') || ', ' || (duration_minutes::bigint) || '.0 minutes,  activities): ' || description as request from tasks", TASKS)
def k12(spark, d):
    return tasks(spark, d).select("id", prompts.request("task_summary").alias("request"))


@query("j18_resolved_relations", "select distinct 'u' || user_id as id, 'k' || (k % 5) as source, 't' || event_type as target from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) where user_id % 2 = 0 and k % 5 < 3")
def j18(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") % 5
    r = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("k"), k.cast("string")).alias("source"), F.concat(F.lit("t"), F.col("event_type")).alias("target"), F.lit("uses").alias("type")).distinct()
    names = r.filter(F.substring("id", 2, 9).cast("long") % 2 == 0)
    names = names.select("id", F.col("source").alias("name")).filter(F.col("name").isin("k0", "k1", "k2")).union(names.select("id", "target"))
    e = names.distinct().withColumn("type", F.lit("concept")).withColumn("entity_id", entity_graph.entity_id())
    return entity_graph.resolved(r, e).select("id", "source", "target")


@query("v16_reembed", "select id, len(string_split(coalesce(summary, raw_content), ' '))::double as words, 1::bigint as width from ev where date = date '2024-01-10'", EV)
def v16(spark, d):
    e = api.reembed(events(spark, d), lambda texts: [[float(len(t.split(" ")))] for t in texts], "2024-01-10")
    return e.select("id", F.col("embedding")[0].cast("double").alias("words"), F.size("embedding").cast("long").alias("width"))


@query("s21_task_files", "select strftime(cast(start_time as date), '%Y-%m-%d') as date, count(*) as n from tasks group by 1", TASKS)
def s21(spark, d):
    return sinks.dated(tasks(spark, d)).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))


# ---- raw logs, written from events: event i is i minutes after the first of January ----

TICK = "tick as (select event_id as id, user_id as u, cast(json_extract_string(props, '$.k') as bigint) as k, 1704067200 + event_id * 60 as s, make_timestamp((1704067200 + event_id * 60) * 1000000) as tm from events)"


def _ticks(spark, d) -> DataFrame:
    s = F.lit(1704067200) + F.col("event_id") * 60
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k"), s.alias("s"), F.timestamp_seconds(s).alias("timestamp"))


_SINCE = "2024-01-02 00:00:00"


def _zsh(spark, d) -> DataFrame:
    line = F.expr("case k % 5 when 0 then 'plain ' || k when 1 then ': bad:0;x' when 2 then ': ' || s || ':0;' else ': ' || s || ':0; make ' || k || '; ls' end")
    return history.zsh_lines(_ticks(spark, d).select(line.alias("value")), F.to_timestamp(F.lit(_SINCE)))


def _bash(spark, d) -> DataFrame:
    line = F.expr("case k % 4 when 0 then '#' || s when 1 then ' ' else ' run ' || k end")
    files = _ticks(spark, d).groupBy("u").agg(F.max("timestamp").alias("timestamp"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return history.bash_texts(files, 20)


ZSH = f"zsh as (select tm, 'make ' || k || '; ls' as command from tick where k % 5 >= 3 and tm >= timestamp '{_SINCE}')"
BASH = "bash as (select m as tm, 'run ' || k as command from (select *, row_number() over (partition by u order by id desc) as r from tick where k % 4 >= 2) join (select u, max(tm) as m from tick group by u) using (u) where r <= 20)"


@query("s5_zsh", f"select {sts('tm')} as ts, command, 'zsh' as shell from zsh", TICK, ZSH)
def s5(spark, d):
    return _zsh(spark, d).select(ts().alias("ts"), "command", "shell")


@query("s6_bash", f"select {sts('tm')} as ts, command, 'bash' as shell from bash", TICK, BASH)
def s6(spark, d):
    return _bash(spark, d).select(ts().alias("ts"), "command", "shell")


@query("s7_fish", f"select case when k % 3 = 0 then {sts('tm')} else '{NOW}' end as ts, case when k % 3 = 0 then 'ls ' || k else 'pwd' end as command, 'fish' as shell from tick where k % 3 < 2", TICK)
def s7(spark, d):
    block = F.expr("case k % 3 when 0 then 'ls ' || k || chr(10) || '  when: ' || s || chr(10) when 1 then 'pwd' || chr(10) else '' end")
    return history.fish_blocks(_ticks(spark, d).select(block.alias("value")), now()).select(ts().alias("ts"), "command", "shell")


@query("s8_terminal_union", f"select shell as source, {sts('tm')} as ts, command, length(command) as command_length, row_number() over (partition by shell, tm, command) as n from (select *, 'zsh' as shell from zsh union all select *, 'bash' from bash)", TICK, ZSH, BASH)
def s8(spark, d):
    e = history.terminal_events(history.union([_zsh(spark, d), _bash(spark, d)]))
    command = F.get_json_object("raw_content", "$.command")
    e = e.select("id", "source", "timestamp", command.alias("command"), F.col("metadata")["command_length"].cast("long").alias("command_length"))
    n = F.row_number().over(Window.partitionBy("source", "timestamp", "command").orderBy("id"))
    return e.dropDuplicates(["id"]).select("source", ts().alias("ts"), "command", "command_length", n.cast("long").alias("n"))


@query("s9_commits", f"select 'p' || g as project, {sts('tm')} as ts, 'fix ' || k as message, 'src/f' || k || '.py' as files, '' || k as lines_changed from (select *, u % 7 as g, row_number() over (partition by u % 7 order by tm desc) as r from tick) where r <= 50", TICK)
def s9(spark, d):
    t = _ticks(spark, d).select("timestamp", F.expr("'/code/p' || u % 7 || '/'").alias("repo"), F.expr("'h' || id").alias("hash"), F.expr("'fix ' || k").alias("message"), F.expr("array('src/f' || k || '.py')").alias("files_changed"), F.col("k").cast("int").alias("lines_changed"), F.lit(None).cast("string").alias("diff"))
    e = logs.commit_events(t)
    return e.select("project", ts().alias("ts"), F.get_json_object("raw_content", "$.message").alias("message"), joined("files_changed").alias("files"), F.col("metadata")["lines_changed"].alias("lines_changed"))


@query("s10_repositories", "select 'a/b' || c_custkey as repo from customer where c_custkey % 5 = 0")
def s10(spark, d):
    path = F.expr("case c_custkey % 5 when 0 then 'a/b' || c_custkey || '/.git' when 1 then 'node_modules/x' || c_custkey || '/.git' when 2 then 'a/b/c/d' || c_custkey || '/.git' when 3 then '.cache/r' || c_custkey || '/.git' else 'a/f' || c_custkey || '/src' end")
    return logs.repositories(read(spark, d, "customer").select(path.alias("path")))


_STAGED = "case k % 3 when 0 then ['a.py', 'b.py'] when 1 then ['b.py', 'c.py'] else []::varchar[] end"


@query("s11_staging", f"select 'r' || u as project, {sts('tm')} as ts, concat_ws('; ', case when len(a) > 0 then 'Staged: ' || array_to_string(a, ', ') end, case when len(r) > 0 then 'Unstaged: ' || array_to_string(r, ', ') end) as raw_content from (select *, list_filter(now_, lambda x: not list_contains(was, x)) as a, list_filter(was, lambda x: not list_contains(now_, x)) as r from (select *, coalesce(lag(now_) over (partition by u order by tm), []) as was from (select *, {_STAGED} as now_ from tick))) where len(a) + len(r) > 0", TICK)
def s11(spark, d):
    staged = F.expr("case k % 3 when 0 then array('a.py', 'b.py') when 1 then array('b.py', 'c.py') end")
    e = logs.staging_events(_ticks(spark, d).select("timestamp", F.expr("'/home/r' || u").alias("repo"), staged.alias("staged")))
    return e.select("project", ts().alias("ts"), "raw_content")


@query("s12_window_runs", f"select u as user_id, {sts('tm')} as ts, 'app' || w || ' — Doc ' || w as raw_content, '' || (nxt - s) as seconds from (select *, lead(s) over (partition by u order by s) as nxt from (select *, lag(w) over (partition by u order by s) as p from (select *, k % 2 as w from tick where k % 5 <> 0)) where p is null or p <> w) where nxt is not null", TICK)
def s12(spark, d):
    log = _ticks(spark, d).select(F.col("u").alias("user_id"), "timestamp", F.expr("case when k % 5 = 0 then '' else 'app' || k % 2 end").alias("app"), F.expr("'Doc ' || k % 2").alias("title"))
    return logs.window_events(log, ["user_id"]).select("user_id", ts().alias("ts"), "raw_content", F.col("metadata")["duration_seconds"].alias("seconds"))


@query("s13_screen_rows", f"select u as user_id, {sts('tm')} as ts, md5('Editor — Doc ' || k || ': ' || t) as raw_content, '' || (coalesce(lead(s) over (partition by u order by s), 1893456000) - s) as seconds from (select *, repeat('word ' || k || ' ', (k % 20)::int) as t from tick where k % 6 > 1 and k % 7 <> 0) where strlen(t) >= 60", TICK)
def s13(spark, d):
    app, title = "case k % 6 when 0 then 'Finder' when 1 then '1Password' else 'Editor' end", "case k % 7 when 0 then 'Private Browsing' else 'Doc ' || k end"
    log = _ticks(spark, d).select(F.col("u").alias("user_id"), "timestamp", F.expr(app).alias("app_name"), F.expr(title).alias("window_title"), F.expr("repeat('word ' || k || ' ', int(k % 20))").alias("raw_text"), F.lit("ocr").alias("raw_text_source"), F.lit(None).cast("string").alias("gist"))
    e = logs.screen_events(log, F.to_timestamp(F.lit("2030-01-01 00:00:00")), ["user_id"])
    return e.select("user_id", ts().alias("ts"), F.md5("raw_content").alias("raw_content"), F.col("metadata")["duration_seconds"].alias("seconds"))


@query("s16_imported_points", f"select 'i' || id as id, {sts('tm')} as ts, case k % 4 when 0 then 'browser' when 2 then 'terminal' else 'window' end as event_type, case when k % 2 = 0 then 'text ' || k else '' end as raw_content, 'x' || k % 3 as extra, 2::bigint as width from tick where k % 9 <> 0", TICK)
def s16(spark, d):
    payload = "map('timestamp', case when k % 9 = 0 then 'never' else date_format(timestamp, 'yyyy-MM-dd HH:mm:ss') end, 'event_type', case k % 4 when 0 then 'Browser' when 1 then 'bogus' end, 'type', case when k % 4 = 2 then 'terminal' end, 'content', case when k % 2 = 0 then 'text ' || k end, 'extra', 'x' || k % 3)"
    p = logs.points(_ticks(spark, d).select(F.expr("'i' || id").alias("id"), F.expr("array(float(k), 0f)").alias("vector"), F.expr(payload).alias("payload")))
    return p.select("id", ts().alias("ts"), "event_type", "raw_content", F.col("metadata")["extra"].alias("extra"), F.size("embedding").cast("long").alias("width"))


@query("s25_layout", "select u as user_id, case when length(text) >= 30 then left(text, 4000) end as text from (select u, string_agg(l, chr(10) order by y, part) as text from (select u, y, part, string_agg(t, '  ' order by x, t) as l from (select *, sum(far) over (partition by u, y order by x, t rows unbounded preceding) as part from (select *, case when x - lag(x + 5) over (partition by u, y order by x, t) > gap then 1 else 0 end as far from (select *, greatest(100, (max(x + 5) over (partition by u) - min(x) over (partition by u)) * 0.3) as gap from (select u, 'w' || id as t, id % 4 as y, (id % 1000) * 10 as x from tick)))) group by u, y, part) group by u)", TICK)
def s25(spark, d):
    n = _ticks(spark, d).select(F.col("u").alias("user_id"), F.expr("'w' || id").alias("text"), F.expr("double(id % 4 * 100)").alias("y"), F.expr("double(id % 1000 * 10)").alias("x"), F.lit(5.0).alias("width"), F.lit(20.0).alias("height"))
    return logs.laid_out(n, ["user_id"])


# ---- small functions ----


@query("p12_long_enough", "select id from (select *, k % 40 as n, case k % 3 when 0 then 'window' when 1 then 'screen' else 'note' end as kind from tick) where case kind when 'window' then n >= 30 when 'screen' then n >= 4 else true end", TICK)
def p12(spark, d):
    e = _ticks(spark, d).select("id", (F.col("k") % 40).alias("duration_seconds"), F.expr("case k % 3 when 0 then 'window' when 1 then 'screen' else 'note' end").alias("event_type"))
    return filters.long_enough(e).select("id")


@query("f7_hhmm", "select id, case when k % 4 = 0 then '??:??' else strftime(tm, '%Y-%m-%d %H:%M') end as t from tick", TICK)
def f7(spark, d):
    iso = F.when(F.col("k") % 4 == 0, "2024-01-01").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    return _ticks(spark, d).select("id", X.hhmm(iso).alias("t"))


@query("f10_shaped_events", f"select id, {sts()} as ts, event_type, project, category, coalesce(summary, left(raw_content, 200)) as text from ev", EV)
def f10(spark, d):
    return api.shaped_events(events(spark, d)).withColumn("ts", ts()).drop("timestamp")


@query("f10_shaped_tasks", f"select id, title, description, status, category, project, {sts('start_time')} as start, duration_minutes::double as minutes from tasks", TASKS)
def f10t(spark, d):
    t = api.shaped_tasks(tasks(spark, d))
    return t.select("id", "title", "description", "status", "category", "project", ts("start_time").alias("start"), F.col("duration_minutes").alias("minutes"))


@query("sc_last_sentence", "select doc_id, md5(case when regexp_matches(text, '[.!?]') then left(text, length(text) - length(regexp_extract(text, '[^.!?]*$', 0))) else text end) as cut from documents")
def sc_last_sentence(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(X.to_last_sentence("text")).alias("cut"))


@query("sc_last_segment", "select page_id, split_part(rtrim(url, '/'), '/', -1) as name from pages")
def sc_last_segment(spark, d):
    return read(spark, d, "pages").select("page_id", X.last_segment(F.concat("url", F.lit("//"))).alias("name"))


@query("sc_json_block", "select event_id, case when event_id % 3 = 0 then 'none' else props end as block from events")
def sc_json_block(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.concat(F.lit("Here it is:\n"), "props", F.lit(" as asked.")))
    return read(spark, d, "events").select("event_id", X.json_block(text).alias("block"))


@query("sc_enum_defaults", "select id, case k % 4 when 0 then 'git_commit' when 1 then 'note' else 'window' end as event_type, case k % 5 when 0 then 'Coding' when 1 then 'Research' when 2 then 'Other' end as category from tick", TICK)
def sc_enums(spark, d):
    from .schema import category, event_type

    kind, name = F.expr("case k % 4 when 0 then 'GIT_COMMIT' when 1 then 'Note' when 2 then 'odd' end"), F.expr("case k % 5 when 0 then 'CODING' when 1 then 'research' when 2 then 'gardening' end")
    return _ticks(spark, d).select("id", event_type(kind).alias("event_type"), category(name).alias("category"))


@query("sc_stable_ids", "select id, sha256('e' || chr(31) || id || chr(31) || case when k % 2 = 0 then chr(30) else '' || k end) as key from tick", TICK)
def sc_ids(spark, d):
    from .schema import stable_id

    return _ticks(spark, d).select("id", stable_id(F.lit("e"), "id", F.when(F.col("k") % 2 == 1, F.col("k"))).alias("key"))
