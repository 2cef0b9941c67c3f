"""Raw logs in their own formats, sinks, and streams that must give what the batch forms give."""

import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronolake.operators import sequence
from chronolake.plans import api, compaction
from chronolake.sources import history, logs, sinks
from chronolake.streaming import ingest, processors

T0 = datetime(2026, 6, 15, 9, 30)


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_zsh(spark, tmp_path):
    p = write(tmp_path / "z", b": 1700000000:0;ls; pwd\nplain\n: 1600000000:2;old\n: bad:0;x\n: 1700000001:0;\n: 1700000002:0;caf\xff\n")
    got = [(r.command, r.timestamp) for r in history.zsh(spark, p, F.timestamp_seconds(F.lit(1650000000))).orderBy("timestamp").collect()]
    assert got[0] == ("ls; pwd", datetime(2023, 11, 14, 22, 13, 20)) and len(got) == 2 and got[1][0].startswith("caf")


def test_bash(spark, tmp_path):
    p = write(tmp_path / "b", "a\n#1700\n\nb\nc\n")
    assert [r.command for r in history.bash(spark, p).collect()] == ["a", "b", "c"]
    assert [r.command for r in history.bash(spark, p, 2).collect()] == ["b", "c"]


def test_fish(spark, tmp_path):
    p = write(tmp_path / "f", "- cmd: ls -l\n  when: 1700000000\n- cmd: pwd\n")
    got = [(r.command, r.timestamp) for r in history.fish(spark, p, F.lit(T0)).orderBy("timestamp").collect()]
    assert got == [("ls -l", datetime(2023, 11, 14, 22, 13, 20)), ("pwd", T0)]
    e = history.terminal_events(history.fish(spark, p, F.lit(T0))).collect()
    assert {json.loads(r.raw_content)["command"] for r in e} == {"ls -l", "pwd"} and len({r.id for r in e}) == 2


def test_chromium(spark):
    us = lambda s: (s + 11644473600) * 1_000_000
    rows = [("https://a.org/x", None, us(1700000000), 1), ("https://www.chase.com/", "Bank", us(1700000001), 1), ("https://b.org", "B", us(10), 1), ("https://youtu.be/abc", "Talk", us(1700000002), 3)]
    t = spark.createDataFrame(rows, "url string, title string, last_visit_time long, visit_count int")
    v = history.chromium(t, F.timestamp_seconds(F.lit(1000)), "chrome")
    assert [(r.title, r.domain) for r in v.collect()] == [("YouTube: Talk", "youtu.be"), ("Untitled", "a.org")]
    assert history.browser_events(v).filter("event_type = 'browser'").count() == 2


def test_safari(spark):
    v = spark.createDataFrame([(1, 0.0, None), (2, 1.0, "x")], "history_item int, visit_time double, title string")
    i = spark.createDataFrame([(1, "https://a.org/", 2)], "id int, url string, visit_count int")
    (r,) = history.safari(v, i, F.timestamp_seconds(F.lit(0))).collect()
    assert r.timestamp == datetime(2001, 1, 1) and r.domain == "a.org"


def test_log_reader_skips_bad_lines(spark, tmp_path):
    p = write(tmp_path / "w", '{"timestamp":"2026-06-15T09:00:00Z","app":"A","title":"t"}\nnot json\n{"app":"B"}\n{"timestamp":"never","app":"C"}\n{"timestamp":"2026-06-15T09:01:00Z","app":"B","title":"u"}\n')
    t = logs.read_log(spark, p, logs.WINDOW_LOG)
    assert t.count() == 2 and logs.read_log(spark, p, logs.WINDOW_LOG, F.lit(datetime(2026, 6, 15, 9, 1))).count() == 1
    (e,) = logs.window_events(t).collect()
    assert e.metadata["duration_seconds"] == "60" and e.raw_content == "A — t"


def test_screen_rules(spark, tmp_path):
    text = "x" * 60
    rows = [("Arc", "w", text), ("Finder", "w", text), ("Arc", "Private tab", text), ("Arc", "w", "short")]
    p = write(tmp_path / "s", "\n".join(json.dumps({"timestamp": f"2026-06-15T09:0{i}:00Z", "app_name": a, "window_title": w, "raw_text": t}) for i, (a, w, t) in enumerate(rows)))
    e = logs.screen_events(logs.read_log(spark, p, logs.SCREEN_LOG), F.lit(T0)).collect()
    assert len(e) == 1 and e[0].raw_content.startswith("Arc — w: x")


def test_a_screen_row_after_now_is_still_shown(spark):
    log = spark.createDataFrame([(u, T0 + timedelta(seconds=s), "Arc", "w", "x" * 80, "ocr", None) for u, s in (("a", 0), ("a", 90), ("b", -2), ("c", -4))], "u string, timestamp timestamp, app_name string, window_title string, raw_text string, raw_text_source string, gist string")
    e = logs.screen_events(log, F.lit(T0), ["u"]).collect()
    assert sorted((r.u, r.metadata["duration_seconds"]) for r in e) == [("a", "-90"), ("a", "90"), ("c", "4")]


def test_staging(spark, tmp_path):
    rows = [{"timestamp": "2026-06-15T09:00:00Z", "repo": "/home/me/proj", "staged": []}, {"timestamp": "2026-06-15T09:01:00Z", "repo": "/home/me/proj", "staged": ["a.rs"]}]
    p = write(tmp_path / "g", "\n".join(map(json.dumps, rows)))
    (e,) = logs.staging_events(logs.read_log(spark, p, logs.STAGING_LOG)).collect()
    assert e.project == "proj" and e.event_type == "git_staged" and e.raw_content == "Staged: a.rs"


def test_commits_and_repositories(spark):
    c = spark.createDataFrame([(T0 + timedelta(minutes=i), "/r/one/", f"h{i}", f"m{i}", ["f"] * 40, 1, "d" * 20000) for i in range(60)], logs.COMMIT_EXPORT.replace("timestamp string", "timestamp timestamp"))
    e = logs.commit_events(c)
    assert e.count() == 50 and e.filter("size(files_changed) = 30 and project = 'one'").count() == 50
    assert logs.commit_events(c, F.lit(T0 + timedelta(minutes=55))).count() == 5
    p = spark.createDataFrame([("a/.git",), ("a/b/c/d/.git",), ("node_modules/x/.git",), (".hidden/y/.git",), ("a/src",)], "path string")
    assert [r.repo for r in logs.repositories(p).collect()] == ["a"]


def test_points(spark, tmp_path):
    p = write(tmp_path / "q", '{"id":"1","vector":[1.0],"payload":{"timestamp":"2026-06-15T09:00:00Z","type":"browser","text":"hi","x":"y"}}\n{"id":"2","payload":{}}\n')
    (e,) = logs.imported_points(spark, p).collect()
    assert e.event_type == "browser" and e.raw_content == "hi" and e.metadata == {"x": "y"} and e.embedding == [1.0]


def test_triggers(spark):
    t = spark.createDataFrame([('{"type":"app_switch","app_name":"Arc","timestamp":"2026-06-05T03:14:25.810Z"}',), ('{"type":"nope"}',), ("not json",), ('{"type":"screen_lock"}',)], "value string")
    got = {r.type: (r.depth, r.app_name) for r in logs.parsed_triggers(t, F.lit(T0)).collect()}
    assert got == {"app_switch": ("Full", "Arc"), "screen_lock": ("None", "")}


def stored(spark, n=3):
    return spark.createDataFrame([(str(i), T0 + timedelta(days=i % 2), "note", f"text {i}") for i in range(n)], "id string, timestamp timestamp, event_type string, raw_content string").withColumn("date", F.to_date("timestamp")).withColumn("project", F.lit(None).cast("string")).withColumn("metadata", F.create_map().cast("map<string,string>"))


def test_store(spark, tmp_path):
    s = sinks.Store(spark, str(tmp_path / "db"))
    assert s.read("events").count() == 0
    s.append("events", stored(spark), s.version())
    s.append("events", stored(spark, 1).withColumn("summary", F.lit("new")), s.version())
    got = {r.id: r.summary for r in s.read("events").collect()}
    assert got == {"0": "new", "1": None, "2": None}
    s.delete_day("2026-06-16")
    spark.catalog.clearCache()
    assert {r.id for r in s.read("events").collect()} == {"0", "2"}
    s.replace_days(stored(spark, 1))
    assert {r.id for r in s.read("events").collect()} == {"0"}


def test_ingest(spark, tmp_path):
    s = sinks.Store(spark, str(tmp_path / "db"))
    broken = ingest.ingest_batch(s, lambda texts: 1 / 0)
    broken(stored(spark), 1)
    assert s.read("events").count() == 0 and s.read("pending").filter("not compacted").count() == 3
    good = ingest.ingest_batch(s, ingest.hashed_vectors())
    good(stored(spark).limit(0), 2)
    assert s.read("events").filter("embedding is not null").count() == 3 and s.read("pending").filter("not compacted").count() == 0
    good(stored(spark), 3)
    good(stored(spark), 3)
    assert s.read("events").count() == 3


def test_chunked(spark):
    e = stored(spark, 1).withColumn("raw_content", F.lit(" ".join(map(str, range(36)))))
    c = ingest.chunked(e, 10, 2).orderBy("chunk_index").collect()
    assert len(c) == 5 and c[1].chunk.split()[0] == "8" and c[1].source_doc_id == "0_chunk_1"


def test_breaker():
    b = ingest.Breaker()
    for _ in range(3):
        assert b.run("x", lambda: 1 / 0) is None
    assert b.open("x") and b.run("x", lambda: 1) is None and b.run("y", lambda: 2) == 2
    assert ingest.due(None, "2026-06-15T09") and not ingest.due("2026-06-15T01", "2026-06-15T09") and ingest.due("2026-06-15T08", "2026-06-15T09", "hour")


def stream(spark, tmp_path, batches, schema, make, name, enough=None):
    """Rows that a stream operator gives for batches of rows, one file each. With timeouts in processing time a query never
    runs out of batches: it is stopped when it has given ``enough`` rows."""
    d = tmp_path / name
    d.mkdir()
    for i, rows in enumerate(batches):
        f = d / f"{i}.json"
        f.write_text("\n".join(map(json.dumps, rows)))
        import os

        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))
    q = make(s).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    end = time.monotonic() + 120
    try:
        while not q.awaitTermination(1) and time.monotonic() < end:
            if enough is not None and spark.table(name).count() >= enough:
                break
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def at(s):
    return (T0 + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_stream_runs_span_batches(spark, tmp_path):
    rows = [("A", 0), ("A", 20), ("B", 40), ("B", 50), ("A", 60), ("C", 100)]
    js = [{"k": "u", "app": a, "title": "t", "timestamp": at(s)} for a, s in rows]
    got = stream(spark, tmp_path, [js[:1], js[1:4], js[4:]], "k string, app string, title string, timestamp timestamp", lambda s: processors.focus_runs(s, "k"), "runs")
    b = spark.createDataFrame([("u", a, "t", T0 + timedelta(seconds=s), str(i)) for i, (a, s) in enumerate(rows)], "k string, app string, title string, timestamp timestamp, id string")
    want = sorted((r.k, r.app, r.start, r.duration_seconds) for r in sequence.focus_runs(b, ["k"], ["app", "title"]).collect())
    assert sorted((k, a, s, d) for k, a, _, s, d in got) == want and want


def test_stream_sessions_and_edges(spark, tmp_path):
    js = [{"k": "u", "id": str(i), "timestamp": at(s)} for i, s in enumerate([0, 600, 1201, 1202])]
    got = stream(spark, tmp_path, [js[:2], js[2:]], "k string, id string, timestamp timestamp", lambda s: processors.session_ids(s, "k"), "sess")
    assert sorted((i, n) for _, i, _, n in got) == [("0", 1), ("1", 1), ("2", 2), ("3", 2)]
    js = [{"k": "u", "idle": x, "timestamp": at(i)} for i, x in enumerate([10.0, 130.0, 200.0, 0.5, 1.0])]
    got = stream(spark, tmp_path, [js[:2], js[2:4], js[4:]], "k string, idle double, timestamp timestamp", lambda s: processors.idle_edges(s, "k", 120), "edges")
    assert sorted(e for _, _, e in got) == ["Resumed", "WentIdle"]


def test_stream_drops(spark, tmp_path):
    js = [{"k": "u", "id": str(i), "app": "a", "title": "t", "timestamp": at(s), "embedding": [1.0, 0.0]} for i, s in enumerate([0, 60, 7260, 14500])]
    got = stream(spark, tmp_path, [js[:1], js[1:]], "k string, id string, app string, title string, timestamp timestamp, embedding array<float>", lambda s: processors.visual_drops(s, "k"), "drops", 4)
    assert {i: d for _, i, _, d in got} == {"0": False, "1": True, "2": False, "3": False}


def _restarted(spark, tmp_path, batches, schema, make, pause=0.0):
    """Rows of a query that is started anew from its checkpoint for each batch."""
    d, out = tmp_path / "in", []
    d.mkdir()
    for i, rows in enumerate(batches):
        (d / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        got: list = []
        s = make(spark.readStream.schema(schema).json(str(d)))
        q = s.writeStream.foreachBatch(lambda df, n, got=got: got.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()
        end = time.monotonic() + 60
        while len(got) < len(rows) and time.monotonic() < end and q.exception() is None:
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None
        out.append(got)
        time.sleep(pause)
    return out


def test_stream_state_survives_a_restart(spark, tmp_path):
    js = [{"k": "u", "id": str(i), "timestamp": at(s)} for i, s in enumerate([0, 600, 1201, 1300, 2000])]
    a, b = _restarted(spark, tmp_path, [js[:3], js[3:]], "k string, id string, timestamp timestamp", lambda s: processors.session_ids(s, "k"))
    assert {i: n for _, i, _, n in a + b} == {"0": 1, "1": 1, "2": 2, "3": 2, "4": 3}


def test_stream_cache_expires(spark, tmp_path):
    """The store forgets an entry by its own clock: rows that are near in their own time, but come later than the time to live."""
    js = [{"k": "u", "id": str(i), "app": "a", "title": "t", "timestamp": at(s), "embedding": [1.0, 0.0]} for i, s in enumerate([0, 0.2, 0.4])]
    schema = "k string, id string, app string, title string, timestamp timestamp, embedding array<float>"
    a, b = _restarted(spark, tmp_path, [js[:2], js[2:]], schema, lambda s: processors.visual_drops(s, "k", ttl=3), pause=4)
    assert {i: d for _, i, _, d in a} == {"0": False, "1": True} and {i: d for _, i, _, d in b} == {"2": False}


def test_stream_debounce(spark, tmp_path):
    js = [{"k": "u", "type": t, "timestamp": at(s)} for t, s in [("app_switch", 0), ("title_change", 2), ("screen_lock", 3), ("app_switch", 4), ("screen_unlock", 5)]]
    got = stream(spark, tmp_path, [js], "k string, type string, timestamp timestamp", lambda s: processors.debounced(s, "k", 0.5), "deb", 3)
    assert sorted(t for _, t, _ in got) == ["app_switch", "screen_unlock", "title_change"]


def test_stream_windows(spark, tmp_path):
    js = [{"u": "a", "event_type": "note", "timestamp": at(s)} for s in (0, 10, 4000, 90000)]
    got = stream(spark, tmp_path, [js, js[-1:]], "u string, event_type string, timestamp timestamp", processors.windowed_counts, "win")
    assert (datetime(2026, 6, 15, 9), "note", 2) in got
    got = stream(spark, tmp_path, [js, js[-1:]], "u string, event_type string, timestamp timestamp", lambda s: processors.session_counts(s, "u"), "sesscount")
    assert ("a", T0, T0 + timedelta(seconds=10), 2) in got


def test_api(spark, data):
    from chronolake import adapter

    e = adapter.events(spark, data, vectors=True)
    now = F.to_timestamp(F.lit(adapter.NOW))
    assert api.working_memory(e, now, 60 * 24).columns[-1] == "line"
    assert api.recent_activity(e, now, 24, "app1").filter("app <> 'app1'").count() == 0
    assert api.search_activity(e, "fix cargo", None, now, 5).count() == 5
    v = list(e.filter("embedding is not null").first().embedding)
    assert api.search_activity(e, "fix", v, now, 5, scorer=lambda t: [len(x) for x in t]).count() == 5
    assert set(api.patterns(e, now)) == {"types", "projects", "hours", "active"}
    c = compaction.compact(e, now, threshold=-0.2)
    assert c.report.filter("event_count < kept_count").count() == 0 and c.tasks.filter("activity_count = 0").count() == 0
    assert c.events.filter("compacted").count() == e.count()
    done = e.select("date").distinct()
    assert compaction.compact(e, now, done).report.count() == 0
    assert compaction.last_days(e, now, 2).select("date").distinct().count() <= 2


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("1", T0, "x")], "id string, start_time timestamp, title string")
    sinks.write_tasks_by_date(t, str(tmp_path / "t"))
    sinks.write_tasks_by_date(t.withColumn("title", F.lit("y")), str(tmp_path / "t"))
    assert [r.title for r in spark.read.json(str(tmp_path / "t")).collect()] == ["y"]
    s = spark.createDataFrame([(T0.date(), 3, "Coding:3/1", "p")], "date date, total long, categories string, top_projects string")
    sinks.write_summaries(s, str(tmp_path / "s"))
    assert "Summary of June 15, 2026" in "".join(f.read_text() for f in (tmp_path / "s/markdown").glob("part*"))


def test_layout(spark):
    rows = [(1, "name", 0.0, 0.0, 50.0, 10.0), (1, "the message body is here", 60.0, 1.0, 200.0, 10.0), (1, "second line of words", 0.0, 30.0, 100.0, 10.0), (1, "far right", 900.0, 30.0, 50.0, 10.0), (1, "nowhere", None, None, None, None), (2, "tiny", 0.0, 0.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "k int, text string, x double, y double, width double, height double")
    got = {r.k: r.text for r in logs.laid_out(t, ["k"]).collect()}
    assert got == {1: "name  the message body is here\nsecond line of words\nfar right\nnowhere", 2: None}


def test_reports(spark, data):
    from chronolake import adapter
    from chronolake.settings import Settings

    e, t = adapter.events(spark, data, vectors=True), adapter.tasks(spark, data)
    now = F.to_timestamp(F.lit(adapter.NOW))
    assert api.observe(e, ["user_id"]).agg(F.sum("event_count")).first()[0] == e.count()
    assert api.range_search(t, "order", "1995-01-01", "1995-02-01").filter("start_time > '1995-02-02'").count() == 0
    made = api.identify_tasks(e, now, -0.2)
    assert made.count() == made.select("id").distinct().count() > 0
    assert {len(r.embedding) for r in api.reembed(e, ingest.hashed_vectors(8), "2024-01-05").select("embedding").collect()} == {8}
    assert len(api.shaped_tasks(t).columns) == 8 and len(api.shaped_events(e).columns) == 6
    ent = spark.createDataFrame([("a", "tool", datetime(2024, 1, 30), 3), ("b", "tool", datetime(2023, 1, 1), 9)], "id string, type string, last_seen timestamp, mention_count long")
    g = api.analyze_graph(ent, ent, now)
    assert [r.id for r in g["top"].collect()] == ["a"] and g["stats"].first().entities == 1
    s = Settings.of(spark.createDataFrame([("pool", "7"), ("recency_days", "x"), ("none", "1"), ("session_gap", None)], "key string, value string"))
    assert s.pool == 7 and s.recency_days == 30.0 and s.session_gap == 600


def test_poll_cycle(spark, tmp_path):
    """Two polls over a folder: what comes is stored, linked, compacted and summed up by hour; a rerun changes nothing."""
    s = sinks.Store(spark, str(tmp_path / "db"))
    e = stored(spark).withColumn("source", F.lit("u1"))
    schema = e.schema
    arrive = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.poll(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ingest.cycle(s, ingest.hashed_vectors(), lambda: "2026-06-17T00:30:00"), str(tmp_path / "mark"), None).awaitTermination()
    rows = e.orderBy("timestamp").collect()
    arrive(spark.createDataFrame(rows[:2], schema))
    run()
    assert s.read("events").count() == 2 and s.read("nodes").count() == 2
    arrive(spark.createDataFrame(rows[2:], schema))
    run()
    run()
    assert s.read("events").count() == len(rows) and {r.src_id for r in s.read("edges").collect()} >= {r.id for r in rows}
    yesterday = [r for r in rows if str(r.timestamp)[:10] == "2026-06-16"]
    assert s.read("hours").count() == len({r.timestamp.hour for r in yesterday})
    assert s.read("events").filter("compacted").count() == len([r for r in rows if str(r.timestamp)[:10] < "2026-06-17"])


def test_cycle_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    from chronolake.operators import temporal_graph

    monkeypatch.setattr(temporal_graph, "edges", lambda *a: 1 / 0)
    s = sinks.Store(spark, str(tmp_path / "db"))
    ingest.cycle(s, ingest.hashed_vectors(), lambda: "2026-06-17T00:30:00")(stored(spark).withColumn("source", F.lit("u1")), 1)
    assert s.read("events").count() == 3 and s.read("hours").count() > 0 and s.read("edges").count() == 0


def test_narratives(spark):
    from chronolake.plans import prompts

    t = spark.createDataFrame([("1", "Fix", "the bug", "done", None, 5.0, 2), ("2", "Write", None, "active", "Docs", None, 1)], "id string, title string, description string, status string, category string, duration_minutes double, activity_count int")
    said = lambda ask=None: [r.narrative for r in prompts.narrated(t, "task_summary", ask).orderBy("id").collect()]
    assert said() == said(lambda texts: 1 / 0) == said(lambda texts: ["x"] * 99) == ["Fix — the bug", "Write — "]
    assert said(lambda texts: [x.split()[7] if "Fix" in x else "" for x in texts]) == ["Fix", "Write — "]
    assert set(prompts.FALLBACKS) <= set(prompts.REQUESTS) and len(prompts.REQUESTS) == 11


def test_local_days(spark):
    from chronolake.functions import expr as X

    r = spark.range(1).select(X.local_midnight(F.lit("2024-03-10"), "America/New_York").alias("a"), X.day_start(F.to_timestamp(F.lit("2024-03-10 02:00:00")), "America/New_York").alias("b"), X.day_start(F.current_timestamp(), "UTC", "2024-05-01").alias("c")).first()
    assert (str(r.a), str(r.b), str(r.c)) == ("2024-03-10 05:00:00", "2024-03-09 00:00:00", "2024-05-01 00:00:00")
