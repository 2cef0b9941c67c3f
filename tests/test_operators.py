"""Operators on small fixtures with known results, and against plain Python on random input."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.functions import expr as X
from chronolake.operators import cluster, entity_graph, filters, fulltext, rollup, sequence, tasks, temporal_graph, vector
from chronolake.operators.filters import EventFilter
from chronolake.plans import compaction

T0 = datetime(2026, 6, 15, 9, 30)


def events(spark, rows):
    """rows: dicts; what they lack is null."""
    schema = "id string, timestamp timestamp, date date, event_type string, source string, raw_content string, summary string, category string, project string, metadata map<string,string>, files_changed array<string>, compacted boolean, embedding array<float>"
    names = [c.split()[0] for c in schema.split(", ")]
    base = {"timestamp": T0, "event_type": "terminal", "raw_content": "", "metadata": {}, "compacted": False}
    return spark.createDataFrame([tuple((base | {"id": str(i)} | r).get(n) for n in names) for i, r in enumerate(rows)], schema).withColumn("date", F.to_date("timestamp"))


def unit(*v):
    return [float(x) for x in v] + [0.0] * (8 - len(v))


def test_knn_order_and_scores(spark):
    e = events(spark, [{"embedding": unit(1)}, {"embedding": unit(0.8, 0.6)}, {"embedding": unit(0, 1)}])
    got = [(r.id, round(r.score, 3)) for r in vector.nearest(e, unit(5), 3).collect()]
    assert got == [("0", 1.0), ("1", 0.8), ("2", 0.0)]


def test_filter_never_starves_knn(spark):
    e = events(spark, [{"embedding": unit(1), "metadata": {"app_name": "Xcode"}}] * 30 + [{"embedding": unit(0.6, 0.8), "metadata": {"app_name": "Terminal"}}] * 5)
    f = EventFilter(app="Terminal")
    assert vector.nearest(filters.matching(e, f), unit(1), 5).count() == 5


def test_chunks_collapse_to_the_best(spark):
    e = events(spark, [{"id": "a", "embedding": unit(0, 1)}, {"id": "a", "embedding": unit(1)}, {"id": "b", "embedding": unit(0.6, 0.8)}]).withColumn("chunk_index", F.lit(0))
    assert [(r.id, round(r.score, 3)) for r in vector.nearest(e, unit(1), 5).collect()] == [("a", 1.0), ("b", 0.6)]


def test_keyword_search(spark):
    d = spark.createDataFrame([("a", '{"command": "cargo build release"}'), ("b", '{"command": "ls"}'), ("c", None)], "id string, text string")
    assert [r.id for r in fulltext.bm25(d, "release cargo!", 10).collect()] == ["a"]
    assert fulltext.bm25(d, "! ?", 10).count() == 0
    assert fulltext.bm25(d.limit(0), "cargo", 10).count() == 0
    assert X.query_terms("What's up, a C++ café?") == ["what", "up", "café"]


def test_ids_keep_the_order_asked_for(spark):
    e = events(spark, [{"id": "a"}, {"id": "b"}])
    assert [r.id for r in filters.by_ids(e, ["b", "missing", "a"]).orderBy("pos").collect()] == ["b", "a"]


@pytest.mark.parametrize(("app", "n"), [("MyApp", 1), ("My%", 0), ("My_pp", 0)])
def test_app_filter_has_no_wildcards(spark, app, n):
    e = events(spark, [{"metadata": {"app_name": "MyApp"}}])
    assert filters.matching(e, EventFilter(app=app)).count() == n
    assert filters.since(e, F.lit(T0), None, app).count() == n


def test_empty_filter(spark):
    assert EventFilter().is_empty()
    assert filters.matching(events(spark, [{}]), EventFilter()).count() == 1
    assert filters.matching(events(spark, [{"project": None}]), EventFilter(project="x")).count() == 0


def arm(spark, *ids):
    return spark.createDataFrame([(i, 1.0 - n / 10) for n, i in enumerate(ids)], "id string, score double")


def test_rank_fusion(spark):
    got = [r.id for r in vector.fuse([arm(spark, "a", "b"), arm(spark, "b", "c")], 40).collect()]
    assert got[0] == "b" and sorted(got) == ["a", "b", "c"]
    assert vector.fuse([arm(spark, *map(str, range(50)))], 5).count() == 5


def test_hybrid_without_text_hits_is_cosine(spark):
    e = events(spark, [{"id": "a"}, {"id": "b"}])
    none = arm(spark, "a").limit(0)
    assert [r.score_kind for r in vector.hybrid(arm(spark, "a", "b"), none, e, F.lit(T0), 5).collect()] == ["cosine"] * 2
    assert [r.score_kind for r in vector.hybrid(none, arm(spark, "a"), e, F.lit(T0), 5).collect()] == ["rrf"]
    assert vector.hybrid(none, none, e, F.lit(T0), 5).count() == 0


def test_recency(spark):
    t = spark.createDataFrame([(T0,), (T0 - timedelta(days=7),), (T0 + timedelta(days=3),)], "timestamp timestamp")
    got = [r[0] for r in t.select(X.recency("timestamp", F.lit(T0), 1.0, 7.0)).collect()]
    assert got == pytest.approx([1.0, math.exp(-1), 1.0])
    assert [r[0] for r in t.select(X.recency("timestamp", F.lit(T0), 0, 7.0)).collect()] == [0.0] * 3


def test_near_duplicate_run_keeps_the_last(spark):
    e = events(spark, [{"id": i, "timestamp": T0 + timedelta(minutes=n), "embedding": v} for n, (i, v) in enumerate([("a", unit(1)), ("b", unit(1)), ("c", unit(0, 1))])]).withColumn("k", F.lit(1))
    got = sequence.near_duplicate_runs(e, ["k"], 0.95, newest_first=False).orderBy("pos").collect()
    assert [r.id for r in got] == ["b", "c"]
    bare = events(spark, [{}, {}]).withColumn("k", F.lit(1))
    assert sequence.near_duplicate_runs(bare, ["k"], 0.95).count() == 2


def test_near_duplicate_runs_like_a_loop(spark):
    rnd = random.Random(5)
    vs = [unit(1), unit(0.99, 0.14), unit(0, 1), unit(0.1, 0.99)]
    rows = [{"id": f"{i:03}", "timestamp": T0 + timedelta(seconds=i), "event_type": rnd.choice(["terminal", "note"]), "embedding": rnd.choice(vs)} for i in range(80)]
    kept, last = [], {}
    for r in rows:
        old = last.get(r["event_type"])
        v = np.array(r["embedding"])
        if old is not None and v @ np.array(old[1]["embedding"]) / np.linalg.norm(v) / np.linalg.norm(old[1]["embedding"]) >= 0.95:
            kept[old[0]] = r
            last[r["event_type"]] = (old[0], r)
        else:
            kept.append(r)
            last[r["event_type"]] = (len(kept) - 1, r)
    e = events(spark, rows).withColumn("k", F.lit(1))
    got = [r.id for r in sequence.near_duplicate_runs(e, ["k"], 0.95, newest_first=False).orderBy("pos").collect()]
    assert got == [r["id"] for r in kept]


def test_prefix_and_labels(spark):
    d = spark.createDataFrame([("[2026-06-20 09:30] did a thing",), ("plain",)], "l string")
    assert [r[0] for r in d.select(X.strip_prefix("l")).collect()] == ["did a thing", "plain"]
    h = spark.createDataFrame([(0,), (9,), (12,), (15,)], "h int")
    assert [r[0] for r in h.select(X.hour_label("h")).collect()] == ["12 AM", "9 AM", "12 PM", "3 PM"]


def test_json_block_and_text_helpers(spark):
    d = spark.createDataFrame([('```json\n{"a": {"b": 1}}\n```',), ("none",)], "t string")
    assert [r[0] for r in d.select(X.json_block("t")).collect()] == ['{"a": {"b": 1}}', "none"]
    d = spark.createDataFrame([("One. Two! Thr",), ("no end",)], "t string")
    assert [r[0] for r in d.select(X.to_last_sentence("t")).collect()] == ["One. Two!", "no end"]
    d = spark.createDataFrame([("  a \n b\t c ",)], "t string")
    assert d.select(X.one_line("t", 3)).first()[0] == "a b"


def test_cosine(spark):
    d = spark.createDataFrame([(unit(1), unit(1)), (unit(1), unit(0, 1)), (unit(0), unit(1))], "a array<float>, b array<float>")
    assert [r[0] for r in d.select(X.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]
    short = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in short.select(X.cosine_shorter("a", "b")).collect()] == [1.0, 0.0]


def test_embedding_text(spark):
    e = events(
        spark,
        [
            {"event_type": "screen", "raw_content": "Arc — x: words", "metadata": {"gist": "reading"}, "project": "p"},
            {"event_type": "git_commit", "raw_content": '{"message": "fix", "files_changed": ["a.rs", "b.rs"], "diff": "+1"}'},
            {"event_type": "browser", "raw_content": '{"title": "T", "domain": "d.org"}', "project": ""},
            {"event_type": "browser", "raw_content": "broken {"},
            {"event_type": "terminal", "raw_content": '{"command": " ls "}'},
        ],
    )
    got = [r[0] for r in e.orderBy("id").select(X.embedding_text()).collect()]
    assert got == ["reading | Arc — x: words [p]", "fix | files: a.rs, b.rs | +1", "T | d.org", "broken {", "ls"]


def test_lines(spark):
    e = events(spark, [{"event_type": "screen", "metadata": {"app_name": "Arc", "window_title": "W"}, "raw_content": "Arc — W: the text"}, {"event_type": "window", "metadata": {"gist": "g", "app_name": "A"}}])
    r = e.orderBy("id").select(X.line(), X.detail()).collect()
    assert r[0][0] == "[2026-06-15 09:30] screen: Arc — W" and r[0][1].endswith("\nthe text")
    assert r[1][0] == "[2026-06-15 09:30] window: g"


def test_chunks(spark):
    d = spark.createDataFrame([([f"w{i}" for i in range(36)],), (["short"],), ([],)], "w array<string>")
    got = [r[0] for r in d.select(X.chunks("w", 10, 2)).collect()]
    assert len(got[0]) > 1 and max(map(len, got[0])) <= 10 and got[0][-1][-1] == "w35" and got[0][1][0] == "w8"
    assert got[1] == [["short"]] and got[2] == [[]]


def test_hour_aggregate(spark):
    rows = [{"timestamp": T0 + timedelta(seconds=i), "raw_content": f"line {i}" if i % 5 else "  ", "summary": "  " if i % 2 else None, "category": ["Coding", "Research"][i % 2], "metadata": {"app_name": ["Xcode", "Xcode", "Safari"][i % 3]}} for i in range(34)]
    r = rollup.hour_aggregate(events(spark, rows)).first()
    assert r.event_count == 34 and r.apps == ["Xcode", "Safari"] and r.categories == ["Coding", "Research"]
    assert len(r.lines) == 24 and r.lines[0] == "line 1"


def test_timeline_of_an_empty_day(spark):
    e = events(spark, [{}])
    s = spark.createDataFrame([], "date date, hour int, title string, summary string, apps array<string>, categories array<string>, event_count long")
    assert rollup.timeline(e.limit(0), s).count() == 0


def test_idle_edges(spark):
    t = spark.createDataFrame([(i, "a", T0 + timedelta(seconds=i), x) for i, x in enumerate([10.0, 130.0, 200.0, 0.5, 1.0])], "id int, k string, timestamp timestamp, idle double")
    got = [(r.id, r.edge) for r in sequence.idle_edges(t, ["k"], 120).orderBy("id").collect()]
    assert got == [(1, "WentIdle"), (3, "Resumed")]


def test_debounce_and_lock(spark):
    rows = [(0, 0.0, "app_switch"), (1, 0.2, "title_change"), (2, 1.0, "app_switch"), (3, 1.1, "screen_lock"), (4, 2.0, "app_switch"), (5, 3.0, "screen_unlock"), (6, 3.1, "app_switch")]
    t = spark.createDataFrame([(i, "a", T0 + timedelta(seconds=s), k) for i, s, k in rows], "id int, k string, timestamp timestamp, type string")
    assert [r.id for r in sequence.debounced(t, ["k"], 0.5).orderBy("id").collect()] == [1, 5, 6]


def test_visual_cache_ages(spark):
    rows = [("a", 0, unit(1)), ("b", 60, unit(1)), ("c", 7260, unit(1)), ("d", 14500, unit(1))]
    t = spark.createDataFrame([(i, "k", "app", "w", T0 + timedelta(seconds=s), v) for i, s, v in rows], "id string, k string, app string, title string, timestamp timestamp, embedding array<float>")
    got = {r.id: r.dropped for r in sequence.visual_drops(t, ["k"]).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_visual_drops_of_many_groups_in_a_task(spark):
    """Groups share a task: the first row of each finds nothing cached, whatever the group before left."""
    one = [(f"{k}{i}", T0 + timedelta(minutes=i), f"u{k}", "a", "t", None if i == 2 else unit(1)) for k in range(40) for i in range(4)]
    t = spark.createDataFrame(one, "id string, timestamp timestamp, k string, app string, title string, embedding array<float>")
    out = sequence.visual_drops(t, ["k"])
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert {r.id: r.dropped for r in out.collect()} == {f"{k}{i}": i in (1, 3) for k in range(40) for i in range(4)}


def test_gap_boundary(spark):
    rows = [{"id": "a"}, {"id": "b", "timestamp": T0 + timedelta(seconds=600)}, {"id": "c", "timestamp": T0 + timedelta(seconds=1200.9)}]
    e = events(spark, rows).withColumn("k", F.lit(1))
    s = lambda whole: [r.session for r in sequence.gap_sessions(e, ["k"], 600, whole).orderBy("id").collect()]
    assert s(False) == [1, 1, 2] and s(True) == [1, 1, 1]


def naive_dbscan(v, eps, least):
    n = len(v)
    near = [[j for j in range(n) if j != i and np.linalg.norm(v[i] - v[j]) <= eps + 1e-9] for i in range(n)]
    label, c = [None] * n, 0
    for i in range(n):
        if label[i] is not None:
            continue
        if len(near[i]) < least:
            label[i] = -1
            continue
        todo = list(near[i])
        label[i] = c
        while todo:
            j = todo.pop(0)
            if label[j] == -1:
                label[j] = c
            if label[j] is not None:
                continue
            label[j] = c
            if len(near[j]) >= least:
                todo += near[j]
        c += 1
    return label


def test_dbscan_like_the_sequential_form():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.random((rng.integers(1, 40), 2))
        eps, least = rng.uniform(0.05, 0.3), int(rng.integers(1, 5))
        assert cluster.dbscan_labels(v, eps, least).tolist() == naive_dbscan(v, eps, least)
    assert cluster.dbscan_labels(np.zeros((0, 2)), 1, 1).tolist() == []


def test_a_core_alone_is_a_cluster(spark):
    """Three arms of four rows, and a core between them whose neighbours have joined the arms' clusters."""
    arms = [(t, a * 2 * math.pi / 3) for a in range(3) for t in (0.18, 0.09, 0.26, 0.27)]
    at = [[math.sin(t) * math.cos(a), math.sin(t) * math.sin(a), math.cos(t)] for t, a in [*arms, (0, 0)]]
    e = events(spark, [{"timestamp": T0 + timedelta(minutes=i), "event_type": "git_commit", "project": "p", "embedding": unit(*v)} for i, v in enumerate(at)])
    got = {r.id: (r.cluster, r.block) for r in cluster.project_clusters(e, 0.9, 3).collect()}
    assert got == {str(i): (i // 4, 0) for i in range(13)}
    done = compaction.compact(e, F.lit(T0 + timedelta(days=1)), threshold=0.9, duplicate=1.1)
    assert [(r.event_count, r.task_count) for r in done.report.collect()] == [(13, 4)]


def test_greedy_dedup_like_a_loop(spark):
    rng = np.random.default_rng(4)
    vs = rng.normal(size=(60, 8))
    e = events(spark, [{"id": f"{i:03}", "timestamp": T0 + timedelta(seconds=i), "embedding": [float(np.float32(x)) for x in v]} for i, v in enumerate(vs)])
    kept = []
    for i, v in enumerate(vs):
        v = v.astype(np.float32).astype(float)
        if not any(v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.5 for _, w in kept):
            kept.append((f"{i:03}", v))
    got = vector.greedy_dedup(e.withColumn("k", F.lit(1)), ["k"], 0.5).orderBy("id").collect()
    assert [r.id for r in got] == [i for i, _ in kept]
    assert vector.greedy_dedup(e.limit(20).withColumn("k", F.lit(1)), ["k"], 0.0).count() == 20


def test_nearest_of_more_queries_than_are_sent(spark):
    angle = F.col("id") * 0.001
    q = spark.range(100_001).select(F.col("id").cast("string").alias("query_id"), F.array(F.cos(angle), F.sin(angle)).alias("query"))
    e = events(spark, [{"embedding": [math.cos(i), math.sin(i)]} for i in range(6)])
    got = vector.nearest_of_each(q, e, 1)
    at = np.arange(100_001)
    nearest = np.cos(at[:, None] * 0.001 - np.arange(6)).argmax(1)
    assert {int(r.query_id): int(r.id) for r in got.collect()} == dict(zip(at.tolist(), nearest.tolist(), strict=True))


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_nearest_of_each_like_brute_force(spark, monkeypatch, sent):
    r = np.random.default_rng(3)
    v = [[float(x) for x in r.integers(-2, 3, 4)] for _ in range(90)]  # zero vectors and ties among them
    e = events(spark, [{"embedding": x} for x in v])
    for name, value in (("SENT", sent), ("QUERIES", 7), ("BLOCK", 16)):
        monkeypatch.setattr(vector, name, value)
    q = e.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    u = np.array([np.array(x) / (np.linalg.norm(x) or 1) for x in v])
    for k in (1, 5, 200):
        got = {(x.query_id, x.rank): x.id for x in vector.nearest_of_each(q, e, k).collect()}
        want = {(str(i), n + 1): j for i in range(0, 90, 3) for n, (_, j) in enumerate(sorted((-round(float(u[i] @ u[j]), 12) + 0.0, str(j)) for j in range(90))[:k])}
        assert got == want


def test_vote(spark):
    n = spark.createDataFrame([("q", "A", 0.9), ("q", "B", 0.5), ("q", "B", 0.5), ("q", None, 0.4), ("x", None, 0.9)], "query_id string, category string, score double")
    got = {r.query_id: r for r in vector.vote(n, 0.5).collect()}
    assert got["q"].category == "B" and got["q"].confidence == pytest.approx(1 / 1.9 + 0.1) and got["q"].kind == "rag"
    assert got["x"].category is None and got["x"].confidence == 0.5 and got["x"].kind == "fallback"


def test_rerank(spark):
    p = arm(spark, "a", "b", "c").withColumn("t", F.col("id"))
    order = lambda s: [r.id for r in vector.rerank(p, s, 3, F.col("t")).collect()]
    assert order(None) == ["a", "b", "c"]
    assert order(lambda ts: [ord(t) for t in ts]) == ["c", "b", "a"]
    assert order(lambda ts: [1.0]) == ["a", "b", "c"]


def test_entity_rules(spark):
    d = spark.createDataFrame([("1", "Using Rust and REST in Prague. The Prague office"), ("2", None)], "id string, text string")
    got = sorted((r.name, r.type) for r in entity_graph.rule_entities(d).collect())
    assert got == [("Prague", "project")] * 2 + [("Rust", "project"), ("Using", "project"), ("rest", "concept"), ("rust", "technology")]


def test_relations_and_walk(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "source_entity_id string, target_entity_id string")
    got = {x.id: x.depth for x in entity_graph.neighbours(r, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert got == {"b": 1, "c": 2}
    seen = r.withColumns({"type": F.lit("USES"), "confidence": F.lit(0.5), "timestamp": F.lit(T0)})
    twice = entity_graph.merged_relations(seen.unionByName(seen)).collect()
    assert {round(x.strength, 6) for x in twice} == {1.1}


def test_edges_and_context(spark):
    rows = [{"id": c, "timestamp": T0 + timedelta(minutes=i), "metadata": {"app_name": "My App", "window_title": "w"}, "project": "P x"} for i, c in enumerate("abc")]
    e = temporal_graph.with_sessions(events(spark, rows).withColumn("k", F.lit("u")), ["k"])
    g = {tuple(r) for r in temporal_graph.edges(e, ["k"]).collect()}
    assert ("a", "app:my_app", "ON_APP") in g and ("a", "b", "FOLLOWED_BY") in g and ("b", "c", "FOLLOWED_BY") in g and ("c", "project:p_x", "IN_PROJECT") in g
    c = temporal_graph.context(e, ["k"], temporal_graph.anchor(e, "my app", F.lit(T0 + timedelta(minutes=1))), "before")
    assert sorted((r.id, r.step) for r in c.collect()) == [("a", -1), ("b", 0)]


def test_tasks_from_groups(spark):
    e = events(spark, [{"timestamp": T0 + timedelta(minutes=i), "summary": s, "category": c, "project": "p", "embedding": unit(i)} for i, (s, c) in enumerate([("first", "Coding"), (None, "Coding"), ("third", None)])]).withColumn("cluster", F.lit(0))
    t = tasks.build_tasks(e, ["project", "cluster"], F.lit(T0 + timedelta(days=1))).first()
    assert (t.title, t.category, t.project, t.status, t.duration_minutes, t.activity_count) == ("first", "Coding", "p", "completed", 2.0, 3)
    assert t.embedding[0] == 1.0 and t.activity_ids == ["0", "1", "2"] and t.tags == ["Coding"]


def test_labelled_reply(spark):
    dashed = "TASK_TITLE: A\nACCOMPLISHMENTS:\n- x one\n- y\nDESCRIPTION: B\nMAIN_THEMES: [z, q]"
    d = spark.createDataFrame([("TITLE: A\nDescription: B\nAccomplishments: x; y\nThemes: z",), (dashed,), ("nothing",)], "r string")
    a, m, b = (r[0] for r in d.select(tasks.parsed_analysis(F.col("r"))).collect())
    assert (a.title, a.description, a.accomplishments, a.themes) == ("A", "B", ["x", "y"], ["z"])
    assert (m.title, m.description, m.accomplishments, m.themes) == ("A", "B", ["x one", "y"], ["z", "q"])
    assert b.title is None and b.themes == []


def test_stems(spark):
    from chronolake.functions.stem import stem

    known = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor sized size hopping hop falling fall happy happi relational relat conditional condit digitizer digit hopefulness hope electrical electr adoption adopt controlling control rate rate cease ceas sky sky"
    w = known.split()
    assert [stem(x) for x in w[::2]] == w[1::2]
    d = spark.createDataFrame([("a", "he was hopping"), ("b", "nothing here")], "id string, text string")
    assert [r.id for r in fulltext.bm25(d, "hops", 5, stems=True).collect()] == ["a"]


def test_model_extraction(spark):
    d = spark.createDataFrame([("1", "x" * 101), ("2", "short"), ("3", "y" * 200)], "id string, text string")
    reply = 'Sure: {"entities": [{"name": "Spark", "type": "technology"}, {"name": "Me", "type": "alien"}, {"name": ""}], "relationships": [{"source": "Me", "target": "Spark", "type": "uses"}, {"source": "Me", "target": "None", "type": "x"}]}'
    e, r = entity_graph.model_extraction(d, lambda ps: [reply if "xxx" in p else "sorry" for p in ps])
    assert sorted((x.id, x.name, x.type) for x in e.collect()) == [("1", "Me", "concept"), ("1", "Spark", "technology")]
    known = e.withColumn("entity_id", entity_graph.entity_id())
    assert [(x.source, x.target, x.type) for x in entity_graph.resolved(r, known).collect()] == [("Me", "Spark", "uses")]
    ev = events(spark, [{"summary": "using Rust", "raw_content": "x"}])
    assert {x.name for x in entity_graph.enriched(ev).collect()} == {"rust", "Rust"}


def test_background_polls(spark):
    t = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (0, 15, 50, 51)], "k string, timestamp timestamp")
    got = [(r.timestamp - T0).total_seconds() for r in sequence.background_polls(t, ["k"]).orderBy("timestamp").collect()]
    assert got == [30.0, 45.0]


def test_set_changes(spark):
    s = spark.createDataFrame([("r", T0, []), ("r", T0 + timedelta(minutes=1), ["a.rs"])], "repo string, timestamp timestamp, staged array<string>")
    (r,) = sequence.set_changes(s, "repo", "staged").collect()
    assert r.added == ["a.rs"] and r.removed == []
