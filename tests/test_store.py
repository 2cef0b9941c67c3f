"""The versioned store, and what a cycle reads and writes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import temporal_graph
from chronolake.schema import EVENT, conform
from chronolake.sources.sinks import Store
from chronolake.streaming import ingest

T0 = datetime(2026, 6, 1, 9)
SCHEMA = "id string, timestamp timestamp, event_type string, raw_content string, source string, project string, metadata map<string,string>"


def events(spark, rows):
    """rows: (id, minutes after T0, source, text)"""
    full = [(i, T0 + timedelta(minutes=m), "window", t, s, "p", {"app_name": f"app {s}"}) for i, m, s, t in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("date", F.to_date("timestamp"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"))


def texts(store, **more):
    return {r.id: r.raw_content for r in store.read("events", **more).collect()}


def test_versions_grow_whoever_writes(spark, store):
    a = store.version("stream", 7)
    b = store.version()
    c = Store(spark, store.path).version("other stream/~", 0)
    assert a < b < c and store.version("stream", 7) == a and store.version("other stream/~", 0) == c and store.version("stream", 8) > c


def test_newest_row_wins(spark, store):
    """A renewed checkpoint counts batches from 0 again, and days are replaced meanwhile."""
    run = ingest.ingest_batch(store, ingest.hashed_vectors(), writer="first checkpoint")
    run(events(spark, [("e1", 0, "a", "first")]), 5)
    store.replace_days(events(spark, [("e1", 0, "a", "replaced")]))
    assert texts(store) == {"e1": "replaced"}
    again = ingest.ingest_batch(store, ingest.hashed_vectors(), writer="second checkpoint")
    again(events(spark, [("e1", 0, "a", "second")]), 0)
    assert texts(store) == {"e1": "second"}
    again(events(spark, [("e1", 0, "a", "third")]), 1)
    assert texts(store) == {"e1": "third"}
    again(events(spark, [("e1", 0, "a", "second")]), 0)  # a batch that runs once more changes nothing
    assert texts(store) == {"e1": "third"}


def test_days_are_deleted_replaced_and_folded(spark, store):
    day = 24 * 60
    store.append("events", events(spark, [("a", 0, "s", "1"), ("b", 1, "s", "1"), ("c", day, "s", "1")]), store.version())
    store.append("events", events(spark, [("a", 0, "s", "2")]), store.version())
    store.delete_day("2026-06-02")
    assert texts(store) == {"a": "2", "b": "1"} and store.raw("events").count() == 4
    store.append("events", events(spark, [("d", day, "s", "later")]), store.version())
    assert texts(store) == {"a": "2", "b": "1", "d": "later"} and texts(store, dates=["2026-06-02"]) == {"d": "later"} and texts(store, dates=[]) == {}
    store.replace_days(store.read("events", ["2026-06-01"]).filter("id = 'a'").withColumn("raw_content", F.lit("3")))  # reads what it replaces
    before = store.version()
    assert texts(store) == {"a": "3", "d": "later"}
    store.append("events", events(spark, [("a", 0, "s", "4")]), store.version())
    assert texts(store, before=before) == {"a": "3", "d": "later"}
    store.fold("events")
    store.vacuum()
    assert texts(store) == {"a": "4", "d": "later"} and store.raw("events").count() == 2
    assert store.dates() == ["2026-06-01", "2026-06-02"]


def test_log_is_cut(store):
    for n in range(30):
        store.version("w", n)
    last = store.version("v", 0)
    store.vacuum(batches=5)
    assert len(store._log()) < 16 and store.version("v", 0) == last and store.version() == last + 1


def _edges(store):
    return sorted(tuple(r) for r in store.read("edges").collect())


def test_batches_give_the_graph_of_all_rows(spark, store):
    rows = [(f"e{n:03}", m, "ab"[n % 3 == 0], "x") for n, m in enumerate(sorted([*range(0, 60, 3), *range(75, 90), *range(101, 140, 11), *range(400, 420)]))]
    run = ingest.cycle(store, ingest.hashed_vectors(), lambda: "2026-06-01T00:00:00")
    for n, at in enumerate(range(0, len(rows), 23)):
        run(events(spark, rows[at : at + 23]), n)
    all_at_once = temporal_graph.edges(temporal_graph.with_sessions(conform(events(spark, rows), EVENT), ["source"]), ["source"])
    want = sorted(tuple(r) for r in all_at_once.select("src_id", "dst_id", "type").collect())
    assert _edges(store) == want and {t for *_, t in want} >= {"DURING", "FOLLOWED_BY", "ON_APP"}
    run(events(spark, rows[at : at + 23]), n)  # the last batch runs again
    assert _edges(store) == want and store.read("tails").count() == 2


def test_late_events_join_the_open_session(spark, store):
    run = ingest.cycle(store, ingest.hashed_vectors(), lambda: "2026-06-01T00:00:00")
    run(events(spark, [("a", 0, "s", "x"), ("b", 60, "s", "x")]), 0)
    run(events(spark, [("late", 30, "s", "x"), ("c", 65, "s", "x")]), 1)
    during = {(s, d) for s, d, t in _edges(store) if t == "DURING"}
    assert during == {("a", "session:s:1"), ("b", "session:s:2"), ("late", "session:s:2"), ("c", "session:s:2")}
    assert [(s, d) for s, d, t in _edges(store) if t == "FOLLOWED_BY"] == [("b", "late"), ("late", "c")]


def test_sessions_of_null_sources(spark):
    e = events(spark, [("a", 0, None, "x"), ("b", 1, "", "x"), ("c", 2, "s", "x")])
    got, tails = temporal_graph.continued(e, spark.createDataFrame([], "key string, session bigint, session_id string, last_second bigint, last_id string"), "source")
    assert {r.id: (r.session_id, r.previous) for r in got.collect()} == {"a": ("session::1", None), "b": ("session::1", "a"), "c": ("session:s:1", None)}
    assert sorted((r.key, r.last_id) for r in tails.collect()) == [("", "b"), ("s", "c")]


def _rows_read(spark, do):
    """Rows that all stages of ``do`` read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).inputRecords() for i in range(stages.size())}

    before = set(total())
    do()
    return sum(n for k, n in total().items() if k not in before)


def test_cost_of_a_batch_does_not_grow_with_history(spark, store):
    """A batch of 20 events after 200 stored ones and after 2200: as many rows read, and the old days' files aren't opened."""
    now = "2026-06-01T09:30:00"
    run = ingest.cycle(store, ingest.hashed_vectors(), lambda: now)
    batch = lambda n, minutes: events(spark, [(f"{n}-{k}", minutes + k, "u", f"text {k}") for k in range(20)])
    run(batch(0, 0), 0)
    few = _rows_read(spark, lambda: run(batch(2, 50), 2))
    many = events(spark, [(f"old-{k}", 60 * 24 * (k % 9) - 10_000, "u", f"text {k}") for k in range(2000)])
    ingest.ingest_batch(store, ingest.hashed_vectors(), writer="import")(many, 0)
    rest = _rows_read(spark, lambda: run(batch(3, 75), 3))
    assert 0 < rest < few + 60
    stored = sum(r["count"] for r in store.raw("events").groupBy("date").count().collect())
    assert stored == 2060 and store.read("nodes").count() == 60


def test_finished_hours_are_summed_once(spark, store):
    now = ["2026-06-01T09:30:00"]
    run = ingest.cycle(store, ingest.hashed_vectors(), lambda: now[0])
    run(events(spark, [("a", 0, "s", "x"), ("b", 10, "s", "y")]), 0)
    assert store.read("hours").count() == 0
    now[0] = "2026-06-01T11:05:00"
    run(events(spark, [("c", 70, "s", "z"), ("d", 121, "s", "z")]), 1)
    got = {r.hour: r.event_count for r in store.read("hours").collect()}
    assert got == {9: 2, 10: 1}
    run(events(spark, [("e", 122, "s", "z")]), 2)
    assert store.read("hours").count() == 2 and store.raw("hours").count() == 2


def test_small_tables_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD", 2)
    run = ingest.cycle(store, ingest.hashed_vectors(), lambda: "2026-06-01T12:30:00")
    for n in range(2):
        run(events(spark, [(f"e{n}", n, "s", "x"), (f"f{n}", n, f"s{n}", "x")]), n)
    assert store.read("tails").count() == 3 and store.marks("tails")[""] > 2
    store.vacuum()
    assert store.raw("tails").count() == 3 and {r.last_id for r in store.read("tails").collect()} == {"e1", "f0", "f1"}


def test_models_are_asked_once_a_batch(spark, store, tmp_path):
    asked = str(tmp_path / "asked")

    def embed(xs):
        with open(asked, "a") as f:
            f.write("".join(f"{x}\n" for x in xs))
        return [[1.0] for _ in xs]

    ingest.ingest_batch(store, embed)(events(spark, [("a", 0, "s", "x"), ("b", 1, "s", "y")]), 0)
    assert len(open(asked).read().split("\n")) == 3
