"""Scans in time blocks give the rows of scans of whole keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import asof, sequence

T0 = datetime(2026, 6, 1)
SCHEMA = "id string, timestamp timestamp, user string, app string"


@pytest.fixture(scope="module")
def events(spark):
    """One key with nearly all rows, gaps of hours, ties in time, a null key."""
    r, rows, t = random.Random(4), [], 0.0
    for i in range(600):
        t += r.choice((0, 0.4, 5, 60, 599, 600, 601, 5000, 90_000))
        user = "hot" if i % 7 else r.choice((None, "a"))
        rows.append((f"e{i % 50:02}{i:03}", T0 + timedelta(seconds=t), user, r.choice("xy")))
    return spark.createDataFrame(rows, SCHEMA).cache()


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("width", [50, 3600, 10**9])
def test_blocks_give_what_whole_keys_give(events, width):
    now = F.to_timestamp(F.lit("2027-01-01 00:00:00"))
    for whole in (False, True):
        assert rows(asof.long_sessions(events, ["user"], 600, whole, width)) == rows(sequence.gap_sessions(events, ["user"], 600, whole))
    assert rows(asof.long_focus_runs(events, ["user"], ["app"], 30, width)) == rows(sequence.focus_runs(events, ["user"], ["app"], 30))
    assert rows(asof.long_row_durations(events, ["user"], now, 4, width)) == rows(sequence.row_durations(events, ["user"], now, 4))


def test_a_hot_key_is_many_groups(events):
    n = [r["count"] for r in asof.in_blocks(events).groupBy("user", "_block").count().collect()]
    assert max(n) < events.count() / 8


@pytest.mark.parametrize("width", [50, 3600, 10**9])
def test_nearest_like_brute_force(spark, events, width):
    all_ = events.collect()
    anchors = [r for r in all_ if r.app == "x"]
    others = [r for r in all_ if r.app == "y"]
    got = {r.id: (r.nearest_id, r.seconds) for r in asof.nearest_in_time(events.filter("app = 'x'"), events.filter("app = 'y'"), ["user"], width).collect()}
    assert len(got) == len(anchors)
    sec = lambda r: int(r.timestamp.timestamp() // 1)
    for a in anchors:
        best = min((abs(sec(o) - sec(a)), o.timestamp, o.id) for o in others if o.user == a.user)
        assert got[a.id] == (best[2], best[0]), a
    none = asof.nearest_in_time(events.filter("app = 'x'"), events.limit(0), ["user"], width)
    assert none.filter("nearest_id is null and seconds is null").count() == len(anchors)


def test_nearest_goes_through_a_block_once(spark):
    """A frame that ends with its block would be read anew for each row."""
    e = spark.range(10).selectExpr("cast(id as string) as id", "timestamp_seconds(id * 7) as timestamp")
    plan = asof.nearest_in_time(e, e, [], 3600)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "currentrow" in plan and "unboundedfollowing" not in plan
