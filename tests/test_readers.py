"""Sources read where they lie: files that the test writes."""

import json
import sqlite3
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolake.sources import history, readers


@pytest.fixture(autouse=True)
def known(spark):
    readers.register(spark)


@pytest.fixture
def chrome(tmp_path):
    con = sqlite3.connect(tmp_path / "History")
    con.execute("create table urls (id integer primary key, url text, title text, visit_count integer, last_visit_time integer)")
    base = (1_780_000_000 + history.CHROMIUM_EPOCH) * 1_000_000
    con.executemany("insert into urls values (?, ?, ?, ?, ?)", [(i, f"https://x{i % 5}.org/{i}", None if i % 4 == 0 else f"T{i}", i % 3, base + i * 60_000_000) for i in range(1, 1001)])
    con.commit()
    con.close()
    return str(tmp_path / "History"), base


def test_history_file_in_ranges(spark, chrome):
    path, base = chrome
    t = spark.read.format("browser_history").option("path", path).option("rows", 150).load()
    assert t.count() == 1000 and t.rdd.getNumPartitions() == 7
    some = t.filter(F.col("last_visit_time") > base + 990 * 60_000_000).filter("visit_count >= 1 and title is not null")
    assert some.count() == len([i for i in range(991, 1001) if i % 3 >= 1 and i % 4])
    got = history.chromium(t, F.timestamp_seconds(F.lit(1_780_000_000 + 995 * 60)), "chrome")
    assert [r.url for r in got.collect()] == [f"https://x{i % 5}.org/{i}" for i in range(1000, 995, -1)]


def test_filters_reach_the_file(chrome):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    r = readers._HistoryReader({"path": chrome[0], "rows": "400"})
    rest = list(r.pushFilters([GreaterThan(("visit_count",), 1), EqualTo(("url",), "https://x0.org/5"), StringContains(("url",), "x"), GreaterThan(("other",), 1)]))
    assert [type(f).__name__ for f in rest] == ["StringContains", "GreaterThan"]
    assert [row[0] for s in r.partitions() for row in r.read(s)] == ["https://x0.org/5"]


def test_safari_tables(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "h.db")
    con.execute("create table history_items (id integer primary key, url text, visit_count integer)")
    con.execute("create table history_visits (id integer primary key, history_item integer, visit_time real, title text)")
    con.executemany("insert into history_items values (?, ?, ?)", [(1, "https://a.org/x", 2), (2, "https://b.org", 1)])
    con.executemany("insert into history_visits values (?, ?, ?, ?)", [(1, 1, 700_000_000.5, "A"), (2, 2, 700_000_001.0, None), (3, 1, 1.0, "old")])
    con.commit()
    con.close()
    read = lambda name: spark.read.format("browser_history").option("path", str(tmp_path / "h.db")).option("table", name).load()
    got = history.safari(read("safari_visits"), read("safari_items"), F.to_timestamp(F.lit("2020-01-01")))
    assert [(r.url, r.title) for r in got.collect()] == [("https://b.org", "Untitled"), ("https://a.org/x", "A")]


def test_log_as_batch_in_small_ranges(spark, tmp_path):
    lines = [f'{{"n": {i}, "x": "{"é" * (i % 40)}"}}' for i in range(300)]
    (tmp_path / "log").write_text("\n".join(lines) + "\nunfinished")
    for size in (1, 7, 100, 10**6):
        got = spark.read.format("growing_log").option("path", str(tmp_path / "log")).option("bytes", max(size, 50)).load().orderBy("offset").collect()
        assert [r.value for r in got] == lines
    assert [x[0] for s in readers._cut(str(tmp_path / "log"), 0, 400, 3) for x in readers._lines(s)] == [x for x in lines if sum(len(y.encode()) + 1 for y in lines[: lines.index(x)]) < 400]


def test_log_as_stream_goes_on_where_it_stopped(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    seen = []

    def run():
        s = spark.readStream.format("growing_log").option("path", str(d)).option("bytes", 64).load()
        s.writeStream.foreachBatch(lambda df, n: seen.extend(r.value for r in df.orderBy("path", "offset").collect())).option("checkpointLocation", str(tmp_path / "mark")).trigger(once=True).start().awaitTermination(60)
        out = list(seen)
        seen.clear()
        return out

    (d / "a").write_text("1\n2\nhal")
    assert run() == ["1", "2"]
    with open(d / "a", "a") as f:
        f.write("f\n3\n")
    (d / "b").write_text("".join(f"line {i}\n" for i in range(50)))
    assert run() == ["half", "3", *(f"line {i}" for i in range(50))]
    (d / "a").write_text("new\n")  # begun anew
    assert run() == ["new"]


def test_commits_of_repositories(spark, tmp_path):
    def git(repo, *args):
        env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "GIT_AUTHOR_DATE": "2026-06-01T10:00:00Z", "GIT_COMMITTER_DATE": "2026-06-01T10:00:00Z", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
        subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env)

    for name in ("one", "deep/er/two", "node_modules/three", "deep/er/too/far/away", ".hidden/four"):
        r = tmp_path / "src" / name
        r.mkdir(parents=True)
        git(r, "init", "-q")
        (r / "a b.txt").write_text("1\n2\n")
        git(r, "add", ".")
        git(r, "commit", "-q", "-m", f"first of {name}\n\nand more")
    r = tmp_path / "src" / "one"
    git(r, "mv", "a b.txt", "c.txt")
    (r / "d.bin").write_bytes(bytes(range(256)))
    git(r, "add", ".")
    git(r, "commit", "-q", "-m", "renamed")
    src = str(tmp_path / "src")
    assert readers.repositories_below(src) == [f"{src}/deep/er/two", f"{src}/one"]
    t = spark.read.format("git_commits").option("path", src).load()
    got = {(c.repo[len(src) + 1 :], c.message.split("\n")[0]): (sorted(c.files_changed), c.lines_changed, c.timestamp) for c in t.collect()}
    at = datetime(2026, 6, 1, 10)
    assert got == {("one", "first of one"): (["a b.txt"], 2, at), ("one", "renamed"): (["c.txt", "d.bin"], 0, at), ("deep/er/two", "first of deep/er/two"): (["a b.txt"], 2, at)}
    assert spark.read.format("git_commits").option("path", src).option("most", 1).load().count() == 2


def test_pages_by_cursor(spark, tmp_path):
    for name, ids, then in (("first", [1, 2], "abc"), ("abc", [3], 7), ("7", [], None)):
        points = [{"id": i, "vector": [i, 0.5], "payload": {"type": "note", "n": i}} for i in ids]
        (tmp_path / f"{name}.json").write_text(json.dumps({"result": {"points": points, "next_page_offset": then}}))
    t = spark.read.format("paged_points").option("path", str(tmp_path)).load()
    assert t.rdd.getNumPartitions() == 3 and sorted((r.id, r.vector, json.loads(r.payload)["n"]) for r in t.collect()) == [("1", [1.0, 0.5], 1), ("2", [2.0, 0.5], 2), ("3", [3.0, 0.5], 3)]
    (tmp_path / "7.json").write_text('{"result": {"points": [], "next_page_offset": "abc"}}')
    with pytest.raises(Exception, match="leads round"):
        spark.read.format("paged_points").option("path", str(tmp_path)).load().count()
