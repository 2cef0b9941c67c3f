"""Data sources that read histories, logs, repositories and paged points where they lie: ``register`` names them for
``spark.read.format`` and ``spark.readStream.format``.

Paths are such as the executors see: a shared folder, or the machine's own for a local session."""

from __future__ import annotations

import json
import os
import sqlite3
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


@dataclass
class Span(InputPartition):
    """A stretch of one file, table or list."""

    path: str
    begin: int
    end: int


def _cut(path: str, begin: int, end: int, most: int) -> list[Span]:
    return [Span(path, at, min(at + most, end)) for at in range(begin, end, most)]


# Where browsers keep visits, and under what names.
HISTORIES = {
    "chromium": ("urls", "id", "url string, title string, visit_count long, last_visit_time long", "url, title, visit_count, last_visit_time"),
    "safari_items": ("history_items", "id", "id long, url string, visit_count long", "id, url, visit_count"),
    "safari_visits": ("history_visits", "id", "history_item long, visit_time double, title string", "history_item, visit_time, title"),
}


class BrowserHistory(DataSource):
    """A table of a browser's history file. Options: path; table: chromium, safari_items or safari_visits; rows: how many row
    numbers make a partition. Comparisons with columns are answered by the file. It is opened read-only and as it
    stands, so that a browser which holds it is no hindrance."""

    @classmethod
    def name(cls) -> str:
        return "browser_history"

    def schema(self) -> str:
        return HISTORIES[self.options.get("table", "chromium")][2]

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options)


class _HistoryReader(DataSourceReader):
    SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 100_000))
        self.table, self.key, _, self.columns = HISTORIES[options.get("table", "chromium")]
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        known = set(self.columns.split(", "))
        for f in filters:
            sign = self.SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in known and isinstance(f.value, int | float | str):
                self.where.append((f"{f.attribute[0]} {sign} ?", f.value))
            else:
                yield f

    def _all(self, sql: str, *values) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)
        try:
            yield from con.execute(sql, values)
        finally:
            con.close()

    def partitions(self):
        low, high = next(self._all(f"select min({self.key}), max({self.key}) from {self.table}"))
        return [] if low is None else _cut(self.path, low, high + 1, self.rows)

    def read(self, span: Span):
        tests = "".join(f" and {test}" for test, _ in self.where)
        yield from self._all(f"select {self.columns} from {self.table} where {self.key} >= ? and {self.key} < ?{tests}", span.begin, span.end, *(v for _, v in self.where))


def _lines(span: Span) -> Iterator[tuple[str, str, int]]:
    """The lines that begin in a stretch of a file: (line, path, offset). A last line without an end isn't there yet."""
    with open(span.path, "rb") as f:
        at = span.begin
        f.seek(max(0, at - 1))
        if at and f.read(1) != b"\n":
            at += len(f.readline())
        while at < span.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield line[:-1].decode("utf-8", "replace").rstrip("\r"), span.path, at
            at += len(line)


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))
    return [path] if os.path.exists(path) else []


class GrowingLog(DataSource):
    """Lines of files that grow: (value, path, offset). Options: path, a file or folder; bytes: how many make a partition.

    As a stream, a batch has what has come since the last one, by each file's byte offset, which the checkpoint keeps. A file
    that is shorter than it was has begun anew."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "value string, path string, offset long"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("bytes", 32 << 20))

    def partitions(self):
        return [s for f in _files(self.path) for s in _cut(f, 0, os.path.getsize(f), self.most)]

    def read(self, span: Span):
        return _lines(span)


class _LogStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("bytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: self._whole(f) for f in _files(self.path)}

    @staticmethod
    def _whole(path: str, step: int = 1 << 16) -> int:
        """Bytes up to the last line's end."""
        with open(path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end:
                at = max(0, end - step)
                f.seek(at)
                if (k := f.read(end - at).rfind(b"\n")) >= 0:
                    return at + k + 1
                end = at
        return 0

    def partitions(self, start: dict, end: dict):
        begin = lambda f: start.get(f, 0) if start.get(f, 0) <= end[f] else 0
        return [s for f in sorted(end) for s in _cut(f, begin(f), end[f], self.most)]

    def read(self, span: Span):
        return _lines(span)

    def commit(self, end: dict) -> None:
        pass


# Folders that are never searched for repositories.
NEVER = {"node_modules", "target", "build", "dist", "vendor", "Library", "venv", "__pycache__"}


def repositories_below(root: str, depth: int = 3) -> list[str]:
    """Folders with a .git at most ``depth`` below ``root``; nothing is looked for inside one, or in hidden folders."""
    out, level = [], [root.rstrip("/") or "/"]
    for n in range(depth + 1):
        below = []
        for d in level:
            try:
                names = {e.name: e.is_dir(follow_symlinks=False) for e in os.scandir(d)}
            except OSError:  # a folder that may not be read
                continue
            if ".git" in names:
                out.append(d)
            elif n < depth:
                below += [os.path.join(d, x) for x, is_dir in sorted(names.items()) if is_dir and x not in NEVER and not x.startswith(".")]
        level = below
    return sorted(out)


class GitCommits(DataSource):
    """Commits of all repositories below a folder, a partition for each: (repo, hash, timestamp, message, files_changed, lines_changed).
    Options: path; depth; since, a time that git reads; most, of each repository the newest so many."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "repo string, hash string, timestamp timestamp, message string, files_changed array<string>, lines_changed int"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)


class _CommitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.depth, self.since, self.most = options["path"], int(options.get("depth", 3)), options.get("since"), options.get("most")

    def partitions(self):
        return [Span(r, 0, 1) for r in repositories_below(self.path, self.depth)]

    def read(self, span: Span):
        from datetime import datetime, timezone

        ask = ["git", "-c", "safe.directory=*", "-C", span.path, "log", "--no-merges", "--numstat", "-z", "--format=%x01%H%x02%ct%x02%B%x02"]
        ask += [f"--since={self.since}"] if self.since else []
        ask += [f"--max-count={int(self.most)}"] if self.most else []
        done = subprocess.run(ask, capture_output=True, check=False)
        for part in done.stdout.decode("utf-8", "replace").split("\x01")[1:]:
            hash_, at, message, changes = part.split("\x02", 3)
            files, lines, todo = [], 0, [x.lstrip("\n") for x in changes.split("\0")]
            while todo:
                cell = todo.pop(0).split("\t")
                if len(cell) == 3:
                    lines += sum(int(x) for x in cell[:2] if x.isdigit())  # "-" for binary files
                    if not cell[2] and len(todo) > 1:  # renamed: the old name, then the new one
                        cell[2], todo = todo[1], todo[2:]
                    files.append(cell[2])
            yield span.path, hash_, datetime.fromtimestamp(int(at), timezone.utc), message.strip(), files, lines


class PagedPoints(DataSource):
    """Points of a vector store that hands them out in pages: (id, vector, payload), the payload as JSON. Options: path, a folder of
    pages as the store answers them, ``{"result": {"points": [...], "next_page_offset": ...}}``, named by the cursor that asks for
    them (``first.json`` for the first); columns that aren't there are null.

    The chain of cursors is followed once, by the driver, and holds no points; each page is then a partition."""

    @classmethod
    def name(cls) -> str:
        return "paged_points"

    def schema(self) -> str:
        return "id string, vector array<float>, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def _page(self, cursor: str) -> dict:
        with open(os.path.join(self.path, f"{cursor}.json"), encoding="utf-8") as f:
            return json.load(f)["result"]

    def partitions(self):
        out, cursor = [], "first"
        while cursor is not None:
            if any(s.path == cursor for s in out):
                raise ValueError(f"the cursor {cursor} leads round")
            out.append(Span(cursor, 0, 1))
            following = self._page(cursor).get("next_page_offset")
            cursor = None if following is None else str(following)
        return out

    def read(self, span: Span):
        for p in self._page(span.path).get("points") or ():
            v = p.get("vector")
            yield str(p["id"]), None if v is None else [float(x) for x in v], json.dumps(p.get("payload") or {}, sort_keys=True)


def register(spark: SparkSession) -> None:
    """Make the sources known by their names, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BrowserHistory, GrowingLog, GitCommits, PagedPoints):
        spark.dataSource.register(source)
