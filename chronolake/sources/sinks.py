"""Tables on disk: appended logs whose latest row counts, and summaries as files."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, EVENT, HOUR, NODE, SEEN, TAIL, TASK, conform, latest


class Store:
    """Events, tasks and summaries below one folder, as Parquet; events lie by date, all tables by version.

    A version is a whole number that grows with every write, whoever makes it: ``version`` takes the next one by creating a
    file that only one writer can create. Writes only append rows under their version, and reads take each key's row of the
    greatest one; so the newest write wins, after a renewed checkpoint too, and a batch that runs again gets the number
    that it had. A mark (table, part, version) in the same folder says that what is older in that part counts no longer:
    deleting a day is a mark, replacing it a mark and rows, and folding a part the same with the rows that count. The parts of
    events are dates; an event's date never changes, so a read of some dates touches only these."""

    KEYS = {"events": ["id", "chunk_index"], "tasks": ["id"], "hours": ["date", "hour"], "pending": ["id"], "nodes": ["id"], "edges": ["src_id", "dst_id", "type"], "tails": ["key"], "seen": ["date", "hour"]}
    SCHEMAS = {"events": EVENT, "tasks": TASK, "hours": HOUR, "pending": EVENT, "nodes": NODE, "edges": EDGE, "tails": TAIL, "seen": SEEN}

    #: Tables that are read by parts, and the column that names these.
    PARTS = {"events": "date"}

    #: Options of the Parquet writer, by table.
    OPTIONS: dict[str, dict[str, str]] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def passing(self) -> Store:
        """This store, which goes when the application ends."""
        fs, p = self._file()
        fs.deleteOnExit(p)
        return self

    def _file(self, *parts: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _log(self) -> list[list[str]]:
        """[number, kind, ...] of all versions taken and marks set, by number."""
        fs, p = self._file("_versions")
        if not fs.exists(p):
            return []
        return sorted([unquote(x) for x in f.getPath().getName().split(",")] for f in fs.listStatus(p))

    def version(self, writer: str = "", batch: int | None = None) -> int:
        """The number for a write: greater than all before it. ``writer``'s ``batch`` gets the same one whenever it runs again."""
        log = self._log()
        if batch is not None:
            for n, kind, *rest in reversed(log):
                if kind == "batch" and rest == [writer, str(batch)]:
                    return int(n)
        n = int(log[-1][0]) if log else 0
        while True:
            n += 1
            fs, taken = self._file("_versions", f"{n:015d},taken")
            if fs.createNewFile(taken):  # false where another writer was faster
                if batch is not None:
                    fs.createNewFile(self._file("_versions", f"{n:015d},batch,{quote(writer, safe='')},{batch}")[1])
                return n

    def marks(self, table: str) -> dict[str, int]:
        """Each part's newest mark: what is older there counts no longer."""
        return {rest[1]: int(n) for n, kind, *rest in self._log() if kind == "mark" and rest[0] == table}

    def mark(self, table: str, parts: Iterable[str], version: int) -> None:
        for part in parts:
            fs, p = self._file("_versions", f"{version:015d},mark,{quote(table, safe='')},{quote(part, safe='')}")
            fs.createNewFile(p)

    def append(self, table: str, rows: DataFrame, version: int) -> None:
        """Add rows under a version. A batch that runs again replaces the files that it wrote under its number, and no others."""
        t = conform(rows, self.SCHEMAS[table])
        if table in ("events", "pending"):
            t = t.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0)))
        by = [self.PARTS[table], "_version"] if table in self.PARTS else ["_version"]
        t.withColumn("_version", F.lit(version).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**self.OPTIONS.get(table, {})).partitionBy(*by).parquet(f"{self.path}/{table}")

    def raw(self, table: str, dates: Iterable[str] | None = None) -> DataFrame:
        """All versions of all rows; of ``dates`` (or other parts) only, which are then the only folders that are listed and read."""
        from pyspark.errors import AnalysisException

        schema = self.SCHEMAS[table]
        schema = type(schema)([*schema.fields]).add("_version", "long")
        top = f"{self.path}/{table}"
        dates = None if dates is None else sorted(set(dates))
        where = top if dates is None else f"{top}/{self.PARTS[table]}={{{','.join(dates)}}}"
        try:
            if dates == []:
                return self._none(schema)
            return self.spark.read.schema(schema).option("basePath", top).parquet(where).select(*schema.names)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._none(schema)

    def _none(self, schema) -> DataFrame:
        """No rows, known to the optimizer, so that what reads them starts no tasks."""
        return self.spark.range(0).filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))

    def read(self, table: str, dates: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """Each key's newest row. ``dates``: of events, those days. ``before``: as things stood before that version."""
        t, marks = self.raw(table, dates), self.marks(table)
        if before is not None:
            t, marks = t.filter(F.col("_version") < before), {p: n for p, n in marks.items() if n < before}
        if table != "events":
            t = t.filter(F.col("_version") >= marks.get("", 0))  # a partition filter: older folders aren't read
        elif marks := {p: n for p, n in marks.items() if dates is None or p in set(dates)}:
            m = self.spark.createDataFrame(list(marks.items()), "_part string, _mark bigint")  # a row for each day at most
            t = t.join(F.broadcast(m), F.date_format("date", "yyyy-MM-dd") == F.col("_part"), "left").filter("_mark is null or _version >= _mark").drop("_part", "_mark")
        return latest(t, self.KEYS[table], "_version").drop("_version")

    def dates(self) -> list[str]:
        """The days that events lie in."""
        fs, p = self._file("events")
        return sorted(f.getPath().getName()[5:] for f in fs.listStatus(p) if f.getPath().getName().startswith("date=")) if fs.exists(p) else []

    def replace_days(self, rows: DataFrame, dates: Iterable[str] | None = None) -> None:
        """Let ``rows`` be all events of ``dates``, or of the dates that they have. ``rows`` may read what they replace: nothing
        is overwritten."""
        dates = [str(r.date) for r in rows.select("date").distinct().collect() if r.date] if dates is None else list(dates)
        n = self.version()
        self.append("events", rows, n)
        self.mark("events", dates, n)

    def delete_day(self, date: str) -> None:
        """All events of a day; what is written for it later counts."""
        self.mark("events", [date], self.version())

    def fold(self, table: str, dates: Iterable[str] | None = None, keep: Column | None = None) -> None:
        """Write what counts of a table, of events for ``dates``, as one version, and mark it; only rows where ``keep`` holds."""
        n = self.version()
        t = self.read(table, dates, before=n)
        self.append(table, t if keep is None else t.filter(keep), n)
        self.mark(table, (self.dates() if dates is None else dates) if table == "events" else [""], n)

    def vacuum(self, batches: int = 1000) -> None:
        """Delete the folders of versions that count no longer, and what the log says of them. Readers that began earlier must
        be done. Numbers of the last ``batches`` versions stay in the log, so that batches of these can run again."""
        for table in self.SCHEMAS:
            for part, n in self.marks(table).items():
                fs, p = self._file(table, *([f"{self.PARTS[table]}={part}"] if part else []))
                for f in fs.listStatus(p) if fs.exists(p) else ():
                    name = f.getPath().getName()
                    if name.startswith("_version=") and int(name[9:]) < n:
                        fs.delete(f.getPath(), True)
        log, newest = self._log(), {}
        for n, kind, *rest in log:
            if kind != "taken":
                newest[(kind, *(rest if kind == "mark" else rest[:1]))] = n
        for n, kind, *rest in log:
            if int(n) <= int(log[-1][0]) - batches and (kind == "taken" or newest[(kind, *(rest if kind == "mark" else rest[:1]))] != n):
                fs, p = self._file("_versions", ",".join(quote(x, safe="") for x in (n, kind, *rest)))
                fs.delete(p, False)


def dated(tasks: DataFrame) -> DataFrame:
    """Tasks with the ``date`` of the folder that they are written to."""
    return tasks.withColumn("date", F.to_date("start_time"))


def write_tasks_by_date(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON, a folder for each date; the dates written replace what they held."""
    dated(tasks).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)


def summary_markdown() -> Column:
    """A day's summary (date, total, categories, top_projects) as Markdown."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Summary of "), F.date_format("date", "MMMM dd, yyyy")),
        F.lit(""),
        F.concat(F.lit("Events: "), F.col("total").cast("string")),
        F.concat(F.lit("Categories: "), F.col("categories")),
        F.concat(F.lit("Projects: "), F.col("top_projects")),
    )


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Daily summaries as JSON and as Markdown."""
    summaries.write.mode("overwrite").json(f"{path}/json")
    summaries.select(summary_markdown().alias("value")).write.mode("overwrite").text(f"{path}/markdown", lineSep="\n\n")


def not_excluded(events: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Events but for those whose metadata domain is excluded (domain)."""
    x = exclusions.select(F.lower("domain").alias("_x")).distinct()
    return events.join(x, F.lower(F.col("metadata")["domain"]) == F.col("_x"), "left_anti")
