"""Shell and browser histories as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import domain_of, epoch_micros, is_banking, video_title
from ..schema import stable_id

#: Seconds from the browsers' own epochs to 1970: 1601 for Chromium, 2001 (so negative) for Safari.
CHROMIUM_EPOCH = 11_644_473_600
SAFARI_EPOCH = -978_307_200


def chromium(urls: DataFrame, since: Column, browser: str, limit: int | None = 1000) -> DataFrame:
    """(timestamp, title, url, domain, visit_count, browser) of a Chromium ``urls`` table (url, title, last_visit_time in
    microseconds since 1601, visit_count) after ``since``, newest first. Banking domains are left out, a null title is Untitled."""
    t = urls.withColumn("timestamp", epoch_micros("last_visit_time", CHROMIUM_EPOCH)).filter(F.col("timestamp") > since)
    t = t.withColumn("domain", domain_of("url")).filter(~is_banking("domain"))
    t = t.select("timestamp", video_title(F.coalesce("title", F.lit("Untitled")), "url").alias("title"), "url", "domain", "visit_count", F.lit(browser).alias("browser"))
    t = t.orderBy(F.desc("timestamp"), "url")
    return t if limit is None else t.limit(limit)


def safari(visits: DataFrame, items: DataFrame, since: Column, limit: int | None = 1000, epoch: int = SAFARI_EPOCH) -> DataFrame:
    """The same of Safari's visits (history_item, visit_time in seconds, title) and items (id, url, visit_count)."""
    v = visits.withColumn("timestamp", epoch_micros((F.col("visit_time") * 1_000_000).cast("long"), epoch)).filter(F.col("timestamp") > since)
    i = items.select(F.col("id").alias("_item"), "url", "visit_count")
    t = v.join(i, F.col("history_item") == F.col("_item")).withColumn("domain", domain_of("url")).filter(~is_banking("domain"))
    t = t.select("timestamp", video_title(F.coalesce("title", F.lit("Untitled")), "url").alias("title"), "url", "domain", "visit_count", F.lit("safari").alias("browser"))
    t = t.orderBy(F.desc("timestamp"), "url")
    return t if limit is None else t.limit(limit)


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all sources, newest first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(F.desc("timestamp"))


def zsh(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """(timestamp, command, shell) of an extended zsh history: ': <epoch>:<elapsed>;<command>'."""
    return zsh_lines(spark.read.text(path), since)


def zsh_lines(lines: DataFrame, since: Column) -> DataFrame:
    """The same of its lines (value)."""
    t = lines.filter(F.col("value").startswith(": "))
    t = t.select(F.timestamp_seconds(F.expr("try_cast(regexp_extract(value, '^: ([0-9]+):', 1) as bigint)")).alias("timestamp"), F.trim(F.regexp_extract("value", r"^: [0-9]+:[0-9]*;(.*)$", 1)).alias("command"), F.lit("zsh").alias("shell"))
    return t.filter((F.col("timestamp") >= since) & (F.col("command") != ""))


def bash(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The same of a bash history: no blank lines or comments, every row at its file's time; with ``last``, each file's last
    so many lines."""
    return bash_texts(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("timestamp")), last)


def bash_texts(files: DataFrame, last: int | None = None) -> DataFrame:
    """The same of whole files (value, timestamp)."""
    t = files.select("timestamp", F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("l"))
    t = t if last is None else t.withColumn("l", F.when(F.size("l") > last, F.slice("l", -last, last)).otherwise(F.col("l")))
    return t.select("timestamp", F.explode("l").alias("command")).select("timestamp", F.trim("command").alias("command"), F.lit("bash").alias("shell"))


def fish(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The same of a fish history: blocks of '- cmd: ' with a 'when: <epoch>' line; without it the row is at ``now``."""
    return fish_blocks(spark.read.text(path, lineSep="- cmd: "), now)


def fish_blocks(blocks: DataFrame, now: Column) -> DataFrame:
    """The same of what stands between one '- cmd: ' and the next (value)."""
    t = blocks.filter(F.trim("value") != "")
    when = F.timestamp_seconds(F.expr("try_cast(regexp_extract(value, 'when: ([0-9]+)', 1) as bigint)"))
    return t.select(F.coalesce(when, now).alias("timestamp"), F.trim(F.split_part("value", F.lit("\n"), F.lit(1))).alias("command"), F.lit("fish").alias("shell")).filter("command <> ''")


def browser_events(visits: DataFrame) -> DataFrame:
    """Visits as events."""
    return visits.select(
        stable_id(F.lit("browser"), "browser", "url", "timestamp").alias("id"), "timestamp", F.to_date("timestamp").alias("date"), F.lit("browser").alias("event_type"), F.col("browser").alias("source"),
        F.to_json(F.struct("title", "url", "domain", "visit_count")).alias("raw_content"),
        F.create_map(F.lit("domain"), F.col("domain"), F.lit("visit_count"), F.col("visit_count").cast("string"), F.lit("browser"), F.col("browser")).alias("metadata"),
    )


def terminal_events(commands: DataFrame) -> DataFrame:
    """Commands as events; equal ones at one time are numbered apart."""
    n = F.row_number().over(Window.partitionBy("shell", "timestamp", "command").orderBy(F.lit(1)))
    return commands.withColumn("_n", n).select(
        stable_id(F.lit("terminal"), "shell", "timestamp", "command", "_n").alias("id"), "timestamp", F.to_date("timestamp").alias("date"), F.lit("terminal").alias("event_type"), F.col("shell").alias("source"),
        F.to_json(F.struct("command")).alias("raw_content"),
        F.create_map(F.lit("shell"), F.col("shell"), F.lit("command_length"), F.length("command").cast("string")).alias("metadata"),
    )
