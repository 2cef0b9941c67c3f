"""Tasks built from groups of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import stable_id
from .rollup import mean_vector, modes


def fallback_analysis(events: DataFrame, keys: list[str]) -> DataFrame:
    """What rules alone say of each group: the first three texts (summary, else content; 120 characters each), a title from
    the first, the commonest category as theme, and whole minutes from first to last event. Confidence 0.4."""
    text = F.left(F.coalesce("summary", "raw_content"), F.lit(120))
    w = Window.partitionBy(*keys).orderBy("timestamp", "id")
    e = events.withColumn("_t", text)
    first = e.filter("_t <> ''").withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("accomplishments"))
    span = e.groupBy(*keys).agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").cast("int").alias("activity_count"))
    out = _on(_on(span, first, keys), modes(events, keys, "category").withColumnRenamed("mode", "category"), keys)
    theme = F.coalesce("category", F.lit("General"))
    none = F.concat(F.col("activity_count").cast("string"), F.lit(" "), F.lower(theme), F.lit(" activities"))
    return out.select(
        *keys, "category", "start_time", "end_time", "activity_count", F.coalesce("accomplishments", F.array().cast("array<string>")).alias("accomplishments"),
        F.coalesce(F.left(F.col("accomplishments")[0], F.lit(50)), F.concat(theme, F.lit(" Work"))).alias("title"),
        F.coalesce(F.array_join("accomplishments", "; "), none).alias("description"), F.array(theme).alias("themes"), F.lit(0.4).alias("confidence_score"),
        F.floor((F.unix_micros("end_time") - F.unix_micros("start_time")) / 60e6).cast("double").alias("duration_minutes"),
    )


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where null keys are equal."""
    r = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    cond = F.lit(True)
    for k in keys:
        cond &= a[k].eqNullSafe(r[f"_{k}"])
    return a.join(r, cond, "left").drop(*(f"_{k}" for k in keys))


def build_tasks(events: DataFrame, keys: list[str], now: Column, least_confidence: float = 0.3) -> DataFrame:
    """A task for each group: its fallback analysis, commonest project, mean vector, members' ids, and status completed if it
    ended more than an hour before ``now``. Analyses below ``least_confidence`` are left out."""
    a = fallback_analysis(events, keys).filter(F.col("confidence_score") >= least_confidence)
    tag = [k for k in keys if k == "project"]
    p = modes(events.withColumn("_p", F.col("project")), keys, "_p").withColumnRenamed("mode", "mode_project")
    members = events.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("activity_ids"))
    v = mean_vector(events, keys).drop("n")
    out = _on(_on(_on(a, p, keys), members, keys), v, keys)
    out = out.withColumn("id", stable_id(*keys, "start_time", F.array_join("activity_ids", ",")))
    out = out.withColumn("status", F.when(F.col("end_time") < now - F.make_interval(hours=F.lit(1)), "completed").otherwise("active"))
    out = out.withColumn("priority", F.lit("medium")).withColumn("tags", F.col("themes")).withColumn("main_themes", F.col("themes")).drop("themes", *tag)
    return out.withColumnRenamed("mode_project", "project")


def completed(tasks: DataFrame, task_id: str, now: Column) -> DataFrame:
    """Tasks with one of them completed at ``now``."""
    hit = F.col("id") == task_id
    return tasks.withColumn("status", F.when(hit, "completed").otherwise(F.col("status"))).withColumn("end_time", F.when(hit, now).otherwise(F.col("end_time")))


def pending_hours(events: DataFrame, summarized: DataFrame, now: Column, most: int = 4) -> DataFrame:
    """The first ``most`` hours (date, hour) with events but no summary: all of yesterday's, then today's before this hour."""
    return unsummed_hours(events.select(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")), summarized, now, most)


def unsummed_hours(seen: DataFrame, summarized: DataFrame, now: Column, most: int = 4) -> DataFrame:
    """``pending_hours`` from the hours (date, hour) that have events."""
    today = F.to_date(now)
    e = seen.select("date", "hour")
    e = e.filter((F.col("date") == F.date_sub(today, 1)) | ((F.col("date") == today) & (F.col("hour") < F.hour(now)))).distinct()
    return e.join(summarized.select("date", "hour"), ["date", "hour"], "left_anti").orderBy("date", "hour").limit(most)


def chunk_prompt(events: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, prompt): the texts of each group's events, numbered in order of time, one a line."""
    w = Window.partitionBy(*keys).orderBy("timestamp", "id")
    t = events.withColumn("_n", F.row_number().over(w)).withColumn("_t", text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: F.concat(x["_n"].cast("string"), F.lit(". "), x["_t"]))
    return t.groupBy(*keys).agg(F.array_join(lines, "\n").alias("prompt"))


def parsed_analysis(reply: Column) -> Column:
    """Title, description, accomplishments and themes from a model's labelled reply; confidence 0.8. Labels stand at a
    line's beginning (TASK_TITLE or TITLE and so on); accomplishments are the dashed lines under theirs, or one line
    parted by ; or ,"""
    field = lambda name: F.nullif(F.trim(F.regexp_extract(reply, rf"(?im)^[\s*]*(?:TASK_|MAIN_)?{name}\**:[ \t*]*(.+)$", 1)), F.lit(""))
    parts = lambda c: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[|\]$", ""), r"\s*[;,]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    block = F.regexp_extract(reply, r"(?is)ACCOMPLISHMENTS\**:(.*?)(?:\n[\s*]*[A-Z_]+\**:|$)", 1)
    dashed = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*[-•]\s*(.+)$"), F.lit(1)), lambda x: F.trim(x))
    done = F.when(F.size(dashed) > 0, dashed).otherwise(parts(F.trim(block)))
    return F.struct(field("title").alias("title"), field("description").alias("description"), done.alias("accomplishments"), parts(field("themes")).alias("themes"), F.lit(0.8).alias("confidence_score"))


def day_overview() -> Column:
    """A day's narrative without a model, from its summary columns (date, total, top_categories, top_projects)."""
    return F.concat(
        F.lit("On "), F.date_format("date", "MMMM dd, yyyy"), F.lit(" there were "), F.col("total").cast("string"), F.lit(" events"),
        F.when(F.col("top_categories") != "", F.concat(F.lit(", mostly "), F.replace("top_categories", F.lit(","), F.lit(", ")))).otherwise(""),
        F.when(F.col("top_projects") != "", F.concat(F.lit("; projects: "), F.replace("top_projects", F.lit(","), F.lit(", ")))).otherwise(""), F.lit("."),
    )


def hide_members(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events that belong to none of the tasks."""
    ids = tasks.select(F.explode("activity_ids").alias("_m")).distinct()
    return events.join(ids, F.col("id") == F.col("_m"), "left_anti")
