"""What a language model is asked, as column expressions, and the texts that stand in when it gives none."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM = "You describe what a person did at a computer from logs. Name files, commands, pages and people that the logs name. Say nothing that the logs don't show."

#: For each purpose the request; words in braces are columns.
REQUESTS = {
    "task_analysis": "These {activity_count} activities took {duration_minutes} minutes, from {start_time} to {end_time}, mostly {category} on {project}:\n{activities}\nReply with lines TITLE:, DESCRIPTION:, ACCOMPLISHMENTS: (dashed lines) and THEMES:.",
    "task_enhance": "Give a short title and a description of this {category} work on {project} ({duration_minutes} minutes, {activity_count} activities):\n{activities}",
    "category_summary": "In one or two sentences, what were these {event_count} {category} activities about?\n{summaries}\nand {extra_count} more",
    "overall_summary": "In two sentences, describe {date}: {total_events} activities, mostly {top_categories}, on {projects}.",
    "hourly_summary": "What happened at {hour_label}? {event_count} activities in {apps}:\n{summaries}\nReply with lines TITLE: and SUMMARY:.",
    "task_category_summary": "Sum up {task_count} {category} tasks (themes: {themes}):\n{tasks}",
    "task_rich_overview": "Describe {date}: {completed_tasks} of {total_tasks} tasks done ({completion_rate}%), {hours} hours, mostly {top_categories}, on {projects}.",
    "task_based_overview": "Describe the work of {date} in two or three sentences: {total_tasks} tasks, {completed_tasks} done, {hours} hours. Foremost: {titles}. Projects: {projects}.",
    "task_summary": "In one sentence, sum up the task {title} ({status}, {category}, {duration_minutes} minutes, {activity_count} activities): {description}",
    "task_daily_overall": "What did {date} come to? {total_tasks} tasks, {completion_rate}% done, {hours} hours, mostly {top_categories}:\n{tasks}",
    "task_weekly_insights": "What stands out from {start_date} to {end_date}? {total_tasks} tasks, {completed_tasks} done, {daily_tasks} a day; busiest {busiest_day} ({busiest_count}), best {best_day} ({best_rate}%); mostly {top_categories}.",
}

# Texts in place of a model's, by purpose; words in braces are columns.
FALLBACKS = {
    "category_summary": "Completed {event_count} {category} activities.",
    "overall_summary": "Tracked {total_events} activities. Top categories: {top_categories}.",
    "task_summary": "{title} — {description}",
    "task_based_overview": "{date} — {total_tasks} tasks, {completed_tasks}/{total_tasks} completed, {hours}h total.",
}


def filled(template: str) -> Column:
    """A template with the columns that it names as strings, nulls as nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cells)


def request(purpose: str) -> Column:
    return filled(REQUESTS[purpose])


def fallback(purpose: str) -> Column:
    return filled(FALLBACKS[purpose])


def narrated(rows: DataFrame, purpose: str, ask: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """``rows`` with ``narrative``: what the model says to the request of this purpose, on Arrow batches, or the text in its
    place where there is no model, it fails or says nothing."""
    if ask is None:
        return rows.withColumn("narrative", fallback(purpose))

    def run(s: pd.Series) -> pd.Series:
        try:
            said = list(ask(s.tolist()))
        except Exception:  # a model out of reach
            said = []
        return pd.Series(said if len(said) == len(s) else [None] * len(s), dtype=object)

    said = F.trim(F.pandas_udf(run, T.StringType())(request(purpose)))
    return rows.withColumn("narrative", F.coalesce(F.nullif(said, F.lit("")), fallback(purpose)))


def category_texts(events: DataFrame, ask: Callable | None = None, most: int = 15, width: int = 100) -> DataFrame:
    """(date, category, event_count, narrative): each day's categories (none: Other), from the first ``most`` summaries, or
    contents cut at ``width``, that a model sees."""
    from pyspark.sql import Window

    e = events.withColumn("date", F.to_date("timestamp")).withColumn("category", F.coalesce("category", F.lit("Other")))
    counts = e.groupBy("date", "category").agg(F.count("*").alias("event_count"))
    if ask is None:
        return narrated(counts, "category_summary")
    w = Window.partitionBy("date", "category").orderBy("timestamp", "id")
    first = e.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("summary", F.left("raw_content", F.lit(width))).alias("t")))), lambda x: x["t"])
    first = first.groupBy("date", "category").agg(F.array_join(lines, "\n").alias("summaries"))
    t = counts.join(first, ["date", "category"]).withColumn("extra_count", F.greatest(F.lit(0), F.col("event_count") - most))
    return narrated(t, "category_summary", ask).drop("summaries", "extra_count")


def day_texts(tasks: DataFrame, ask: Callable | None = None) -> DataFrame:
    """(date, total_tasks, completed_tasks, hours, narrative): each day's work as its tasks tell it."""
    t = tasks.withColumn("day", F.to_date("start_time"))
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("duration_minutes", F.lit(0.0))).alias("m"), "id", "title"))), 1, 5), lambda x: x["title"])
    hours = F.coalesce(F.sum("duration_minutes"), F.lit(0.0)) / 60
    t = t.groupBy("day").agg(F.count("*").alias("total_tasks"), F.count_if(F.col("status") == "completed").alias("completed_tasks"), F.regexp_replace(F.format_number(hours, 1), ",", "").alias("hours"), F.array_join(best, ", ").alias("titles"), F.array_join(F.array_sort(F.collect_set("project")), ", ").alias("projects"))
    return narrated(t.withColumn("date", F.date_format("day", "MMMM dd, yyyy")), "task_based_overview", ask).drop("date", "titles", "projects").withColumnRenamed("day", "date")
