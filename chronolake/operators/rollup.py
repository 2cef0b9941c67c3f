"""Counts and summaries by type, project, hour, day and week. Every grouping combines on the map side; what is sorted or
windowed afterwards is the small result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def everything():
    """All rows of a small table of groups."""
    return Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def type_breakdown(events: DataFrame) -> DataFrame:
    """Events of each type and their share in percent, rounded down."""
    t = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return t.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(everything())).cast("long"))


def top(events: DataFrame, by: Column, name: str, most: int) -> DataFrame:
    """The values of ``by`` (nulls left out) that occur most, ties to the smaller value, with their rank."""
    t = events.select(by.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    t = t.orderBy(F.desc("n"), name).limit(most)
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), name)))


def active_days(events: DataFrame) -> DataFrame:
    """Days with events, and events for each of them."""
    t = events.groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"))
    return t.agg(F.count("*").alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")).withColumn("per_day", F.when(F.col("days") > 0, F.col("events") / F.col("days")).otherwise(0.0))


def project_types(events: DataFrame) -> DataFrame:
    """For each project (none: unassigned) its events and those of each type, commonest first."""
    t = events.groupBy(F.coalesce("project", F.lit("unassigned")).alias("project"), "event_type").agg(F.count("*").alias("n"))
    types = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type")))
    return t.groupBy("project").agg(F.sum("n").alias("n"), types.alias("_t")).withColumn("types", F.array_join(F.transform("_t", lambda x: F.concat(x["event_type"], F.lit(":"), (-x["m"]).cast("string"))), ",")).drop("_t")


def category_shares(events: DataFrame) -> DataFrame:
    """Events of each category, null included, with whole percents of all."""
    t = events.groupBy("category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(everything())
    sorted_ = F.sum(F.when(F.col("category").isNotNull(), F.col("n")).otherwise(0)).over(everything())
    return t.select("category", "n", F.floor(100 * F.col("n") / total).cast("long").alias("percent"), F.floor(100 * sorted_ / total).cast("long").alias("categorized_percent"))


def task_statistics(tasks: DataFrame, start: Column) -> DataFrame:
    """From ``start`` on: tasks, completed ones and hours in all, and by category (none: empty)."""
    t = tasks.filter(F.col("start_time") >= start)
    t = t.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("completed"), (F.sum(F.coalesce("duration_minutes", F.lit(0.0))) / 60).alias("hours"))
    return t.select("*", F.sum("n").over(everything()).alias("all_n"), F.sum("completed").over(everything()).alias("all_completed"), F.sum("hours").over(everything()).alias("all_hours"))


def by_frequency(t: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """(keys, values): each key's values, commonest first, ties by value, nulls and blanks left out."""
    c = t.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    out = F.transform(pairs, lambda x: x["v"])
    return c.groupBy(*keys).agg((out if most is None else F.slice(out, 1, most)).alias("values"))


def in_order(t: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): each key's distinct values as they were first seen, nulls and blanks left out."""
    c = t.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.min(F.struct("timestamp", "id")).alias("s"))
    return c.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def hours(events: DataFrame) -> DataFrame:
    """``events`` with date and hour (UTC)."""
    return events.withColumn("date", F.to_date("timestamp")).withColumn("hour", F.hour("timestamp"))


def hour_aggregate(events: DataFrame, lines: int = 24, width: int = 120) -> DataFrame:
    """For each date and hour: events, apps by frequency, categories as first seen, and the first non-blank lines in order
    of time (an event's summary, else the beginning of its text).

    The lines are the only list of events: of each hour at most ``lines`` are kept while grouping, by a rank within it."""
    e = hours(events).withColumn("app", F.col("metadata")["app_name"])
    k = ["date", "hour"]
    out = e.groupBy(*k).agg(F.count("*").alias("event_count"))
    text = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.left(F.trim("raw_content"), F.lit(width)))
    first = e.withColumn("_t", text).filter(F.col("_t") != "").withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy("timestamp", "id"))).filter(F.col("_r") <= lines)
    first = first.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("lines"))
    for name, t in (("apps", by_frequency(e, k, "app")), ("categories", in_order(e, k, "category"))):
        out = out.join(t.withColumnRenamed("values", name), k, "left")
    empty = F.array().cast("array<string>")
    return out.join(first, k, "left").select(*k, "event_count", *(F.coalesce(c, empty).alias(c) for c in ("apps", "categories", "lines")))


def timeline(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Hours with events or a stored summary (date, hour, title, summary, apps, categories, event_count): a stored row wins;
    else the hour's apps by frequency, and summaries and categories as first seen."""
    e = hours(events).withColumn("app", F.col("metadata")["app_name"])
    k = ["date", "hour"]
    live = e.groupBy(*k).agg(F.count("*").alias("n"))
    for name, t in (("a", by_frequency(e, k, "app")), ("s", in_order(e, k, "summary")), ("c", in_order(e, k, "category"))):
        live = live.join(t.withColumnRenamed("values", name), k, "left")
    empty = F.array().cast("array<string>")
    s = stored.select(*k, "title", "summary", "apps", "categories", "event_count", F.lit(True).alias("_stored"))
    pick = lambda a, b: F.when(F.col("_stored"), F.col(a)).otherwise(b)
    return live.join(s, k, "full").select(
        *k, "title",
        pick("summary", F.array_join(F.coalesce("s", empty), "; ")).alias("summary"),
        pick("apps", F.coalesce("a", empty)).alias("apps"),
        pick("categories", F.coalesce("c", empty)).alias("categories"),
        pick("event_count", F.col("n")).alias("event_count"),
    )


def daily_summary(events: DataFrame) -> DataFrame:
    """For each date: events, the categories (none: Other) with counts and projects, the three commonest categories and
    the five commonest projects."""
    e = events.withColumn("date", F.to_date("timestamp")).withColumn("cat", F.coalesce("category", F.lit("Other")))
    c = e.groupBy("date", "cat").agg(F.count("*").alias("n"), F.collect_set("project").alias("p"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cat", F.size("p").alias("k"))))
    out = c.groupBy("date").agg(F.sum("n").alias("total"), pairs.alias("_c"))
    out = out.withColumn("categories", F.array_join(F.transform("_c", lambda x: F.concat(x["cat"], F.lit(":"), (-x["m"]).cast("string"), F.lit("/"), x["k"].cast("string"))), ","))
    out = out.withColumn("top_categories", F.array_join(F.transform(F.slice("_c", 1, 3), lambda x: x["cat"]), ",")).drop("_c")
    p = by_frequency(e, ["date"], "project", 5).withColumn("top_projects", F.array_join("values", ",")).drop("values")
    return out.join(p, "date", "left").withColumn("top_projects", F.coalesce("top_projects", F.lit("")))


def daily_tasks(tasks: DataFrame) -> DataFrame:
    """For each date: tasks, completed ones, minutes, and the five commonest projects."""
    t = tasks.withColumn("date", F.to_date("start_time"))
    out = t.groupBy("date").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum(F.coalesce("duration_minutes", F.lit(0.0))).alias("minutes"))
    p = by_frequency(t, ["date"], "project", 5).withColumn("top_projects", F.array_join("values", ",")).drop("values")
    return out.join(p, "date", "left").withColumn("top_projects", F.coalesce("top_projects", F.lit("")))


def rich_daily(tasks: DataFrame) -> DataFrame:
    """Tasks with their place in the day by minutes, and the day's totals and number of projects."""
    t = tasks.withColumn("date", F.to_date("start_time"))
    d = t.groupBy("date").agg(F.count("*").alias("day_tasks"), F.sum(F.coalesce("duration_minutes", F.lit(0.0))).alias("day_minutes"), F.count_distinct("project").alias("day_projects"))
    w = Window.partitionBy("date").orderBy(F.desc(F.coalesce("duration_minutes", F.lit(0.0))), "id")
    return t.withColumn("place", F.row_number().over(w)).join(d, "date")


def weekly(tasks: DataFrame, first: str, days: int = 7) -> DataFrame:
    """Totals of ``days`` days from ``first``: tasks, completion rate (0 without tasks), hours, counts by category and project."""
    day = F.to_date("start_time")
    t = tasks.filter((day >= F.to_date(F.lit(first))) & (day < F.date_add(F.to_date(F.lit(first)), days)))
    out = t.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), (F.coalesce(F.sum("duration_minutes"), F.lit(0.0)) / 60).alias("hours"))
    out = out.withColumn("completion_rate", F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0))
    for name in ("category", "project"):
        c = t.groupBy(F.coalesce(name, F.lit("none")).alias("v")).agg(F.count("*").alias("n"))
        c = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))), lambda x: F.concat(x["v"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias(f"by_{name}"))
        out = out.join(F.broadcast(c))  # one row and one row
    return out


def mean_vector(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, embedding, n): mean of the members' vectors by position, as double; nulls left out."""
    n = members.filter("embedding is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    x = members.select(*keys, F.posexplode("embedding").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    x = x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("embedding"))
    return x.join(n, keys)


def modes(t: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode): the commonest non-null value, ties to the smaller."""
    c = t.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(*keys, F.col("x.v").alias("mode"))


def review(spark_days: DataFrame, first: str, last: str) -> DataFrame:
    """Each day from ``first`` to ``last`` with its stored ``total``; null without a summary. ``spark_days``: (date, total)."""
    days = spark_days.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    return days.join(spark_days.select("date", "total"), "date", "left")


def project_analysis(events: DataFrame, tasks: DataFrame, project: str) -> DataFrame:
    """Events of a project by type, with its tasks and the titles of the ten latest."""
    t = tasks.filter(F.col("project") == project)
    titles = t.orderBy(F.desc("start_time"), "id").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros("start_time")).alias("m"), "id", "title"))), lambda x: x["title"]), ";").alias("titles"))
    n = t.agg(F.count("*").alias("tasks"))
    e = events.filter(F.col("project") == project).groupBy("event_type").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n)).join(F.broadcast(titles))  # one row each
