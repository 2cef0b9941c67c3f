"""Neighbours in time for keys of any size: time blocks are scanned apart, and what crosses them is carried by a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a block of time.
WIDTH = 86_400


def _same(a: str, b: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _carried(rows: DataFrame, blocks: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their block."""
    got = rows.alias("r").join(blocks.alias("b"), _same("r", "b", [*keys, "_block"]), "left")
    return got.select("r.*", *(F.col(f"b.{n}").alias(n) for n in names))


def in_blocks(events: DataFrame, width: int = WIDTH) -> DataFrame:
    return events.withColumn("_block", F.floor(F.unix_micros("timestamp") / (width * 1_000_000)))


def neighbours(events: DataFrame, keys: list[str], columns: list[str], width: int = WIDTH) -> DataFrame:
    """``events`` with ``_block``, ``_prev`` and ``_next``: the ``columns`` of the rows before and after each, in order of timestamp
    and id within ``keys``.

    Rows of a key and ``width`` seconds are in order in a task of their own; the row before a block's first one is the last of
    the key's block before it. That comes from a table of one row for each key and block with rows in it."""
    e = in_blocks(events, width)
    value, order = F.struct(*columns), F.struct("timestamp", "id")
    w = Window.partitionBy(*keys, "_block").orderBy("timestamp", "id")
    e = e.withColumn("_prev", F.lag(value).over(w)).withColumn("_next", F.lead(value).over(w))
    b = e.groupBy(*keys, "_block").agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    o = Window.partitionBy(*keys).orderBy("_block")
    b = b.select(*keys, "_block", F.lag("_last").over(o).alias("_came"), F.lead("_first").over(o).alias("_comes"))
    e = _carried(e, b, keys, ["_came", "_comes"])
    return e.withColumn("_prev", F.coalesce("_prev", "_came")).withColumn("_next", F.coalesce("_next", "_comes")).drop("_came", "_comes")


def running_count(rows: DataFrame, keys: list[str], flag: str, name: str) -> DataFrame:
    """``rows`` with ``_block``, and as ``name`` how often ``flag`` held up to each row of its key: counts of blocks before, and
    a running count within the block."""
    w = Window.partitionBy(*keys, "_block").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_n", F.sum(F.col(flag).cast("long")).over(w))
    b = rows.groupBy(*keys, "_block").agg(F.sum(F.col(flag).cast("long")).alias("_m"))
    o = Window.partitionBy(*keys).orderBy("_block")
    b = b.select(*keys, "_block", (F.sum("_m").over(o) - F.col("_m")).alias("_before"))
    return _carried(r, b, keys, ["_before"]).withColumn(name, F.col("_before") + F.col("_n")).drop("_n", "_before")


def long_sessions(events: DataFrame, keys: list[str], gap: float = 600, whole_seconds: bool = False, width: int = WIDTH) -> DataFrame:
    """``gap_sessions`` for keys of any size: the same rows, a key's time blocks side by side."""
    e = neighbours(events, keys, ["timestamp"], width)
    t = lambda c: F.unix_timestamp(c).cast("double") if whole_seconds else F.unix_micros(c) / 1e6
    e = e.withColumn("_new", F.coalesce(t("timestamp") - t("_prev.timestamp") > gap, F.lit(True)))
    return running_count(e, keys, "_new", "session").select(*events.columns, "session")


def long_focus_runs(events: DataFrame, keys: list[str], same: list[str], least: float = 30, width: int = WIDTH) -> DataFrame:
    """``focus_runs`` for keys of any size."""
    e = neighbours(events, keys, same, width)
    starts = e.filter(~F.coalesce(F.col("_prev") == F.struct(*same), F.lit(False))).select(*events.columns)
    s = neighbours(starts, keys, ["timestamp"], width)
    out = s.select(*keys, *same, F.col("timestamp").alias("start"), (F.unix_timestamp("_next.timestamp") - F.unix_timestamp("timestamp")).alias("duration_seconds"))
    return out.filter(F.col("duration_seconds") >= least)


def long_row_durations(events: DataFrame, keys: list[str], now: Column, least: int = 4, width: int = WIDTH) -> DataFrame:
    """``row_durations`` for keys of any size."""
    e = neighbours(events, keys, ["timestamp"], width)
    d = F.unix_timestamp(F.coalesce("_next.timestamp", now)) - F.unix_timestamp("timestamp")
    return e.select(*events.columns, d.alias("duration_seconds")).filter(F.col("duration_seconds") >= least)


def nearest_in_time(anchors: DataFrame, events: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """For each of ``anchors`` (keys, id, timestamp) the event (keys, id, timestamp) of its keys that is nearest in whole seconds,
    ties to the earlier one and then the smaller id: (keys, id, timestamp, nearest_id, nearest_time, seconds); nulls if there is
    none. Null keys are equal.

    Of events of one second the first stands for all. Anchors and events lie in one order by time; each anchor takes the last
    event before it and the first after it in its block, or what is carried from the blocks around it."""
    second = F.unix_seconds("timestamp")
    first = F.min(F.struct("timestamp", "id")).alias("_e")
    e = events.select(*keys, second.alias("_s"), "timestamp", "id").groupBy(*keys, "_s").agg(first)
    e = e.select(*keys, "_s", F.lit(0).alias("_kind"), F.struct(F.col("_s").alias("s"), F.col("_e.timestamp").alias("t"), F.col("_e.id").alias("i")).alias("_event"), F.lit(None).cast(events.schema["id"].dataType).alias("id"), F.lit(None).cast("timestamp").alias("timestamp"))
    a = anchors.select(*keys, second.alias("_s"), F.lit(1).alias("_kind"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), "id", "timestamp")
    both = e.unionByName(a).withColumn("_block", F.floor(F.col("_s") / width))
    w = Window.partitionBy(*keys, "_block").orderBy("_s", "_kind")
    both = both.withColumn("_before", F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # looking back in the order turned round: a frame up to the end would be gone through anew for each row
    back = Window.partitionBy(*keys, "_block").orderBy(F.desc("_s"), F.desc("_kind"))
    both = both.withColumn("_after", F.last("_event", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    b = both.groupBy(*keys, "_block").agg(F.min("_event").alias("_first"), F.max("_event").alias("_last"))
    o, later = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    b = b.select(*keys, "_block", F.last("_last", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_came"), F.last("_first", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_comes"))
    r = _carried(both.filter("_kind = 1"), b, keys, ["_came", "_comes"])
    before, after = F.coalesce("_before", "_came"), F.coalesce("_after", "_comes")
    away = lambda c: F.abs(c["s"] - F.col("_s"))
    best = F.when(after.isNull() | (away(before) <= away(after)), before).otherwise(after)
    r = r.withColumn("_best", best)
    return r.select(*keys, "id", "timestamp", F.col("_best.i").alias("nearest_id"), F.col("_best.t").alias("nearest_time"), F.abs(F.col("_best.s") - F.col("_s")).alias("seconds"))
