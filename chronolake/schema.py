"""The event model: canonical schemas, value sets, and rows that replace each other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_TYPES = ("git_commit", "git_stash", "git_staged", "browser", "terminal", "window", "screen", "note")
CATEGORIES = ("Coding", "Debugging", "Research", "Learning", "Writing", "Communication", "Other")
STATUSES = ("active", "completed", "paused", "abandoned")
PRIORITIES = ("low", "medium", "high", "urgent")


_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "boolean": T.BooleanType(), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from 'name type, ...'; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


EVENT = _struct(
    "id string, timestamp timestamp, date date, event_type string, source string, source_doc_id string, raw_content string, "
    "summary string, category string, project string, task_id string, metadata map<string,string>, files_changed array<string>, "
    "compacted boolean, chunk_index int, total_chunks int, embedding array<float>"
)
TASK = _struct(
    "id string, title string, description string, status string, priority string, category string, project string, "
    "start_time timestamp, end_time timestamp, duration_minutes double, activity_count int, confidence_score double, "
    "tags array<string>, accomplishments array<string>, main_themes array<string>, activity_ids array<string>, "
    "subtask_ids array<string>, parent_task_id string, embedding array<float>, created_at timestamp, updated_at timestamp"
)
NODE = _struct("id string, label string, props map<string,string>, ts timestamp")
EDGE = _struct("src_id string, dst_id string, type string")
ENTITY = _struct("id string, name string, type string, aliases array<string>, confidence double, first_seen timestamp, last_seen timestamp, mention_count bigint, metadata map<string,string>")
RELATIONSHIP = _struct("id string, source_entity_id string, target_entity_id string, type string, confidence double, first_seen timestamp, last_seen timestamp, strength double, supporting array<string>")
HOUR = _struct("date date, hour int, title string, summary string, tree string, apps array<string>, categories array<string>, event_count bigint, generated_at timestamp")

#: Of each source the session that is open: its number and id, when its last event was (whole seconds), and that event.
TAIL = _struct("key string, session bigint, session_id string, last_second bigint, last_id string")
#: Hours that have events.
SEEN = _struct("date date, hour int")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast, and null where it has none."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def event_type(c: Column) -> Column:
    """An event type as stored; an unknown one reads as window."""
    return F.when(F.lower(c).isin(*EVENT_TYPES), F.lower(c)).otherwise("window")


def category(c: Column) -> Column:
    """A category in any case; an unknown one is Other, null stays null."""
    known = F.initcap(F.lower(c))
    return F.when(c.isNull(), None).when(known.isin(*CATEGORIES), known).otherwise("Other")


def latest(df: DataFrame, keys: Iterable[str], *order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key: what an upsert leaves. Partial aggregation, so a hot key does no harm."""
    rest = [c for c in df.columns if c not in set(keys)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def stable_id(*parts: Column | str) -> Column:
    """An id that the same parts always give; nulls count."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x1e")) for p in parts)), 256)
