"""The driver's tables seen as events, tasks and texts. The expressions are written so that Spark and other SQL engines
read them alike; ``EV`` and ``TASKS`` give the same rows as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT, TASK, conform

NOW = "2024-01-31 00:00:00"

_CATEGORY = "case label % 7 when 0 then 'Coding' when 1 then 'Debugging' when 2 then 'Research' when 3 then 'Learning' when 4 then 'Writing' when 5 then 'Communication' when 6 then 'Other' end"
_RAW = """case event_type
 when 'click' then '{"title":"Page ' || k || '","domain":"d' || (k % 13) || '.example.org","url":"https://d' || (k % 13) || '.example.org/p/' || k || '"}'
 when 'error' then '{"command":"' || (case k % 4 when 0 then 'cargo test' when 1 then 'ls -l' when 2 then 'python debug.py' else 'make all' end) || ' ' || k || '"}'
 when 'purchase' then '{"hash":"h' || event_id || '","message":"fix ' || k || '","files_changed":["src/f' || (k % 19) || '.py","docs/g' || (k % 23) || '.md"],"diff":""}'
 else 'text: number ' || k end"""
COLUMNS = {
    "id": "'' || event_id",
    "timestamp": "ts",
    "event_type": "case event_type when 'click' then 'browser' when 'view' then 'window' when 'error' then 'terminal' when 'purchase' then 'git_commit' else 'note' end",
    "source": "'u' || user_id",
    "raw_content": _RAW,
    "summary": "case when event_id % 3 = 0 then 'summary of ' || event_id end",
    "category": _CATEGORY,
    "project": "case when user_id % 11 = 0 then null else 'p' || (user_id % 7) end",
    "app": "'app' || (k % 5)",
    "title": "'Doc ' || (k % 17)",
    "gist": "case when k % 10 = 0 then 'gist ' || k end",
    "k": "k",
    "embedding": "embedding",
}
_ORDER = {
    "id": "'' || o_orderkey",
    "title": "'Order ' || o_orderkey",
    "description": "o_orderpriority",
    "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'active' else 'paused' end",
    "priority": "'medium'",
    "category": "case o_custkey % 8 when 0 then 'Coding' when 1 then 'Debugging' when 2 then 'Research' when 3 then 'Learning' when 4 then 'Writing' when 5 then 'Communication' when 6 then 'Other' end",
    "project": "case when o_custkey % 11 = 0 then null else 'p' || (o_custkey % 7) end",
    "start_time": "o_orderdate",
    "duration_minutes": "floor(o_totalprice / 1000)",
}
EV = "ev as (select " + ", ".join(f"{v} as {k}" for k, v in COLUMNS.items()) + ", cast(ts as date) as date from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) e left join embeddings v on v.vec_id = e.event_id)"
TASKS = "tasks as (select " + ", ".join(f"{v} as {k}" for k, v in _ORDER.items()) + " from orders)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Events in the canonical schema, with their user's number as ``user_id``; vectors and categories by a left join."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))
    v = read(spark, sf_dir, "embeddings")
    e = e.join(v if vectors else v.select("vec_id", "label"), F.col("vec_id") == F.col("event_id"), "left")
    e = e if vectors else e.withColumn("embedding", F.lit(None).cast("array<float>"))
    e = e.select("user_id", *(F.expr(x).alias(c) for c, x in COLUMNS.items()))
    m = F.create_map(F.lit("app_name"), F.col("app"), F.lit("window_title"), F.col("title"), F.lit("gist"), F.col("gist"))
    e = e.withColumn("metadata", F.map_filter(m, lambda k, v: v.isNotNull())).withColumn("date", F.to_date("timestamp")).withColumn("compacted", F.lit(False))
    cast = lambda f: (F.col(f.name) if f.name in e.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return e.select("user_id", "app", "title", *(cast(f) for f in EVENT.fields if f.name not in ("chunk_index", "total_chunks")))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return conform(t.select(*(F.expr(x).alias(c) for c, x in _ORDER.items())), TASK)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source")
