"""Ingestion: collect, embed, store, in micro-batches; what can't be embedded waits in a queue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import chunks, embedding_text
from ..schema import EVENT, conform
from ..sources.sinks import Store


def chunked(events: DataFrame, most: int = 409, overlap: int = 100) -> DataFrame:
    """A row for each chunk of an event's text (chunk_index, total_chunks, chunk), source_doc_id being the event's id and
    chunk; a short text is one chunk."""
    w = F.filter(F.split(F.trim(embedding_text()), r"\s+"), lambda x: x != "")
    parts = F.when(F.size(w) > 0, chunks(w, most, overlap)).otherwise(F.array(F.array().cast("array<string>")))
    e = events.select(*(c for c in events.columns if c not in ("chunk_index", "total_chunks", "source_doc_id")), F.size(parts).alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "_w"))
    one = F.col("total_chunks") == 1
    e = e.withColumn("chunk", F.when(one, embedding_text()).otherwise(F.array_join("_w", " "))).drop("_w")
    return e.withColumn("source_doc_id", F.when(one, F.col("id")).otherwise(F.concat("id", F.lit("_chunk_"), F.col("chunk_index").cast("string"))))


def embedded(chunks_: DataFrame, embed: Callable[[list[str]], list[list[float] | None]]) -> DataFrame:
    """``chunks_`` with ``embedding`` by a model on Arrow batches; null where the model gives none or fails."""

    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(embed(texts.fillna("").tolist())), dtype=object)
        except Exception:  # a model out of reach: the rows wait in the queue
            return pd.Series([None] * len(texts), dtype=object)

    return chunks_.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()))("chunk"))


def hashed_vectors(width: int = 64) -> Callable[[list[str]], list[list[float] | None]]:
    """A model for tests: words hashed to places, at length 1; an empty text has no vector."""
    import zlib

    import numpy as np

    def embed(texts):
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 1 << 20 else -1
            if t.split() and not v.any():
                v[0] = 1.0  # all words cancelled out
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


#: After so many batches the small tables of the cycle are folded.
FOLD = 32


def ingest_batch(store: Store, embed: Callable, retry: int = 500, writer: str = "ingest") -> Callable[[DataFrame, int], DataFrame]:
    """A foreachBatch function: new events and up to ``retry`` waiting ones are chunked, embedded and appended; those without
    a vector wait. It returns the chunks that were stored.

    A batch's rows are written once, with their vectors, and events and queue are filled from there: a task that is lost
    afterwards asks no model again. Rows carry the batch's version, so that a batch that runs twice leaves what one run leaves."""

    def run(events: DataFrame, number: int) -> DataFrame:
        version = store.version(writer, number)
        waiting = store.read("pending", before=version).filter("compacted is null or not compacted")
        again = waiting.orderBy("timestamp", "id").limit(retry).drop("chunk_index", "total_chunks", "source_doc_id", "embedding")
        both = events.unionByName(again.select(*(c for c in again.columns if c in events.columns)), allowMissingColumns=True) if events.columns else again
        path = f"{store.path}/_batches/{writer}-{version % 2}"  # a batch reads none but its own: two places take turns
        embedded(chunked(both), embed).write.mode("overwrite").parquet(path)
        done = store.spark.read.parquet(path)
        store.append("events", done.filter("embedding is not null"), version)
        late = done.filter("embedding is null and trim(chunk) <> ''").withColumn("compacted", F.lit(False))
        left = waiting.join(done.filter("embedding is not null").select("id").distinct(), "id", "left_semi").withColumn("compacted", F.lit(True))
        store.append("pending", late.unionByName(left, allowMissingColumns=True), version)
        if number % FOLD == FOLD - 1:
            store.fold("pending", keep=~F.coalesce("compacted", F.lit(False)))
        return done.filter("embedding is not null")

    return run


class Breaker:
    """Gives a source up after ``most`` failures in a row; a success starts the count anew."""

    def __init__(self, most: int = 3):
        self.most, self.failures = most, {}

    def run(self, name: str, collect: Callable[[], DataFrame]) -> DataFrame | None:
        if self.open(name):
            return None
        try:
            out = collect()
        except Exception:  # any failure of a source counts, and must not stop the others
            self.failed(name)
            return None
        self.went_well(name)
        return out

    def failed(self, name: str) -> None:
        self.failures[name] = self.failures.get(name, 0) + 1

    def went_well(self, name: str) -> None:
        self.failures[name] = 0

    def open(self, name: str) -> bool:
        return self.failures.get(name, 0) >= self.most


def due(last: str | None, now: str, every: str = "day") -> bool:
    """Whether a job that ran last at one ISO time is due at another: once each day or hour."""
    n = 10 if every == "day" else 13
    return last is None or last[:n] < now[:n]


def poll(source: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "60 seconds"):
    """Start the cycle: each ``every``, what a streaming source has gathered since the last time goes through ``batch``. The
    checkpoint stands for the time of the last cycle; a cycle that is missed is made up for by the next. Without ``every``
    what is there goes through, and the query ends."""
    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def cycle(store: Store, embed: Callable, now: Callable[[], str], key: str = "source", retry: int = 500, threshold: float = 0.7, writer: str = "cycle") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a whole cycle: events and waiting ones are embedded and stored; their nodes and edges are
    added to the activity graph; finished days are compacted once a day; and the hours that have no summary yet get one by
    rules. ``now`` gives an ISO time. A step that fails is reported and doesn't stop the others; a batch without events ends
    before them, as nothing has changed.

    A batch reads what it brings, one row for each of its sources (``tails``) and the hours seen lately, whatever lies in the
    store. Events are read again only once for each finished hour (its day), and once a day by compaction (its seven days)."""
    import logging
    from datetime import date, timedelta

    from ..operators import rollup, tasks, temporal_graph
    from ..plans import compaction

    ingest = ingest_batch(store, embed, retry, writer)
    last: dict[str, str] = {}

    def days(most: int) -> list[str]:
        today = date.fromisoformat(now()[:10])
        return [str(today - timedelta(days=n)) for n in range(most + 1)]

    def graph(done: DataFrame, version: int, at) -> None:
        tails = store.read("tails", before=version)
        e, after = temporal_graph.continued(conform(done.filter("chunk_index = 0"), EVENT), tails, key)
        store.append("edges", temporal_graph.edges(e, [key]), version)
        store.append("nodes", temporal_graph.event_nodes(e), version)
        store.append("tails", after, version)

    def compact(done: DataFrame, version: int, at) -> None:
        if not due(last.get("compaction"), now()):
            return
        made = compaction.compact(compaction.last_days(store.read("events", days(7)), at), at, threshold=threshold)
        version = store.version()  # later than what this batch has stored
        store.append("tasks", made.tasks, version)
        store.append("events", made.events.filter("compacted"), version)
        last["compaction"] = now()

    def hours(done: DataFrame, version: int, at) -> None:
        seen = rollup.hours(done).select("date", "hour").distinct()
        store.append("seen", seen, version)
        lately = store.read("seen").filter(F.col("date") >= F.date_sub(F.to_date(at), 1))
        summed = store.read("hours").filter(F.col("date") >= F.date_sub(F.to_date(at), 1))
        p = [(r.date, r.hour) for r in tasks.unsummed_hours(lately, summed, at).collect()]  # four at most
        if not p:
            return
        e = rollup.hours(store.read("events", {str(d) for d, _ in p})).filter(F.struct("date", "hour").isin([F.struct(F.lit(d).alias("date"), F.lit(h).alias("hour")) for d, h in p]))
        h = rollup.hour_aggregate(e)
        h = h.withColumn("title", F.array_join(F.slice("apps", 1, 3), ", ")).withColumn("summary", F.array_join("lines", "; ")).withColumn("generated_at", at)
        store.append("hours", h, version)

    def run(events: DataFrame, number: int) -> None:
        done = ingest(events, number)
        if events.isEmpty():
            return
        at, version = F.to_timestamp(F.lit(now())), store.version(writer, number)
        for step in (graph, compact, hours):
            try:
                step(done, version, at)
            except Exception:  # the next cycle tries again
                logging.getLogger(__name__).exception("%s failed", step.__name__)
        if number % FOLD == FOLD - 1:
            store.fold("tails")
            store.fold("seen", keep=F.col("date") >= F.date_sub(F.to_date(at), 2))

    return run
