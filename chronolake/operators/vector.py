"""Nearest neighbours, votes, and near-duplicates by vector."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cosine, literal_vector, recency
from .cells import CELLS, GROUP, matrix, meeting, numbers, tiles, unit_vectors, written

#: Bytes and number of query vectors that go to every task; more are dealt in blocks of so many queries and events.
SENT, SENT_ROWS = 64 << 20, 100_000
QUERIES, BLOCK = 4096, 4096


def nearest(events: DataFrame, query: list[float], k: int, floor: float = 0.0, where: Column | None = None) -> DataFrame:
    """The ``k`` events of the highest cosine, each id once by its best chunk, ties by id, with ``score``.

    The filter is applied before scoring, so it never starves the result; rows without a vector are left out. One scan
    with a running top k in each task, no shuffle of vectors but for the k best."""
    e = events.filter("embedding is not null")
    e = e if where is None else e.filter(where)
    e = e.withColumn("score", cosine("embedding", literal_vector(query)))
    e = e.filter(F.col("score") >= floor) if floor > 0 else e
    rest = [c for c in e.columns if c != "id"]
    best = e.groupBy("id").agg(F.max_by(F.struct(*rest), "score").alias("_r")).select("id", *(F.col(f"_r.{c}").alias(c) for c in rest)) if "chunk_index" in e.columns else e
    return best.orderBy(F.desc("score"), "id").limit(k)


def similar(events: DataFrame, query: list[float], floor: float) -> DataFrame:
    """All events whose cosine is at least ``floor``, with ``score``: a filter, in no order."""
    return events.filter("embedding is not null").withColumn("score", cosine("embedding", literal_vector(query))).filter(F.col("score") >= floor)


def _best(q, v, k: int):
    """(row of ``q``, row of ``v``, cosine) of the k best for each row of ``q``, and what ties with them."""

    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    q, v = unit(q), unit(v)
    m = min(k, len(v))
    mine, theirs, scores = [], [], []
    for i in range(0, len(q), 256):
        s = np.clip(q[i : i + 256] @ v.T, -1, 1)
        least = np.partition(s, len(v) - m, axis=1)[:, len(v) - m]
        x, y = np.nonzero(s >= least[:, None] - 1e-12)  # ties too: ids decide later
        mine.append(x + i)
        theirs.append(y)
        scores.append(s[x, y])
    return np.concatenate(mine), np.concatenate(theirs), np.concatenate(scores)


def nearest_of_each(queries: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) for many query vectors (query_id, query): matrix products over Arrow batches.

    Up to SENT bytes and SENT_ROWS queries go to every task, and events are not shuffled. More are dealt in blocks of QUERIES to
    blocks of BLOCK events; the best of each pair of blocks then meet, so any number of queries has its exact result."""
    e = events.filter("embedding is not null").select("id", "embedding")
    total = queries.agg(F.count("*").alias("n"), F.sum(F.size("query")).alias("size")).first()
    if not total.n:
        return queries.sparkSession.createDataFrame([], "query_id string, id string, score double, rank int")
    found = _sent(queries, e, k) if total.n <= SENT_ROWS and (total.size or 0) * 8 <= SENT else _dealt(queries, total.n, e, k)
    # sums of products in another order differ in the last digits: scores are compared at twelve
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sent(queries: DataFrame, events: DataFrame, k: int) -> DataFrame:

    rows = queries.select("query_id", "query").collect()
    q = np.array([r.query for r in rows], float)
    names = np.array([str(r.query_id) for r in rows])

    def search(batches):
        for b in batches:
            if b.num_rows:
                x, y, s = _best(q, np.array(b.column("embedding").to_pylist(), float), k)
                yield pa.RecordBatch.from_pydict({"query_id": names[x].tolist(), "id": b.column("id").take(pa.array(y)), "score": s})

    return events.mapInArrow(search, "query_id string, id string, score double")


def _dealt(queries: DataFrame, n: int, events: DataFrame, k: int) -> DataFrame:

    blocks, parts = -(-events.count() // BLOCK) or 1, -(-n // QUERIES)
    deal = lambda count, *of: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # each event once for each block of queries, each query once for each block of events
    data = events.select(deal(blocks, "id", "embedding").alias("block"), each(parts).alias("part"), F.lit(False).alias("asks"), F.col("id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    asks = queries.select(each(blocks).alias("block"), deal(parts, "query_id").alias("part"), F.lit(True).alias("asks"), F.col("query_id").cast("string").alias("name"), F.col("query").cast("array<double>").alias("v"))

    def search(t: pa.Table) -> pa.Table:
        own = t.column("asks").to_numpy()
        q, e = t.filter(pa.array(own)), t.filter(pa.array(~own))
        x = y = s = np.zeros(0, int)
        if q.num_rows and e.num_rows:
            x, y, s = _best(np.stack(q.column("v").to_numpy()), np.stack(e.column("v").to_numpy()), k)
        return pa.table({"query_id": q.column("name").take(pa.array(x)), "id": e.column("name").take(pa.array(y)), "score": pa.array(s, pa.float64())})

    return data.unionByName(asks).groupBy("block", "part").applyInArrow(search, "query_id string, id string, score double")


def vote(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Category of each query from its neighbours (query_id, category, score): the category of the largest sum of scores.

    Confidence: its share of the scores of all neighbours that have one, plus up to 0.2 for the share of neighbours that
    agree; kind is rag at ``threshold`` or more, else fallback. Without a categorised neighbour category is null, fallback, 0.5."""
    n = neighbours.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("category").isNotNull(), F.col("score"))).alias("total"))
    c = neighbours.filter("category is not null").groupBy("query_id", "category").agg(F.sum("score").alias("s"), F.count("*").alias("k"))
    c = c.groupBy("query_id").agg(F.min(F.struct((-F.col("s")).alias("m"), "category", "k")).alias("b"))
    t = n.join(c, "query_id", "left")
    share = F.try_divide(-F.col("b.m"), F.col("total")) + F.least(F.lit(0.2), 0.2 * F.col("b.k") / F.col("n"))
    return t.select("query_id", F.col("b.category").alias("category"), F.coalesce(share, F.lit(0.5)).alias("confidence"), F.when(share >= threshold, "rag").otherwise("fallback").alias("kind"))


def fuse(arms: list[DataFrame], pool: int, constant: int = 60) -> DataFrame:
    """(id, score) by reciprocal ranks: each arm (id, score) gives 1 / (constant + rank), summed by id; the best ``pool``."""
    out = None
    for a in arms:  # each arm is a top-k list already
        r = a.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", (1.0 / (F.lit(constant) + F.col("_rank"))).alias("s"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(pool)


def hybrid(vector_arm: DataFrame, text_arm: DataFrame, events: DataFrame, now: Column, limit: int, pool: int = 40, weight: float = 0.02, days: float = 30.0) -> DataFrame:
    """Events (with score, score_kind) by fused ranks of both arms plus recency; cosine plus recency where no text matched.

    Arms are (id, score) lists of at most ``pool`` rows. Each is made once: one short list holds both, and which form holds is
    read off it."""
    pool = max(pool, limit)
    both = vector_arm.select("id", "score", F.lit("v").alias("arm")).unionByName(text_arm.select("id", "score", F.lit("t").alias("arm")))
    both = both.withColumn("_r", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("score"), "id")))
    short = both.groupBy("id").agg(F.sum(1.0 / (60 + F.col("_r"))).alias("s"), F.max(F.when(F.col("arm") == "v", F.col("score"))).alias("c"), F.max(F.col("arm") == "t").alias("_t"))
    text = F.max("_t").over(Window.partitionBy())  # 2 * pool rows at most
    short = short.select("id", F.when(text, F.col("s")).otherwise(F.col("c")).alias("score"), F.when(text, "rrf").otherwise("cosine").alias("score_kind"))
    short = short.orderBy(F.desc("score"), "id").limit(pool)
    out = events.join(F.broadcast(short), "id")  # at most 2 * pool rows
    out = out.withColumn("score", F.col("score") + recency("timestamp", now, weight, days))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def rerank(pool: DataFrame, scorer, limit: int, text: Column) -> DataFrame:
    """A pool (id, ...) in the order of ``scorer(texts) -> scores``, which replaces ``score``; without a scorer, or with
    fewer than two rows, or if it fails or gives another number of scores, the pool as it was. A pool is one task's few rows."""

    if scorer is None:
        return pool.orderBy(F.desc("score"), "id").limit(limit)

    def run(frames):
        p = pd.concat(list(frames), ignore_index=True)
        if len(p) >= 2:
            try:
                s = list(scorer(p["_text"].tolist()))
            except Exception:  # a model that fails leaves the order as it was
                s = []
            if len(s) == len(p):
                p["score"] = [float(x) for x in s]
                p["score_kind"] = "rerank"
        yield p.drop(columns="_text")

    t = pool.withColumn("_text", text)
    t = t if "score_kind" in t.columns else t.withColumn("score_kind", F.lit("given"))
    from pyspark.sql import types as T

    schema = T.StructType([f for f in t.schema.fields if f.name != "_text"])
    return t.coalesce(1).mapInPandas(run, schema).orderBy(F.desc("score"), "id").limit(limit)


def greedy_dedup(events: DataFrame, keys: list[str], threshold: float, least: int = 50, block: int = BLOCK) -> DataFrame:
    """In order of time, rows without those whose vector resembles (cosine >= threshold) any kept row of their group; groups
    of at most ``least`` rows and rows without a vector stay whole. A group of at most ``block`` rows is one ordered scan over
    its kept vectors; larger ones are decided in rounds by many tasks (``spread_dedup``)."""
    from .cluster import by_size

    def scan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["timestamp", "id"], kind="stable")
        if len(p) <= least:
            return p
        has = p["embedding"].notna().to_numpy()
        keep, n = ~has, 0
        if has.any():
            v = unit_vectors(np.array(p["embedding"][has].tolist(), float))
            kept = np.empty_like(v)
            for k, x in zip(np.flatnonzero(has), v, strict=True):
                if not n or float((kept[:n] @ x).max()) < threshold:
                    keep[k], kept[n] = True, x
                    n += 1
        return p[keep]

    small, large = by_size(events, keys, max(block, least))
    out = small.groupBy(*keys).applyInPandas(scan, events.schema)
    return out if large is None else out.unionByName(spread_dedup(large, keys, threshold, block))


def _decided(threshold: float):
    """For each undecided row: whether it resembles an earlier row that is kept (it goes), and whether it resembles an earlier one
    that is still open. Within a tile rows are gone through in order of time, so that what is decided there counts at once."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("ts", "ascending"), ("id", "ascending"), ("rid", "ascending")]))
        rid, blk, two, alone, kept = numbers(t, "rid", "blk", "two", "alone", "kept")
        x = unit_vectors(matrix(t.column("v")))
        goes, waits, stays = np.zeros(len(x), bool), np.zeros(len(x), bool), kept.copy()
        if two[0]:
            low = blk == blk.min()
            for of, others in ((low, np.flatnonzero(~low)), (~low, np.flatnonzero(low))):
                asks = np.flatnonzero(of & ~kept)
                step = max(1, CELLS // max(1, len(others)))
                for i in range(0, len(asks), step):
                    k = asks[i : i + step]
                    near = (x[k] @ x[others].T >= threshold) & (others[None] < k[:, None])
                    goes[k], waits[k] = (near & kept[others][None]).any(1), (near & ~kept[others][None]).any(1)
        else:
            i = 0
            while i < len(x):
                j = min(len(x), i + max(1, min(512, CELLS // (i + 512))))
                k = i + np.flatnonzero(~kept[i:j])
                past, near = np.flatnonzero(~goes[:i]), x[k] @ x[i:j].T >= threshold
                before = x[k] @ x[past].T >= threshold
                gone, open_ = (before & stays[past][None]).any(1), (before & ~stays[past][None]).any(1)
                for r, (own, g, w) in enumerate(zip(k.tolist(), gone.tolist(), open_.tolist(), strict=True)):
                    like = near[r, : own - i] & ~goes[i:own]
                    goes[own] = g or bool((like & stays[i:own]).any())
                    waits[own] = not goes[own] and (w or bool(like.any()))
                    stays[own] = alone[own] and not goes[own] and not waits[own]
                i = j
        return pa.table({"rid": rid[~kept], "goes": goes[~kept], "waits": waits[~kept]})

    return run


def spread_dedup(events: DataFrame, keys: list[str], threshold: float, block: int = BLOCK) -> DataFrame:
    """``greedy_dedup`` of groups of any size: what stays is the lexicographically first maximal set of rows none of which
    resembles another.

    Of equal vectors only the first can stay. The others are cut in tiles that meet in pairs, where a row meets all that resemble it.
    In each round a row that resembles a kept one goes, and one whose earlier neighbours have all gone stays; then
    rows that went take no part. Rows that meet their own tile alone are decided as far as it allows in one round, so
    rounds are as many as chains of open neighbours cross tiles."""
    from .cluster import as_rows

    if threshold <= 0:
        raise ValueError("the threshold is above 0")
    e, rows = as_rows(events, keys)
    some = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))  # rows without a direction resemble none
    v = rows.filter(F.exists("v", lambda x: x != 0))
    first = v.groupBy("grp", "v").agg(F.min(F.struct("ts", "id", "rid")).alias("r")).select("grp", "r.*", "v")
    put = tiles(first, math.sqrt(max(0.0, 2 - 2 * threshold)), block)
    state = e.sparkSession.createDataFrame([], "rid long, kept boolean")
    while True:
        now = meeting(put.join(state, "rid", "left").filter("kept is null or kept").withColumn("kept", F.coalesce("kept", F.lit(False))))
        said = now.groupBy(*GROUP).applyInArrow(_decided(threshold), "rid long, goes boolean, waits boolean").groupBy("rid").agg(F.max("goes").alias("goes"), F.max("waits").alias("waits"))
        said = written(said)
        state = written(state.unionByName(said.filter("goes or not waits").select("rid", (~F.col("goes")).alias("kept"))))
        if not said.filter("not goes and waits").take(1):
            break
    stays = state.filter("kept").select(F.col("rid").alias("_stays"))
    return e.filter(~some).drop("_rid", "_grp").unionByName(e.join(stays, F.col("_rid") == F.col("_stays"), "left_semi").drop("_rid", "_grp"))
