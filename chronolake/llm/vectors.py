"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, blobs, by_key, ints, raw, store, table

#: Approximations to a block, and queries to a block of queries.
BLOCK, QUERIES = 16384, 1024
#: Bits of a cell's number: each dimension's range is cut in so many equal cells as they can count.
BITS = 6
#: Exact vectors that are read first for each query, as a multiple of k.
FIRST = 4

_TYPES = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _packed(batches):
    """Vectors as bytes, each in the smallest type that holds it, so that equal vectors are equal bytes."""
    for b in batches:
        v = b.column("v")
        at = v.offsets.to_numpy() - v.offsets[0].as_py()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(flat):
            continue
        low, high = np.minimum.reduceat(flat, at[:-1]), np.maximum.reduceat(flat, at[:-1])
        wide = np.full(len(low), 8, np.int8)
        for w in (4, 2, 1):
            t = np.iinfo(_TYPES[w])
            wide[(t.min <= low) & (high <= t.max)] = w
        n = np.diff(at)
        for w in np.unique(wide).tolist():
            rows = np.flatnonzero(wide == w)
            own = flat[np.repeat(wide == w, n)].astype(_TYPES[w])
            yield batch(vec_id=ints(b.column("vec_id"))[rows], is_query=b.column("is_query").take(pa.array(rows)), dim=n[rows].astype(np.int64), wide=wide[rows], v=blobs(own, n[rows]))


def _exact(data: np.ndarray, at: np.ndarray, wide: np.ndarray, dim: int) -> np.ndarray:
    """Rows of packed vectors of one length as a matrix."""
    out = np.empty((len(wide), dim), np.int64)
    for w in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == w)
        own = data[(at[rows][:, None] + np.arange(dim * w)).ravel()]
        out[rows] = own.view(_TYPES[w]).reshape(len(rows), dim)
    return out


def _ranges(batches):
    """(dim, j, low, high): the range of each component of all vectors of one length."""
    seen: dict[int, tuple] = {}
    for b in batches:
        (data, at), wide, dims = raw(b.column("v")), ints(b.column("wide")), ints(b.column("dim"))
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            x = _exact(data, at[rows], wide[rows], d)
            low, high = seen.get(d, (x[0], x[0]))
            seen[d] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    for d, (low, high) in seen.items():
        yield batch(dim=np.full(d, d), j=np.arange(d), low=low, high=high)


def _grid(data: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first cell of each dimension begins, and how wide the cells are."""
    low, high = data.view(np.int64).reshape(2, dim)
    return low, -(-(high - low + 1) // (1 << BITS))


def _pack(cell: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(cell.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(cell), -1), axis=1)


def _unpack(data: np.ndarray, dim: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1)[:, : dim * BITS].reshape(len(data), dim, BITS)
    return np.packbits(bits, axis=2)[:, :, 0] >> (8 - BITS)


def _cells(batches):
    """Each vector's cell numbers, BITS for each dimension."""
    for b in batches:
        (data, at), (grid, grid_at) = raw(b.column("v")), raw(b.column("grid"))
        ids, wide, dims = (ints(b.column(c)) for c in ("vec_id", "wide", "dim"))
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            low, step = _grid(grid[grid_at[rows[0]] : grid_at[rows[0] + 1]], d)
            cell = _pack((_exact(data, at[rows], wide[rows], d) - low) // step)
            yield batch(vec_id=ids[rows], dim=dims[rows], cell=blobs(cell.ravel(), np.full(len(rows), cell.shape[1])))


def _bounds(ids: np.ndarray, cell: np.ndarray, low: np.ndarray, step: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """(query, row, least, most): bounds of the scores of those rows that can be among a query's k best of this block."""
    corner = cell.astype(np.float64) * step + low
    high = np.abs(q).astype(np.float64) @ np.maximum(np.abs(low), np.abs(low + step * ((1 << BITS) - 1) + step))
    error = np.where(high < 2**53, 0.0, high * q.shape[1] * 2.0**-51)  # whole numbers are exact up to there
    up = np.maximum(q, 0).astype(np.float64) @ (step - 1) + error
    down = np.minimum(q, 0).astype(np.float64) @ (step - 1) - error
    for i in range(0, len(q), 128):
        score = q[i : i + 128].astype(np.float64) @ corner.T
        score[qids[i : i + 128, None] == ids] = -np.inf
        most = min(k, len(ids))
        kth = np.partition(score, len(ids) - most, axis=1)[:, len(ids) - most]
        kth = np.where(np.isfinite(kth), kth, -1e308)  # the query itself may be among so few
        n, row = np.nonzero(score + up[i : i + 128, None] >= (kth + down[i : i + 128])[:, None])
        yield n + i, row, score[n, row] + down[n + i], score[n, row] + up[n + i]


def _file(vectors: DataFrame, is_query: Column) -> DataFrame:
    """The exact vectors, as bytes: (vec_id, is_query, dim, wide, v)."""
    t = vectors.filter("vec_id is not null and v is not null and size(v) > 0").filter(~F.exists("v", lambda x: x.isNull()))
    t = t.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), "v")
    if t.groupBy("vec_id").count().filter("count > 1").take(1):
        t = t.groupBy("vec_id").agg(F.max("is_query").alias("is_query"), F.min("v").alias("v"))
    return store(t.mapInArrow(_packed, "vec_id long, is_query boolean, dim long, wide byte, v binary"))


def _candidates(exact: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, least, most): bounds of the scores of all pairs that bounds alone don't rule out."""
    grid = exact.select("dim", "wide", "v").mapInArrow(_ranges, "dim long, j long, low long, high long").groupBy("dim", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    grid = grid.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("j", "low", "high"))).alias("x"))
    to_bytes = lambda b: iter([batch(dim=b.column("dim"), grid=pa.array([np.array([[y[c] for y in x] for c in ("low", "high")], np.int64).tobytes() for x in b.column("x").to_pylist()], pa.binary()))])
    grid = grid.mapInArrow(lambda batches: (r for b in batches for r in to_bytes(b)), "dim long, grid binary")
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sizes = exact.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).filter("q > 0")
    grid = store(grid.join(sizes.select("dim", parts("n", BLOCK).alias("nb"), parts("q", QUERIES).alias("nq")), "dim"))
    sizes = grid.drop("grid")
    # of equal vectors only the k + 1 smallest ids can be among a query's k best: the others tie with them, and come later
    equal = Window.partitionBy("dim", "wide", "v").orderBy("vec_id")
    unlike = exact.drop("is_query").withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1)
    cells = store(unlike.join(grid, "dim").select("vec_id", "dim", "wide", "v", "grid").mapInArrow(_cells, "vec_id long, dim long, cell binary"))
    blocks, groups = F.sequence(F.lit(0), F.col("nb") - 1), F.sequence(F.lit(0), F.col("nq") - 1)
    block = F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int")
    group = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.col("nq")).cast("int")
    # a group for each block of cells and block of queries: the grid, the queries' exact vectors, and cells
    kind = lambda n: F.lit(n).cast("byte").alias("kind")
    none = F.lit(0).cast("byte").alias("wide")
    near = grid.withColumn("block", F.explode(blocks)).select("dim", "block", F.explode(groups).alias("part"), kind(0), F.lit(0).cast("long").alias("vec_id"), none, F.col("grid").alias("v"))
    asks = exact.filter("is_query").join(sizes, "dim").select("dim", F.explode(blocks).alias("block"), group.alias("part"), kind(1), "vec_id", "wide", "v")
    data = cells.join(sizes, "dim").select("dim", block.alias("block"), F.explode(groups).alias("part"), kind(2), "vec_id", none, F.col("cell").alias("v"))
    both = near.unionByName(asks).unionByName(data).withColumn("g", F.xxhash64("dim", "block", "part"))

    def search(t: pa.Table):
        kind, ids, wide, dims, block, part = (ints(t.column(c)) for c in ("kind", "vec_id", "wide", "dim", "block", "part"))
        data, at = raw(t.column("v"))
        edge = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])]))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(kind)], strict=True):
            a, b = lo + np.searchsorted(kind[lo:hi], [1, 2])
            if a < b < hi:
                d = int(dims[lo])
                low, step = _grid(data[at[lo] : at[lo + 1]], d)
                q = _exact(data, at[a:b], wide[a:b], d)
                cell = _unpack(data[at[b] : at[hi]].reshape(hi - b, -1), d)
                for n, row, least, most in _bounds(ids[b:hi], cell, low, step, ids[a:b], q, k):
                    yield batch(query_id=ids[a + n], vec_id=ids[b + row], least=least, most=most)

    found = store(by_key(both, "g", search, "query_id long, vec_id long, least double, most double", "dim", "block", "part", "kind"))
    return store(_above(found, "least", k).select("query_id", "vec_id", "most"))


def _above(found: DataFrame, score: str, k: int) -> DataFrame:
    """Rows of ``found`` whose upper bound reaches the kth highest ``score`` of their query, if it has so many."""
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score)))).filter(F.col("n") <= k)
    kth = best.groupBy("query_id").agg(F.min(score).alias("kth"), F.count("*").alias("m")).filter(F.col("m") >= k).drop("m")
    return found.join(kth, "query_id", "left").filter("kth is null or most >= kth").drop("kth")


def _scores(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of ``pairs``, from the exact vectors."""

    def dot(batches):
        for b in batches:
            (x, x_at), (y, y_at) = raw(b.column("v")), raw(b.column("qv"))
            xw, yw, dims = (ints(b.column(c)) for c in ("wide", "qw", "dim"))
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                s = np.einsum("ij,ij->i", _exact(x, x_at[rows], xw[rows], d), _exact(y, y_at[rows], yw[rows], d))
                yield batch(query_id=ints(b.column("query_id"))[rows], vec_id=ints(b.column("vec_id"))[rows], score=s)

    asks = exact.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("wide").alias("qw"), F.col("v").alias("qv"))
    read = pairs.select("query_id", "vec_id").join(exact.select("vec_id", "dim", "wide", "v"), "vec_id").join(asks, "query_id")
    return read.mapInArrow(dot, "query_id long, vec_id long, score long")


def _reads(exact: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score) of the pairs whose exact vectors are read first, and of those read after these: of each query
    the pairs of the highest upper bounds, then all whose upper bound still reaches the kth best score."""
    found = _candidates(exact, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    first = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIRST * k).select("query_id", "vec_id")
    scored = store(_scores(first, exact))
    known = scored.select("query_id", "vec_id", F.lit(True).alias("known"))
    kth = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("n") == k)
    kth = kth.select("query_id", F.col("score").cast("double").alias("kth"))
    rest = found.join(kth, "query_id").filter("most >= kth").join(known, ["query_id", "vec_id"], "left_anti")
    return scored, _scores(rest, exact)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, v: array of whole numbers) where ``is_query``
    holds, the k other rows of the highest inner product, ties to the smaller vec_id; all, if there are fewer.

    Only vectors of one length are compared with each other; an empty one with none. Rows of null ids, null vectors or
    null components take no part; of rows under one vec_id the smallest vector counts; scores fit 64 bits. Other columns are
    ignored.

    Of many equal vectors only the k + 1 smallest ids are looked at further, since the rest tie with these and come after them.
    The approximation file holds BITS for each dimension of each vector: the cell of the dimension's range that its component
    is in. It is written once. Blocks of queries meet blocks of it, and every score gets bounds from cells alone; no exact
    vector but the queries' travels there. Pairs whose upper bound is below a query's kth lower bound are out. Of the rest,
    exact vectors are fetched by id in the order of their upper bounds: first FIRST * k for each query, then those whose
    upper bound reaches the kth best score. Then no vector that wasn't read can be among the k best."""
    exact = _file(vectors, is_query)
    first, rest = _reads(exact, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, in whole-number components."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = t.filter("embedding is not null").filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return top_k(t.select("vec_id", v.alias("v")), F.col("vec_id") % 50 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
