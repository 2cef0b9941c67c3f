"""Hard negatives for anchor-positive pairs by a two-dimensional block matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, blobs, by_key, ints, raw, store, table
from .vectors import _TYPES, _exact

#: Anchors and rows of a tile.
ANCHORS, ROWS = 256, 1024
#: Components of a chunk at least, and chunks of a vector at most: each chunk makes a partial tile that is shuffled.
WIDTH, CHUNKS = 32, 4


def _narrow(x: np.ndarray) -> int:
    """Bytes of the smallest whole-number type that holds all of ``x``."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(w for w, t in _TYPES.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _pieces(batches):
    """Chunks of vectors as bytes, those of a batch that are of one length in one type."""
    for b in batches:
        v = b.column("v")
        at = v.offsets.to_numpy() - v.offsets[0].as_py()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(at)
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            x = flat[at[rows][:, None] + np.arange(d)]
            w = _narrow(x)
            rest = {c: b.column(c).take(pa.array(rows)) for c in ("vec_id", "label", "is_anchor", "dim", "c")}
            yield batch(**rest, wide=np.full(len(rows), w, np.int8), v=blobs(x.astype(_TYPES[w]).ravel(), np.full(len(rows), d)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices; in double precision where all sums are exact in it."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _edges(*cols: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of rows that agree in all columns begin and end."""
    if not len(cols[0]):
        return []
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], len(new)], strict=True))


def best(n: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the entries (n, row, score) are among the k of highest score for their n; ties to the smaller id."""
    order = np.lexsort((ids[row], -score, n))
    n = n[order]
    first = np.searchsorted(n, n)
    return order[np.arange(len(n)) - first < k]


def _partial(t: pa.Table):
    """Partial tiles: for each anchor and block of rows the scores of one chunk, and once for each tile the rows' ids and labels."""
    tile, block, part, c, kind, ids, label, wide, group = (ints(t.column(x)) for x in ("tile", "block", "part", "c", "kind", "vec_id", "label", "wide", "grp"))
    data, at = raw(t.column("v"))
    more, more_at = raw(t.column("more"))
    dims = np.diff(at) // np.maximum(wide, 1)
    for lo, hi in _edges(tile, group, block, part, c):
        m = lo + int(np.searchsorted(kind[lo:hi], 1))
        if not lo < m < hi:
            continue
        d = int(dims[lo])
        s = product(_exact(data, at[lo:m], wide[lo:m], d), _exact(data, at[m:hi], wide[m:hi], d))
        w, n = _narrow(s), m - lo
        same = {x: np.full(n, v) for x, v in (("tile", tile[lo]), ("grp", group[lo]), ("block", block[lo]), ("part", part[lo]), ("c", c[lo]))}
        yield batch(**same, kind=np.ones(n, np.int8), vec_id=ids[lo:m], label=label[lo:m], wide=np.full(n, w, np.int8), v=blobs(s.astype(_TYPES[w]).ravel(), np.full(n, hi - m)), more=blobs(more[more_at[lo] : more_at[m]], np.diff(more_at[lo : m + 1])))
        if c[lo] == 0:
            whose = np.concatenate([ids[m:hi], label[m:hi]]).astype(np.int64)
            one = {x: v[:1] for x, v in same.items()}
            yield batch(**one, kind=np.zeros(1, np.int8), vec_id=np.zeros(1, np.int64), label=np.zeros(1, np.int64), wide=np.full(1, 8, np.int8), v=blobs(whose, np.array([len(whose)])), more=pa.array([b""], pa.binary()))


_PARTIAL = "tile long, grp long, block int, part int, c int, kind byte, vec_id long, label long, wide byte, v binary, more binary"


def _tiles(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, reduce, schema: str) -> DataFrame:
    """``reduce``(anchor ids, anchor labels, what anchors bring along, row ids, row labels, scores) over all tiles of anchors and
    rows that share ``grp``. sizes: (grp, nb, nq), the blocks of rows and of anchors."""
    blocks, parts = F.sequence(F.lit(0), F.col("nb") - 1), F.sequence(F.lit(0), F.col("nq") - 1)
    kind = lambda n: F.lit(n).cast("byte").alias("kind")
    block = F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int").alias("block")
    part = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.col("nq")).cast("int").alias("part")
    asks = anchors.join(sizes, "grp").select("grp", F.explode(blocks).alias("block"), part, "c", kind(0), "vec_id", "label", "wide", "v", "more")
    data = rows.join(sizes, "grp").select("grp", block, F.explode(parts).alias("part"), "c", kind(1), "vec_id", "label", "wide", "v", F.lit(b"").alias("more"))
    met = asks.unionByName(data).withColumn("tile", F.xxhash64("grp", "block", "part")).withColumn("g", F.xxhash64("tile", "c"))
    partial = by_key(met, "g", _partial, _PARTIAL, "tile", "grp", "block", "part", "c", "kind", "vec_id")

    def add(t: pa.Table):
        tile, group, block, part, kind, ids, label, wide = (ints(t.column(x)) for x in ("tile", "grp", "block", "part", "kind", "vec_id", "label", "wide"))
        data, at = raw(t.column("v"))
        more, more_at = raw(t.column("more"))
        for lo, hi in _edges(tile, group, block, part):
            head = data[at[lo] : at[lo + 1]].view(np.int64).reshape(2, -1)
            own = np.arange(lo + 1, hi)
            starts = np.array([a for a, _ in _edges(ids[own])])
            s = np.zeros((len(starts), head.shape[1]), np.int64)
            whose = np.searchsorted(starts, np.arange(len(own)), "right") - 1
            np.add.at(s, whose, _exact(data, at[own], wide[own], head.shape[1]))
            first = own[starts]
            # of the chunks' rows of an anchor only one, the first, brings something along
            brought = more[more_at[lo + 1] : more_at[hi]].view(np.int64)
            yield from reduce(ids[first], label[first], brought, head[0], head[1], s)

    return by_key(partial, "tile", add, schema, "grp", "block", "part", "kind", "vec_id", "c")


def _sizes(rows: DataFrame) -> DataFrame:
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    n = rows.filter("c = 0").groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("q")).filter("q > 0")
    return store(n.select("grp", parts("n", ROWS).alias("nb"), parts("q", ANCHORS).alias("nq")))


def _positives(k: int):
    def reduce(anchors, _, __, ids, ___, s):
        s[anchors[:, None] == ids] = np.iinfo(np.int64).min
        most = min(k, len(ids))
        kth = np.partition(s, len(ids) - most, axis=1)[:, len(ids) - most]
        n, row = np.nonzero((s >= kth[:, None]) & (anchors[:, None] != ids))
        keep = best(n, row, s[n, row], ids, k)
        n, row = n[keep], row[keep]
        yield batch(anchor_id=anchors[n], positive_id=ids[row], positive_score=s[n, row])

    return reduce


def _negatives(k: int, least: int, most: int):
    def reduce(anchors, labels, brought, ids, row_labels, s):
        # for each anchor: how many positives, then their ids and scores
        count, at = [], 0
        for _ in range(len(anchors)):
            count.append(int(brought[at]))
            at += 1 + 2 * count[-1]
        size = np.array(count)
        first = np.cumsum(1 + 2 * size) - 2 * size
        for j in range(int(size.max())):
            has = size > j
            pos = np.where(has, brought[np.minimum(first + 2 * j, len(brought) - 1)], 0)
            score = np.where(has, brought[np.minimum(first + 2 * j + 1, len(brought) - 1)], -1)
            low = np.array([-(-least * x // most) for x in score.tolist()], np.int64)  # the smallest whole number in the window
            n, row = np.nonzero((s <= score[:, None]) & (s >= low[:, None]) & (labels[:, None] != row_labels) & has[:, None])
            keep = best(n, row, s[n, row], ids, k)
            n, row = n[keep], row[keep]
            if len(n):
                yield batch(anchor_id=anchors[n], positive_id=pos[n], positive_score=score[n], negative_id=ids[row], negative_score=s[n, row])

    return reduce


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, label: a whole
    number, v: array of whole numbers).

    An anchor is a row where ``is_anchor`` holds; its positives are the first ``positives`` other rows of its label by inner
    product, ties to the smaller vec_id. For each positive the first ``k`` rows of other labels follow whose score s has
    least * positive_score <= most * s <= most * positive_score; all, if fewer; none, if none.

    The matrix of scores is cut in tiles of ANCHORS anchors and ROWS rows, and the vectors in chunks of components. Each tile
    of a chunk is one product in a task; partial tiles are shuffled and added in 64-bit whole numbers; a tile gives the best
    few of each window, and these few are ranked. Positives come from tiles within a label, a label with many rows being many
    blocks; negatives from tiles of all rows, into which anchors bring their positives' scores. No tile is stored.

    Rows of null ids, labels, vectors or components take no part, empty vectors neither; only vectors of one length are
    compared; of rows under one vec_id the smallest (label, v) counts. Scores fit 64 bits. An anchor without
    a positive, and a positive of negative score, for which the window is empty, have no rows. Other columns are ignored; an
    empty table gives an empty table."""
    t = vectors.filter("vec_id is not null and label is not null and v is not null and size(v) > 0").filter(~F.exists("v", lambda x: x.isNull()))
    t = t.select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), "v")
    if t.groupBy("vec_id").count().filter("count > 1").take(1):
        t = t.groupBy("vec_id").agg(F.max("is_anchor").alias("is_anchor"), F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "is_anchor", "r.v")
    t = t.withColumn("dim", F.size("v")).withColumn("w", F.greatest(F.lit(WIDTH), F.ceil(F.col("dim") / CHUNKS)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("dim") - 1) / F.col("w")).cast("int")), lambda i: F.slice("v", i * F.col("w") + 1, F.col("w")))
    t = t.select("vec_id", "label", "is_anchor", "dim", F.posexplode(cut).alias("c", "v"))
    rows = store(t.mapInArrow(_pieces, "vec_id long, label long, is_anchor boolean, dim int, c int, wide byte, v binary"))

    within = rows.withColumn("grp", F.xxhash64("dim", "label"))
    near = _tiles(within, within.filter("is_anchor").withColumn("more", F.lit(b"")), _sizes(within), _positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    near = near.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("p"))  # at most ``positives``

    def bring(batches):
        for b in batches:
            p = [[len(x), *(y for z in x for y in (z["positive_id"], z["positive_score"]))] for x in b.column("p").to_pylist()]
            yield batch(anchor_id=b.column("anchor_id"), more=blobs(np.array([y for x in p for y in x], np.int64), np.array([len(x) for x in p], np.int64)))

    near = store(near.mapInArrow(bring, "anchor_id long, more binary"))
    everyone = rows.withColumn("grp", F.col("dim").cast("long"))
    asks = everyone.filter("is_anchor").join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    asks = asks.withColumn("more", F.when(F.col("c") == 0, F.col("more")).otherwise(F.lit(b"")))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _tiles(everyone, asks, _sizes(everyone), _negatives(k, least, most), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, in whole-number components; every seventh vector's label is the next one."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").filter("embedding is not null and label is not null")
    t = t.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(t.select("vec_id", label.alias("label"), v.alias("v")), F.col("vec_id") % 100 == 0)


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not alike and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5
"""
