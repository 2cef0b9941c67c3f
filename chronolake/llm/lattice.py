"""Near-duplicate vectors: random projections hashed to points of the E8 lattice, neighbouring cells probed, cosines verified."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, blobs, by_key, components, ints, mix, raw, salts, store, table, unused
from .near import _roots

#: Length of a difference of two unit vectors in lattice units, and neighbouring cells that a vector probes in a table.
SCALE, PROBES = 1.25, 12
#: A random vector shares a block's cell with about one in so many others; a table has enough blocks to tell that many vectors apart.
APART = 100
#: Chance that a pair at the threshold meets in some table, if all tables are as good as they are on random directions.
RECALL = 0.99
#: Rows of one cell that meet in a task with as many others.
BLOCK = 512
#: Projections of the first block or two, as bytes: their distance tells most unlike pairs apart before any vector travels.
CODE = 32
#: A code's unit, and how far codes of linked vectors can be apart: above the 1 - 1e-7 quantile of their distance.
UNIT = 64.0


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of the lattice, doubled so that they are whole numbers."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


NEAR = _neighbours()


def decode(y: np.ndarray) -> np.ndarray:
    """For each row of eight numbers the nearest point of E8, doubled: the nearer of those of D8 and of D8 moved by a half."""

    def even(y):
        x = np.rint(y)
        off = y - x
        rows = np.flatnonzero(x.sum(1) % 2 != 0)
        k = np.abs(off[rows]).argmax(1)
        x[rows, k] += np.where(off[rows, k] >= 0, 1, -1)
        return x

    a, b = even(y), even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def shape(n: int, recall: float = RECALL) -> tuple[int, int]:
    """(blocks of eight projections in a table, tables) for ``n`` vectors: blocks grow with the logarithm of ``n``, tables so
    that a pair at the threshold still meets. Of such a pair, at random directions and with PROBES, a table of one block
    finds 0.97, of two 0.52, of three 0.25, of four 0.11 (simulated); 0.95 * 2^(1 - blocks) is close to that."""
    blocks = max(1, round(math.log(max(n, 2)) / math.log(APART)))
    p = 0.95 * 0.5 ** (blocks - 1)
    return blocks, max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _normals(seed: int, n: int) -> np.ndarray:
    """``n`` normal numbers that depend on ``seed`` alone."""
    u = (salts(seed, 2 * n) >> U64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2 * np.log(u[:n] + 2.0**-54)) * np.cos(2 * np.pi * u[n:])


class _Lattice:
    """Projections, offsets and hashes of all tables for vectors of ``dim`` components."""

    def __init__(self, dim: int, blocks: int, tables: int):
        self.blocks, self.tables = blocks, tables
        wide = 8 * blocks * tables
        self.to = _normals(1301, dim * wide).reshape(dim, wide) * (SCALE / math.sqrt(8))
        self.off = 2 * (salts(1302, wide) >> U64(11)).astype(np.float64) / 2.0**53
        self.salt = salts(1303, wide).reshape(tables, blocks, 8)
        with np.errstate(over="ignore"):  # what a step to a neighbouring cell adds to a cell's hash
            self.step = (NEAR.astype(U64)[None, None] * self.salt[:, :, None, :]).sum(3).reshape(tables, blocks * len(NEAR))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell in each table, cells probed in each, code) of unit vectors."""
        y = x @ self.to
        code = np.clip(np.rint(y[:, :CODE] * UNIT / 4), -127, 127).astype(np.int8)
        y = (y + self.off).reshape(-1, 8)
        cell = decode(y)
        rest = (y - cell / 2).reshape(len(x), self.tables, self.blocks, 8)
        with np.errstate(over="ignore"):
            h = (cell.reshape(len(x), self.tables, self.blocks, 8).astype(U64) * self.salt).sum((2, 3))
            # the step v leads nearer, the larger its product with what is left: |r - v|^2 = |r|^2 - 2 r v + 2
            gain = (rest.astype(np.float32) @ (NEAR.T / 2).astype(np.float32)).reshape(len(x), self.tables, -1)
            top = np.argpartition(-gain, PROBES, axis=2)[:, :, :PROBES]
            probed = h[:, :, None] + self.step[np.arange(self.tables)[None, :, None], top]
            fold = lambda v: (mix(v) >> U64(32)).astype(np.uint32)
            return fold(h), fold(probed), code


def _limit(threshold: float, projections: int) -> float:
    """How far codes of vectors that are linked can be apart, squared: Wilson and Hilferty's quantile of chi-squared at five
    standard deviations and a half, and room for rounding."""
    n = projections
    q = n * (1 - 2 / (9 * n) + 5.5 * math.sqrt(2 / (9 * n))) ** 3
    return (math.sqrt(2 * (1 - threshold) * q / 8) * SCALE * UNIT / 4 + 0.5 * math.sqrt(n)) ** 2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(kind):
    """Vectors as bytes with two names of 64 bits, by which equal ones meet."""

    def run(batches):
        for b in batches:
            v = b.column("v")
            at = v.offsets.to_numpy() - v.offsets[0].as_py()
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0 becomes 0
            if not len(flat):
                continue
            size = np.diff(at)
            bits = flat.view(np.uint32 if kind is np.float32 else U64).astype(U64)
            pos = (np.arange(len(flat)) - np.repeat(at[:-1], size)).astype(U64)
            with np.errstate(over="ignore"):
                k1 = np.add.reduceat(mix(mix(bits + U64(0x9E3779B97F4A7C15)) + pos * U64(0xC2B2AE3D27D4EB4F)), at[:-1])
                k2 = np.add.reduceat(mix(mix(bits ^ U64(0xA5A5A5A5A5A5A5A5)) ^ (pos * U64(0xD6E8FEB86659FD93))), at[:-1])
            yield batch(vec_id=b.column("vec_id"), k1=k1.view(np.int64), k2=k2.view(np.int64), dim=size.astype(np.int64), v=blobs(flat, size))

    return run


def _matrix(data: np.ndarray, at: np.ndarray, rows: np.ndarray, kind) -> np.ndarray:
    n = int(at[rows[0] + 1] - at[rows[0]])
    return data[at[rows][:, None] + np.arange(n)].view(kind).reshape(len(rows), -1)


def _hashed(kind, blocks: int, tables: int):
    """Cells and codes of each vector."""

    def run(batches):
        known: dict[int, _Lattice] = {}
        for b in batches:
            (data, at), dims = raw(b.column("v")), ints(b.column("dim"))
            for d in np.unique(dims).tolist():
                lattice = known.setdefault(d, _Lattice(d, blocks, tables))
                every = np.flatnonzero(dims == d)
                for i in range(0, len(every), 1024):
                    rows = every[i : i + 1024]
                    own, probed, code = lattice.cells(_unit(_matrix(data, at, rows, kind)))
                    cells = np.concatenate([own, probed.reshape(len(rows), -1)], axis=1)
                    take = {c: b.column(c).take(pa.array(rows)) for c in ("rep", "n_copies", "dim", "v")}
                    yield batch(**take, cells=blobs(cells.ravel(), np.full(len(rows), cells.shape[1])), code=blobs(code.ravel(), np.full(len(rows), code.shape[1])))

    return run


def _cell_rows(tables: int):
    """A row for each cell that a vector lies in or probes; the bucket's name holds dimension, table and cell."""

    def run(batches):
        t = np.concatenate([np.arange(tables), np.repeat(np.arange(tables), PROBES)]).astype(U64)
        for b in batches:
            if b.num_rows:
                cells = raw(b.column("cells"))[0].view(np.uint32).reshape(b.num_rows, -1).astype(U64)
                with np.errstate(over="ignore"):
                    key = mix((cells | (t << U64(32))) + mix(ints(b.column("dim")).astype(U64))[:, None])
                n = cells.shape[1]
                yield batch(key=key.ravel().view(np.int64), tab=np.tile(t.astype(np.int32), b.num_rows), home=np.tile(np.arange(n) < tables, b.num_rows), rep=np.repeat(ints(b.column("rep")), n))

    return run


def _close(g: np.ndarray, blk: np.ndarray, two: np.ndarray, home: np.ndarray, code: np.ndarray, limit: float):
    """Pairs (i, j) of rows of one group, one of them at home there, whose codes are near enough, by ever larger j - i."""
    x = code.astype(np.float32)
    for d in range(1, len(g)):
        i = np.flatnonzero(g[:-d] == g[d:])
        if not len(i):
            return
        i = i[(~two[i] | (blk[i] != blk[i + d])) & (home[i] | home[i + d])]
        for lo in range(0, len(i), 1 << 16):
            k = i[lo : lo + (1 << 16)]
            off = x[k] - x[k + d]
            k = k[np.einsum("ij,ij->i", off, off) <= limit]
            if len(k):
                yield k, k + d


def _first_meeting(cells: np.ndarray, tables: int, tab: np.ndarray, home: np.ndarray, rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair meets here first: in no earlier table, and, where each probes the other's cell, in that of the smaller."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        a, b = i[lo : lo + 4096], j[lo : lo + 4096]
        x, y = cells[a], cells[b]
        own_x, own_y = x[:, :tables], y[:, :tables]
        px, py = (z[:, tables:].reshape(len(a), tables, PROBES) for z in (x, y))
        there, here = (py == own_x[:, :, None]).any(2), (px == own_y[:, :, None]).any(2)  # y probes x's cell; x probes y's
        equal = own_x == own_y
        met = equal | there | here
        first = met.argmax(1) == tab[a]
        r = np.arange(len(a))
        both = (there & here & ~equal)[r, tab[a]]
        smaller = np.where(rep[a] < rep[b], home[a], home[b])
        out[lo : lo + 4096] = first & met.any(1) & (~both | smaller)
    return out


def _spread(df: DataFrame) -> DataFrame:
    """Buckets of ``n`` rows cut in blocks; each two blocks of a bucket, and each with itself, meet under one ``g``."""
    df = df.withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("two", F.col("blk") != F.col("other")).withColumn("g", F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other"))).drop("nb", "other", "n", "key")


def similar_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, v: array of float or double).

    Two rows are linked if a table finds them and their cosine, in double precision, is at least ``threshold``. A table
    projects the unit vectors on random directions, eight to a block; the nearest E8 points of its blocks are a vector's cell.
    A vector also probes the PROBES nearest cells that differ by one shortest step; a pair meets where one's own cell is
    the other's own or probed one. Blocks and tables follow from the number of vectors (``shape``). In a cell, pairs whose
    codes (a few projections as bytes) are too far apart go first; vectors travel only to where a pair is left, and every link
    is verified there and counted in the table where it meets first. Nothing below the threshold is linked; of pairs at it
    about 1 in 100 is missed, of closer ones ever fewer.

    n_links counts the other rows that a row is linked with, component_id is the smallest vec_id that links lead to, its own
    included; kept: whether that is the row's own. Equal vectors are one class and always linked, however many. Vectors of
    different length are never linked. A vector that is null, empty, zero or holds a null or non-finite component links with
    nothing. Rows of a null vec_id get nulls and 0 links; rows that share a vec_id count as rows of their own. Other columns
    are ignored; an empty table gives an empty table."""
    single = vectors.schema["v"].dataType.elementType.typeName() == "float"
    kind, v = (np.float32, F.col("v")) if single else (np.float64, F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    t = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok"))
    rows = store(t.filter("ok").select("vec_id", "v").mapInArrow(_packed(kind), "vec_id long, k1 long, k2 long, dim long, v binary"))
    # equal vectors: what follows is about one row for each class, numbered by writing
    rep = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n_copies"))
    rep = store(rep.withColumn("rep", F.monotonically_increasing_id()))
    n = rep.count()
    blocks, tables = shape(n, recall)
    one = rows.join(rep.withColumnRenamed("first", "vec_id"), ["vec_id", "k1", "k2"]).dropDuplicates(["rep"])
    known = store(one.select("rep", "n_copies", "dim", "v").mapInArrow(_hashed(kind, blocks, tables), "rep long, n_copies long, dim long, v binary, cells binary, code binary"))
    limit = _limit(threshold, min(CODE, 8 * blocks * tables))

    cell = known.select("rep", "dim", "cells").mapInArrow(_cell_rows(tables), "key long, tab int, home boolean, rep long")
    several = store(cell.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("at_home")).filter("n > 1 and at_home").drop("at_home"))
    met = _spread(store(cell.join(several, "key")))

    def codes(t):
        return raw(t.column("code"))[0].view(np.int8).reshape(t.num_rows, -1)

    def look(t: pa.Table):
        g, blk, two, tab, home, rep = (ints(t.column(c)) for c in ("g", "blk", "two", "tab", "home", "rep"))
        left = np.zeros(len(g), bool)
        for i, j in _close(g, blk, two, home, codes(t), limit):
            left[i] = left[j] = True
        m = np.flatnonzero(left)
        if len(m):
            yield batch(g=g[m], blk=blk[m], two=two[m], tab=tab[m], home=home[m], rep=rep[m])

    schema = "g long, blk int, two boolean, tab int, home boolean, rep long"
    met = store(by_key(met.join(known.select("rep", "code"), "rep").select("g", "blk", "two", "tab", "home", "rep", "code"), "g", look, schema))

    def verify(t: pa.Table):
        g, blk, two, tab, home, rep, copies, dims = (ints(t.column(c)) for c in ("g", "blk", "two", "tab", "home", "rep", "n_copies", "dim"))
        data, at = raw(t.column("v"))
        unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place = np.zeros(len(g), np.int64)
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            place[own] = np.arange(len(own))
            unit[d] = own, _unit(_matrix(data, at, own, kind))
        cells = raw(t.column("cells"))[0].view(np.uint32).reshape(t.num_rows, -1)
        links, roots = np.zeros(len(g), np.int64), np.arange(len(g))
        for i, j in _close(g, blk, two, home, codes(t), limit):
            good = np.zeros(len(i), bool)
            for d, (_, x) in unit.items():
                own = np.flatnonzero((dims[i] == d) & (dims[j] == d))
                if len(own):
                    good[own] = np.einsum("ij,ij->i", x[place[i[own]]], x[place[j[own]]]) >= threshold
            i, j = i[good], j[good]
            first = _first_meeting(cells, tables, tab, home, rep, i, j)
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            if len(i):
                roots = _joined(roots, i, j)
        m = np.flatnonzero(links)
        if len(m):
            yield batch(rep=rep[m], links=links[m], root=rep[roots[m]])

    found = met.join(known, "rep").select("g", "blk", "two", "tab", "home", "rep", "n_copies", "dim", "v", "cells", "code")
    # in order of rep, so that a root is the smallest one and the same in most cells: then components need few steps
    found = store(by_key(found, "g", verify, "rep long, links long, root long", "rep"))
    label = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked = label.join(found.groupBy("rep").agg(F.sum("links").alias("links")), F.col("node") == F.col("rep")).join(rep.select("rep", "first"), "rep")
    linked = store(linked.select("rep", "label", "links", "first"))
    smallest = store(linked.groupBy("label").agg(F.min("first").alias("smallest")))
    linked = store(linked.join(smallest, "label").select("rep", "smallest", "links"))
    classes = store(rep.join(linked, "rep", "left").select("k1", "k2", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first").alias("component_id")))
    done = rows.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = t.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _joined(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``roots`` after the rows i and j are connected."""
    return _roots(len(roots), np.concatenate([np.arange(len(roots)), i]), np.concatenate([roots, j]))


def one_of_each_vector(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vectors`` (vec_id, v and others) without the rows that links lead from to a smaller vec_id; of rows that share a kept
    vec_id all stay, and so do rows of a null one."""
    (own,) = unused(vectors, "vec_id")
    gone = similar_vectors(vectors.select("vec_id", "v"), threshold).filter("not kept").select(F.col("vec_id").alias(own)).distinct()
    return vectors.join(gone, F.col("vec_id") == F.col(own), "left_anti")


def op13_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))


#: All links by brute force. On tables where the tables of cells miss none of them the rows are the same.
ORACLE = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  and list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.9 * a.n * b.n),
r as (select vec_id as a, vec_id as b from u union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a)
select vec_id, (select count(*) from l where l.a = vec_id)::bigint as n_links, coalesce(c, vec_id)::bigint as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join c on c.a = vec_id
"""
