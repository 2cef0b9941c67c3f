"""Groups of vectors that are too large for a task, cut in tiles that meet in pairs; and connected components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a group, or of a cell, that a task takes at once.
BLOCK = 4096
#: Pivots of a group, and about how many tiles it is cut in, at most; but in more where they would have more rows than LARGEST.
TILES, LARGEST = 16, 1 << 16
#: Products that are held at once.
CELLS = 1 << 22


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: its lineage ends there. Only a local session without such a folder gets one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or os.path.join(tempfile.gettempdir(), "chronolake-shared"))
    return df.checkpoint()


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as rows."""
    flat = col.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v.copy(), where=n > 0)


def _assigned(eps: float):
    """Each row of a block with the cell of its nearest pivot, and as ``halo`` all other cells that a row within ``eps`` can be in: a
    row of such a cell is beyond the plane halfway between both pivots, and so at least as far away as the plane."""

    def run(t: pa.Table) -> pa.Table:
        pivot = t.column("pivot").to_numpy()
        rows, at = np.flatnonzero(~pivot), np.flatnonzero(pivot)
        x = unit_vectors(matrix(t.column("v")))
        p = x[at]
        p = p[np.lexsort(p.T[::-1])]  # the same order in every block
        p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])] if len(p) else p
        x = x[rows]
        between = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 0))
        away = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T
        own = away.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (away - away[np.arange(len(x)), own][:, None]) / (2 * between[own])
        plane[np.arange(len(x)), own] = np.inf
        near = plane <= eps + 1e-6
        halo = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]), pa.int32()), pa.array(np.nonzero(near)[1], pa.int32()))
        out = t.select(["grp", "rid", "ts", "id", "v"]).take(pa.array(rows))
        return out.append_column("cell", pa.array(own, pa.int32())).append_column("halo", halo)

    return run


def tiles(rows: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    """``rows`` (grp, rid, ts, id, v), each with its tile ``blk`` and the tiles that it ``meets``, so that in ``meeting`` two of a group
    within ``eps`` of each other meet once, in a group (grp, a, b).

    A group's cells are those of pivots, chosen by hash; a row lies in its nearest pivot's cell, and a cell of many rows is cut in
    tiles by hash. A tile meets itself (a = b), the others of its cell, and those of cells in its rows' halos: there go only the rows
    whose halo has the other's cell (``two``). Rows that differ little meet few tiles; rows without any structure meet all.
    Tiles have ``block`` rows, but a group is cut in no more than about TILES of them until they would exceed LARGEST rows: so what
    is shuffled grows with the rows, and no task takes more than two tiles. ``alone`` marks rows that meet their own tile only."""
    size = F.count("*")
    n = rows.groupBy("grp").agg(F.least(F.ceil(size / block), F.greatest(F.lit(TILES), F.ceil(size / LARGEST))).cast("int").alias("nb"), size.alias("n"))
    n = written(n)
    t = rows.join(F.broadcast(n.withColumn("np", F.least(F.lit(TILES), F.col("nb")))), "grp")  # a row for each large group
    first = Window.partitionBy("grp").orderBy(F.xxhash64("rid", F.lit(7)))
    pivots = t.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= F.col("np")).filter(F.col("_r") <= TILES)
    pivots = pivots.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("pivot", F.lit(True))
    own = t.withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).withColumn("pivot", F.lit(False))
    names = ("grp", "blk", "pivot", "rid", "ts", "id", "v")
    schema = f"grp long, rid long, ts long, id string, v {rows.schema['v'].dataType.simpleString()}, cell int, halo array<int>"
    put = written(own.select(*names).unionByName(pivots.select(*names)).groupBy("grp", "blk").applyInArrow(_assigned(eps), schema))
    c = put.groupBy("grp", "cell").agg(F.count("*").alias("m")).join(n, "grp").select("grp", "cell", F.ceil(F.col("m") * F.col("nb") / F.col("n")).cast("int").alias("parts"))
    c = written(c.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("cell", "parts"))).alias("parts")))  # TILES entries at most, or so
    put = put.join(F.broadcast(c), "grp").withColumn("halo", F.filter("halo", lambda x: F.col("parts")[x].isNotNull()))
    tile = lambda cell, part: cell.cast("long") * (1 << 20) + part
    put = put.withColumn("blk", tile(F.col("cell"), F.pmod(F.xxhash64("rid", F.lit(3)), F.col("parts")[F.col("cell")])))
    put = put.withColumn("alone", (F.size("halo") == 0) & (F.col("parts")[F.col("cell")] == 1))
    meets = F.flatten(F.transform(F.concat(F.array("cell"), "halo"), lambda x: F.transform(F.sequence(F.lit(0), F.col("parts")[x] - 1), lambda i: tile(x, i))))
    return put.select("grp", "blk", meets.alias("meets"), "alone", "rid", "ts", "id", "v")


def meeting(rows: DataFrame) -> DataFrame:
    """``rows`` of ``tiles``, which may be fewer and have more columns, once for each pair of tiles (a, b) that they meet in."""
    put = rows.withColumn("other", F.explode("meets")).drop("meets")
    return put.withColumns({"a": F.least("blk", "other"), "b": F.greatest("blk", "other"), "two": F.col("blk") != F.col("other")}).drop("other")


def cells(rows: DataFrame, eps: float, block: int = BLOCK) -> DataFrame:
    return meeting(tiles(rows, eps, block))


GROUP = ("grp", "a", "b")


def met_rows(blk: np.ndarray, two: bool, live: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a group of ``cells`` are compared with which: some rows, and all they meet. Those of one tile with those of the
    other, if ``two``; else all with all. Few enough at a time for CELLS products."""
    all_rows = np.arange(len(blk))
    mine, theirs = (np.flatnonzero(blk == blk.min()), np.flatnonzero(blk != blk.min())) if two else (all_rows, all_rows)
    step = max(1, CELLS // max(1, len(theirs)))
    for i in range(0, len(mine), step):
        yield mine[i : i + step], theirs


def near_rows(x: np.ndarray, eps: float, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which of the rows ``theirs`` are within ``eps`` of each of ``mine``. A row is near itself."""
    square = (x * x).sum(1)
    return square[mine, None] + square[None, theirs] - 2 * x[mine] @ x[theirs].T <= eps * eps + 1e-9


def join_roots(root: np.ndarray, mine: np.ndarray, theirs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``root`` (for each row a row of its component, the smallest in the end) after the links ``m`` of ``mine`` with ``theirs``."""
    while True:
        i, j = np.nonzero(m & (root[mine][:, None] != root[theirs][None]))
        if not len(i):
            return root
        a, b = root[mine[i]], root[theirs[j]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v): label is the smallest node of the connected component.

    In each round every node learns the smallest label among its neighbours' and then that label's own, so paths halve;
    both are shuffles with partial aggregation, and nothing is gathered anywhere."""
    e = edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    e = written(e)
    label = written(e.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        seen = e.join(label.withColumnsRenamed({"node": "v", "label": "at_v"}), "v").groupBy("u").agg(F.min("at_v").alias("low"))
        new = label.join(seen, F.col("node") == F.col("u")).select("node", F.least("label", "low").alias("next"), F.col("label").alias("old"))
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        new = written(new.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), "old"))
        if not new.filter("label <> old").take(1):
            return new.select("node", "label")
        label = new.select("node", "label")
