"""What the operators share: tables kept between stages, and whole Arrow batches of text seen as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "doc_id long, text string"
U64 = np.uint64
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "chronolake-shared")
    return path.rstrip("/")


_lock = threading.Lock()
_writing, _before = 0, None
_own: ContextVar[list[str] | None] = ContextVar("own", default=None)


@contextmanager
def _cleaned(spark: SparkSession):
    """While any table is written, shuffle files are given up as soon as their query is done."""
    global _writing, _before
    with _lock:
        _writing += 1
        if _writing == 1:
            _before = spark.conf.get(CLEAN, None)
            try:
                spark.conf.set(CLEAN, "true")
            except Exception as e:  # an older Spark has no such setting; the files then stay until the garbage is collected
                if "CANNOT_MODIFY" not in str(e):
                    _writing -= 1
                    raise
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing and _before is None:
                spark.conf.unset(CLEAN)
            elif not _writing:
                spark.conf.set(CLEAN, _before)


def store(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor costs
    nothing that was finished. The shuffle files behind it are given up once it is written, the table itself when the
    application ends, or earlier by ``temporary`` and ``clear``. ``by``: columns that name folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    with _cleaned(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    fs, file = _file(spark, path)
    fs.deleteOnExit(file)
    if (own := _own.get()) is not None:
        own.append(path)
    return spark.read.schema(schema).parquet(path)


def _file(spark: SparkSession, path: str):
    sc = spark.sparkContext
    file = sc._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(sc._jsc.hadoopConfiguration()), file


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables."""
    for path in paths:
        fs, file = _file(spark, path)
        fs.delete(file, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """What is stored within goes at the end, but for paths that are taken off the list."""
    own: list[str] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)
        remove(spark, own)


def clear(spark: SparkSession) -> None:
    """Delete what ``store`` has written for this application; results that weren't written elsewhere are lost with it."""
    fs, files = _file(spark, f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}-*")
    for f in fs.globStatus(files) or ():
        fs.delete(f.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them that no column of ``df`` begins so."""
    free = "_" * (1 + max([0, *(len(c) - len(c.lstrip("_")) for c in df.columns)]))
    return [free + n for n in names]


def by_key(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """``fn`` over tables that hold whole groups of ``key`` (never null), many groups to a table."""

    def run(batches):
        hold: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            if not cut and hold and hold[-1].column(key)[-1].as_py() != k[0]:
                yield from fn(pa.Table.from_batches(hold))
                hold = [b]
            elif cut:
                yield from fn(pa.Table.from_batches([*hold, b.slice(0, cut)]))
                hold = [b.slice(cut)]
            else:
                hold.append(b)
        if hold:
            yield from fn(pa.Table.from_batches(hold))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ints(col) -> np.ndarray:
    """A column of whole numbers without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col.to_numpy(zero_copy_only=False)


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and where each row begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def pieces(col, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of a text column with their bytes and starts; at most ``most`` bytes a piece, but never less than a whole row."""
    data, at = raw(col)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salts(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE = salts(11, 256)


def folding(keep: Callable[[int], bool]) -> np.ndarray:
    """For each byte what it counts as in a word, A-Z as a-z; 0 where it separates words."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if keep(b):
            t[b] = b + 32 if 65 <= b <= 90 else b
    return t


#: Letters, digits, underscore and everything outside ASCII.
WORDS = folding(lambda b: b >= 128 or chr(b).isalnum() or b == 95)
#: Everything but white space, as the contracts say: [^\x20\x09-\x0D]+
SOLID = folding(lambda b: b != 32 and not 9 <= b <= 13)
SOLID[0] = 1  # NUL is no white space; it shares its code with byte 1


def words(data: np.ndarray, at: np.ndarray, fold: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of the words of all rows: 64-bit hashes, byte positions, and first[i]: the first word of row i."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(at), np.int64)
    b = fold[data]
    w = b != 0
    edge = at[(at > 0) & (at < len(data))]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    before[edge] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[edge - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    if not len(start):
        return np.zeros(0, U64), start, end, np.zeros(len(at), np.int64)
    size = end - start
    own = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(int(size.max()) - 1, 0xD6E8FEB86659FD93, U64)]))
        h = np.add.reduceat(BYTE[b[w]] * power[np.arange(int(size.sum())) - np.repeat(own, size)], own)
        return mix(h), start, end, np.searchsorted(start, at)


def batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array | pa.ChunkedArray) else pa.array(v) for k, v in cols.items()})


def blobs(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes from numbers laid end to end, sizes[i] numbers in row i."""
    off = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``edges`` (u, v): the label is the smallest node of the connected component.

    Alternating large-star and small-star steps: each moves edges to the smallest neighbour, no node's neighbours are
    ever gathered, and the number of edges never grows. Minima are written before they are joined: a join of two plain
    shuffles is one that adaptive execution can split where a node has very many edges."""
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = store(e)
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = store(e)
        low = store(e.groupBy("u").agg(F.min("v").alias("m")))
        # an edge (u, v) with v > m becomes (v, m); the edge (u, m) stays since m is itself one of u's neighbours
        e = store(e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none both down and up: then all edges lead to the labels."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").take(1)
