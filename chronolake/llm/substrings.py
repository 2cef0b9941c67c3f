"""Removal of repeated byte strings: bucket-pointer refinement over anchored suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, U64, batch, blobs, by_key, ints, mix, pieces, raw, salts, store, table

LENGTH = 100
#: Depth of the initial buckets.
Q = 24
#: Texts are cut in pieces of so many strings' starts; a piece holds LENGTH - 1 bytes more, so that no string is cut.
PIECE = 1 << 18
#: Buckets of more distinct contexts than this are refined across tasks.
LARGE = 2048
_M = salts(201, 16)


class Buckets:
    """Bucket identifiers of all positions of some bytes, from one depth to the next.

    The identifier at depth 2d is made of two at depth d: the position's own and that of the position d later. So each
    refinement uses the identifiers that the last one made. Identifiers are 64-bit names of the string itself: equal
    strings have equal ones in every task."""

    def __init__(self, data: np.ndarray):
        self.at = {1: BYTE[data]}

    def __getitem__(self, depth: int) -> np.ndarray:
        if depth not in self.at:
            half = 1 << (depth - 1).bit_length() - 1  # the largest power of two below
            own, later = self[half], self[depth - half if 2 * half != depth and depth < LENGTH else half]
            shift = half if 2 * half == depth or depth < LENGTH else depth - half
            n = max(0, len(self.at[1]) - depth + 1)
            with np.errstate(over="ignore"):
                x = own[:n] * _M[depth % 16] + later[shift : shift + n]
                x ^= x >> U64(29)
            self.at[depth] = x
        return self.at[depth]


def _anchors(data: np.ndarray, at: np.ndarray, deep: bool):
    """The anchored runs of each row: (row, begin, n, bucket, whole).

    Each LENGTH-byte string has one anchor: of its Q-grams the one of the smallest scrambled bucket identifier, the
    leftmost of equals. Equal strings have equal anchors at equal distance. ``begin`` and ``n`` give the consecutive
    strings that have one anchor, ``bucket`` its identifier at depth Q, ``whole`` (if ``deep``) names all that text."""
    w = LENGTH - Q + 1
    valid = np.diff(at) - LENGTH + 1
    if not (valid > 0).any():
        return None
    b = Buckets(data)
    g = b[Q]
    # the order's upper half is the scrambled identifier, the lower half the position
    o = (mix(g) & U64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U64)
    m, width = o, 1
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (w - width)], m[w - width :]) if w > width else m
    rows = np.flatnonzero(valid > 0)
    n = valid[rows]
    p = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    anchor = (m[p] & U64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    count = np.diff(np.append(begin, len(p)))
    first = p[begin]
    row = np.searchsorted(at, first, "right") - 1
    whole = None
    if deep:
        full = b[LENGTH]
        with np.errstate(over="ignore"):
            whole = mix(mix(full[first]) * U64(31) + full[first + count - 1] + (count * 131 + anchor[begin] - first).astype(U64))
    return row, first - at[row], count, g[anchor[begin]], whole


def _pieces(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, off, s): the bytes of each text from off on, in pieces that overlap; every LENGTH-byte string starts in one.

    An anchor depends on its string alone, so a run of strings may end at a piece's end; what is left of it is compared byte
    by byte with what differs, as any other run. No task holds more than a piece's identifiers, however long a text is."""
    whole = docs.select(*columns, F.col("text").cast("binary").alias("whole"), F.octet_length("text").alias("size")).filter(f"size >= {LENGTH}")
    parts = whole.select(*columns, "whole", F.explode(F.expr(f"sequence(0, (size - {LENGTH}) div {PIECE})")).alias("part"))
    off = F.col("part") * PIECE
    return parts.select(*columns, off.cast("long").alias("off"), F.substring("whole", off.cast("int") + 1, F.lit(PIECE + LENGTH - 1)).alias("s"))


def _bucket_rows(batches):
    for b in batches:
        for _, _, data, at in pieces(b.column("s"), PIECE):
            if a := _anchors(data, at, False):
                yield batch(h=a[3].view(np.int64))


def _run_rows(batches):
    for b in batches:
        ids, t, own, off = (ints(b.column(c)) for c in ("doc_id", "t", "row", "off"))
        for i, _, data, at in pieces(b.column("s"), PIECE):
            if a := _anchors(data, at, True):
                row, p, n, h, whole = a
                with np.errstate(over="ignore"):
                    _, first = np.unique(mix(whole + row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
                again = np.ones(len(row), bool)
                again[first] = False
                # a piece's own repeats are copies already; those that follow each other become one row
                begin = np.concatenate([[True], ~again[1:] | ~again[:-1] | (row[1:] != row[:-1])])
                at_ = np.flatnonzero(begin)
                yield batch(h=h[at_].view(np.int64), whole=whole[at_].view(np.int64), doc_id=ids[i + row[at_]], t=t[i + row[at_]], row=own[i + row[at_]], p=off[i + row[at_]] + p[at_], n=np.add.reduceat(n, at_), again=again[at_])


def _strings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of all LENGTH-byte strings of the rows."""
    n = np.maximum(np.diff(at) - LENGTH + 1, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _refined(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of the rows the bucket of the LENGTH bytes that start there, as far as a row has so many.

    The buckets of equal Q-grams are refined by sorting on two identifiers, the bucket's own and that of the position where
    the string seen so far ends; the buckets that this makes are the identifiers of the next round, which so sees twice as
    far. A bucket with one string left is final and keeps its identifier."""
    ids = np.unique(Buckets(data)[Q], return_inverse=True)[1]
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    depth, made = Q, int(ids.max()) + 1 if len(ids) else 0
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        live = np.flatnonzero(left >= depth + step)
        live = live[np.bincount(ids[live], minlength=made)[ids[live]] > 1]
        if len(live):
            found, new = np.unique(ids[live] * made + ids[live + step], return_inverse=True)
            ids[live] = made + new
            made += len(found)
        depth += step
    return ids


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Runs [a, b) of each doc (any numbers), overlapping and touching ones joined."""
    o = np.lexsort((a, doc))
    doc, a, b = doc[o], a[o], b[o]
    code = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    wide = int(b.max()) + 1
    far = np.maximum.accumulate(b + code * wide)
    new = np.concatenate([[True], a[1:] + code[1:] * wide > far[:-1]])
    head = np.flatnonzero(new)
    return doc[head], a[head], far[np.append(head[1:], len(a)) - 1] - code[head] * wide


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, t, a, b): byte runs [a, b) of the texts of ``docs`` (doc_id, text) covered by LENGTH-byte strings that also
    start earlier: in a smaller doc_id, or further left in the same document; t is xxhash64(text). Runs of a document may
    overlap. Rows that agree in doc_id and text are one document, given more than once; rows that agree in doc_id alone are
    documents of their own, in the order of t.

    Positions start in buckets of equal Q-grams. Only one position in about forty, the anchor of the LENGTH-byte strings
    around it, enters them, and a bucket with one member is final: no string around it repeats. What is left is refined
    by the identifiers of later offsets up to depth LENGTH. First the runs of strings around an anchor are named whole:
    of equal runs all but the earliest repeat in full, and those within one document are told apart where they are found. Then, where a bucket has several distinct runs, the earliest of
    each are refined by bucket pointers. Buckets of many distinct runs are dealt out by string, so none meets in one task. Texts are
    looked at in pieces of PIECE bytes."""
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    several = _pieces(d).select("s").mapInArrow(_bucket_rows, "h long").groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    several = store(several)
    runs = _pieces(d.withColumn("row", F.monotonically_increasing_id()), "doc_id", "t", "row").mapInArrow(_run_rows, "h long, whole long, doc_id long, t long, row long, p long, n long, again boolean")
    runs = store(runs.join(several, "h"))
    given = runs.groupBy("doc_id", "t").agg(F.min("row").alias("row"), F.max("row").alias("last"))
    if twice := bool(given.filter("row < last").take(1)):  # documents that are given more than once count once
        runs = store(runs.join(given.select("row"), "row", "left_semi"))
    end = F.col("p") + F.col("n") + LENGTH - 1
    own = runs.filter("again").select("doc_id", "t", F.col("p").alias("a"), end.alias("b"))
    runs = runs.filter("not again")
    first = store(runs.groupBy("h", "whole", "n").agg(F.min(F.struct("doc_id", "t", "p")).alias("f")))
    later = "doc_id <> f.doc_id or t <> f.t or p <> f.p"
    copies = runs.join(first, ["h", "whole", "n"]).filter(later).select("doc_id", "t", F.col("p").alias("a"), end.alias("b"))
    mixed = store(first.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"))
    left = first.join(mixed, "h").select(F.col("f.doc_id").alias("d"), F.col("f.t").alias("dt"), F.expr(f"f.p - f.p % {PIECE}").alias("of"), F.struct("h", F.col("f.p").alias("p"), "n", "c").alias("r"))
    left = left.groupBy("d", "dt", "of").agg(F.collect_list("r").alias("r"))  # at most those of a piece
    found = _pieces(d, "doc_id", "t").join(left, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("dt")) & (F.col("off") == F.col("of"))).select("doc_id", "t", "off", "s", "r")

    def contexts(batches):
        for b in batches:
            data, at = raw(b.column("s"))
            doc, t, off = (ints(b.column(c)) for c in ("doc_id", "t", "off"))
            r = b.column("r").combine_chunks() if isinstance(b.column("r"), pa.ChunkedArray) else b.column("r")
            n = np.diff(r.offsets.to_numpy())
            flat = r.flatten()
            h, p, k, c = (ints(flat.field(x)) for x in ("h", "p", "n", "c"))
            row = np.repeat(np.arange(len(n)), n)
            size = k + LENGTH - 1
            for i in range(0, len(row), 4096):
                s = slice(i, i + 4096)
                begin = at[row[s]] + p[s] - off[row[s]]
                take = np.arange(int(size[s].sum())) + np.repeat(begin - (np.cumsum(size[s]) - size[s]), size[s])
                yield batch(h=h[s], doc_id=doc[row[s]], t=t[row[s]], p=p[s], c=c[s], s=blobs(data[take], size[s]))

    found = found.mapInArrow(contexts, "h long, doc_id long, t long, p long, c long, s binary")
    found = store(found.dropDuplicates(["h", "doc_id", "t", "p"]) if twice else found)

    def compare(table_: pa.Table):
        data, at = raw(table_.column("s"))
        row, off = _strings(at)
        if not len(row):
            return
        bucket = _refined(data, at)[at[row] + off]
        doc, t, p = (ints(table_.column(c)) for c in ("doc_id", "t", "p"))
        o = np.lexsort((p[row] + off, t[row], doc[row], bucket))
        again = o[1:][bucket[o[1:]] == bucket[o[:-1]]]
        if len(again):
            r = row[again]
            # a number for each document of the table, and one of its rows
            _, some, number = np.unique(np.stack([doc, t]), axis=1, return_index=True, return_inverse=True)
            k, a, b = _merge(number.ravel()[r], p[r] + off[again], p[r] + off[again] + LENGTH)
            yield batch(doc_id=doc[some[k]], t=t[some[k]], a=a, b=b)

    small = by_key(found.filter(F.col("c") <= LARGE).select("h", "doc_id", "t", "p", "s"), "h", compare, "doc_id long, t long, a long, b long")

    def strings(batches):
        for b in batches:
            h, doc, t, p = (ints(b.column(c)) for c in ("h", "doc_id", "t", "p"))
            for i, _, data, at in pieces(b.column("s")):
                row, off = _strings(at)
                name = Buckets(data)[LENGTH][at[row] + off] if len(row) else np.zeros(0, U64)
                row = row + i
                yield batch(h=h[row], name=name.view(np.int64), doc_id=doc[row], t=t[row], p=p[row] + off)

    each = found.filter(F.col("c") > LARGE).mapInArrow(strings, "h long, name long, doc_id long, t long, p long")
    # written before they are joined, so that adaptive execution can split the join where a string is very common
    common = store(each.groupBy("h", "name").agg(F.min(F.struct("doc_id", "t", "p")).alias("f"), F.count("*").alias("c")).filter("c > 1"))
    large = each.join(common, ["h", "name"]).filter(later).select("doc_id", "t", F.col("p").alias("a"), (F.col("p") + LENGTH).alias("b"))
    return own.unionByName(copies).unionByName(small).unionByName(large)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row of ``docs`` (doc_id, text).

    The text's UTF-8 bytes, less those that a LENGTH-byte string covers which also starts earlier in the table; spans are
    the maximal removed runs as [begin, end) of the input. Strings are judged on the input and never cross documents.
    Null counts as empty; texts under LENGTH bytes lose nothing; rows that agree in doc_id and text are one document and lose
    the same; rows that agree in doc_id alone are documents of their own; rows of a null doc_id stay whole; an
    empty table gives none; other columns are ignored."""
    cut = repeats(docs).withColumn("g", F.xxhash64("doc_id", "t"))

    def joined(table_: pa.Table):
        doc, t, a, b = (ints(table_.column(x)) for x in ("doc_id", "t", "a", "b"))
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])])  # sorted so
        some = np.flatnonzero(edge)
        d, a, b = _merge(np.cumsum(edge) - 1, a, b)
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        yield batch(d=doc[some[d[head]]], dt=t[some[d[head]]], spans=blobs(np.stack([a, b], 1).ravel(), 2 * np.diff(np.append(head, len(d)))))

    cut = by_key(cut, "g", joined, "d long, dt long, spans binary", "doc_id", "t")
    r = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    r = r.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("dt")), "left").select("doc_id", "text", "spans")

    def kept(batches):
        for b in batches:
            out, size, spans = [], [], []
            for text, span in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                s = np.frombuffer(span or b"", np.int64).reshape(-1, 2)
                at = 0
                parts = []
                for x, y in s.tolist():
                    parts.append(data[at:x])
                    at = y
                out.append(b"".join([*parts, data[at:]]))
                size.append(len(data))
                spans.append(s.tolist())
            if size:
                n = np.array(size, np.int64)
                yield batch(doc_id=b.column("doc_id"), n_bytes=n, n_removed=n - np.array([len(x) for x in out], np.int64), n_spans=np.array([len(x) for x in spans], np.int64), spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))), kept=pa.array(out, pa.binary()))

    return r.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes that each document loses, and a digest of what is left."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
