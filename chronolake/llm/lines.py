"""Removal of repeated line runs: prefix doubling over line sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SOLID, U64, batch, by_key, ints, mix, pieces, store, table, unused, words

LEAST_WORDS = 50
#: Lines of one document that a task looks at together, besides those that a stretch reaches on either side.
TOGETHER = 8192


def _lines(batches):
    """The non-blank lines of each text: number among all its lines and among the non-blank ones, 128-bit hash, words."""
    for b in batches:
        doc, t, row_ = (ints(b.column(c)) for c in ("doc_id", "t", "row"))
        for i, _, data, at in pieces(b.column("text")):
            h, start, _, first = words(data, at, SOLID_CASED)
            if not len(h):
                continue
            breaks = np.flatnonzero(data == 10)
            line = np.searchsorted(breaks, start)  # line breaks before each word
            row = np.repeat(np.arange(len(at) - 1), np.diff(first))
            begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
            count = np.diff(np.append(begin, len(h)))
            with np.errstate(over="ignore"):
                pos = (np.arange(len(h)) - np.repeat(begin, count)).astype(U64)
                key = np.add.reduceat(mix(h + pos * U64(0x9E3779B97F4A7C15)), begin)
                key2 = np.add.reduceat(mix((h ^ U64(0xA5A5A5A5A5A5A5A5)) * U64(0xC2B2AE3D27D4EB4F) + pos), begin)
            of = row[begin]
            own = line[begin] - np.searchsorted(breaks, at[of])
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            yield batch(doc_id=doc[i + of], t=t[i + of], row=row_[i + of], i=own.astype(np.int32), seq=nth.astype(np.int32), h=key.view(np.int64), h2=key2.view(np.int64), w=count)


#: Words of a line: white space separates, case counts.
SOLID_CASED = np.where(SOLID == 0, 0, np.arange(256)).astype(np.uint8)
SOLID_CASED[0] = 1


def repeated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, t, gone: array of line numbers from 0) of the documents of ``docs`` (doc_id, text) that hold later copies; t is
    xxhash64(text).

    Lines are what line breaks separate; blank lines count for nothing, and lines are equal if their words are
    ([^\\x20\\x09-\\x0D]+, case kept). A run of successive non-blank lines is a later copy if it also starts earlier: at
    a smaller doc_id, or higher up in the same document. Later copies of maximal runs of ``least_words`` words or more go.
    Rows that agree in doc_id and text are one document, given more than once: all get its result. Rows that agree in doc_id
    alone are documents of their own, in the order of t.

    Each line starts a suffix of its document's line sequence. Doubling gives the suffixes ranks that agree if their
    first 1, 2, 4, ... lines agree: a rank is the earliest suffix of its class, an interval of the suffix array whose
    common prefix is at least so long. Suffixes alone in their class leave at once: no longer prefix of theirs repeats. A
    class keeps only its earliest member and no class is gathered, so common lines don't land in one task. A maximal run of
    enough words is the union of its stretches that just reach ``least_words`` from their first line on or from their
    last line back; each is named by the ranks of two overlapping prefixes, an interval of its own, and is a copy unless it
    is the first there. Null and empty texts have no lines; rows of a null doc_id are left alone."""
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"))
    lines = store(d.mapInArrow(_lines, "doc_id long, t long, row long, i int, seq int, h long, h2 long, w long"))
    given = lines.filter("seq = 0").groupBy("doc_id", "t").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    if given.filter("n > 1").take(1):  # documents that are given more than once count once
        lines = store(lines.join(given.select("row"), "row", "left_semi"))
    first = F.min(F.struct("doc_id", "t", "row", "seq")).alias("f")

    def ranked(t: DataFrame, *names: str) -> DataFrame:
        """Rows of names that occur more than once, with their rank (fr, fi): row and line of the earliest."""
        # written before it is joined, so that adaptive execution can split the join where a name is very common
        c = store(t.groupBy(*names).agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"))
        return t.join(c, [*names]).select("doc_id", "t", "row", "seq", "w", F.col("f.row").alias("fr"), F.col("f.seq").alias("fi"))

    level = store(ranked(lines, "h", "h2"))
    levels, k = [level.withColumn("k", F.lit(0))], 0
    while 2**k < least_words:
        step = 2**k
        later = Window.partitionBy("row").orderBy("seq").rangeBetween(step, step)
        nxt = level.select("*", F.first("fr").over(later).alias("gr"), F.first("fi").over(later).alias("gi"))
        level = store(ranked(nxt.filter("gr is not null"), "fr", "fi", "gr", "gi"))
        k += 1
        if not level.take(1):
            break
        levels.append(level.withColumn("k", F.lit(k)))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    # long documents in parts, with the lines on either side that a stretch may reach
    part = F.explode(F.sequence(F.expr(f"greatest(seq - {least_words}, 0) div {TOGETHER}"), F.expr(f"(seq + {least_words}) div {TOGETHER}")))
    ranks = ranks.select("*", part.alias("part")).withColumn("g", F.xxhash64("row", "part"))

    def stretches(table_: pa.Table):
        row, part, seq, w, lv = (ints(table_.column(c)) for c in ("row", "part", "seq", "w", "k"))
        o = np.lexsort((seq, part, row, lv))
        row, part, seq, w, lv = row[o], part[o], seq[o].astype(np.int64), w[o].astype(np.int64), lv[o]
        n = int(np.searchsorted(lv, 1))  # entries of level 0: all lines that occur twice
        new = np.concatenate([[True], (row[1:n] != row[: n - 1]) | (part[1:n] != part[: n - 1])]) if n else np.zeros(0, bool)
        code = np.cumsum(new) - 1
        own = {x: k for k, x in enumerate(zip(row[:n][new].tolist(), part[:n][new].tolist(), strict=True))}
        wide = int(seq.max()) + 1 if n else 1
        key0 = code * wide + seq[:n]
        at = {0: np.arange(n)}  # entry of each line's rank at each level, -1 if it has none
        for j in range(1, int(lv.max()) + 1 if n else 0):
            a, b = np.searchsorted(lv, j), np.searchsorted(lv, j + 1)
            at[j] = np.full(n, -1)
            if b > a:
                new = np.concatenate([[True], (row[a + 1 : b] != row[a : b - 1]) | (part[a + 1 : b] != part[a : b - 1])])
                codes = np.array([own[x] for x in zip(row[a:b][new].tolist(), part[a:b][new].tolist(), strict=True)])
                at[j][np.searchsorted(key0, codes[np.cumsum(new) - 1] * wide + seq[a:b])] = np.arange(a, b)
        island = np.cumsum(np.concatenate([[1], (key0[1:] != key0[:-1] + 1) | (code[1:] != code[:-1])])) if n else key0
        stop = np.searchsorted(island, island, "right")  # end of the unbroken lines
        begin = np.searchsorted(island, island, "left")
        total = np.concatenate([[0], np.cumsum(w[:n])])
        x = np.arange(n)
        fore = np.searchsorted(total, total[:-1] + least_words)  # the stretch from x is x .. fore - 1
        back = np.searchsorted(total, total[1:] - least_words, "right") - 1  # the stretch up to x is back .. x
        a = np.concatenate([x, back])
        b = np.concatenate([fore, x + 1])
        ok = np.concatenate([fore <= stop, (back >= begin) & (total[1:] - total[np.maximum(back, 0)] >= least_words)])
        a, b = a[ok], b[ok]
        here = seq[a] // TOGETHER == part[a]  # the other parts' lines only complete stretches of this one
        a, b = a[here], b[here]
        a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
        size = b - a
        j = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        p, q = np.full(len(a), -1), np.full(len(a), -1)
        for lvl, entry in at.items():
            m = j == lvl
            p[m], q[m] = entry[a[m]], entry[b[m] - 2**lvl]
        m = (p >= 0) & (q >= 0)
        a, size, p, q = a[m], size[m], o[p[m]], o[q[m]]
        fr, fi, doc, t = (ints(table_.column(c)) for c in ("fr", "fi", "doc_id", "t"))
        yield batch(doc_id=doc[o[a]], t=t[o[a]], row=row[a], seq=seq[a].astype(np.int32), size=size.astype(np.int32), ar=fr[p], ai=fi[p], br=fr[q], bi=fi[q])

    s = store(by_key(ranks, "g", stretches, "doc_id long, t long, row long, seq int, size int, ar long, ai int, br long, bi int"))
    name = ["size", "ar", "ai", "br", "bi"]
    c = store(s.groupBy(*name).agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = s.join(c, name).filter("row <> f.row or seq <> f.seq").select("row", "seq", "size")
    cover = later.select("row", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("size") - 1)).alias("seq")).distinct()
    return lines.join(cover, ["row", "seq"]).groupBy("doc_id", "t").agg(F.collect_list("i").alias("gone"))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and the count of cut lines as ``n_removed``.

    Other lines stay as they are, blank ones included; a text may become empty, null stays null. A column of that name
    is replaced."""
    of, t, gone, n = unused(docs, "of", "t", "gone", "n")

    def marked(batches):
        """A byte for each line up to the last that goes, 1 where it goes: found by its place, however many they are."""
        for b in batches:
            lists = b.column("gone")
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            marks = [np.bincount(flat[i:j]).astype(np.uint8).tobytes() for i, j in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
            yield batch(doc_id=b.column("doc_id"), t=b.column("t"), gone=pa.array(marks, pa.binary()), n=np.diff(at).astype(np.int64))

    cut = repeated(docs, least_words).mapInArrow(marked, "doc_id long, t long, gone binary, n long")
    cut = cut.select(F.col("doc_id").alias(of), F.col("t").alias(t), F.col("gone").alias(gone), F.col("n").alias(n))
    r = docs.join(cut, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(t)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.substring(gone, i + 1, F.lit(1)) != F.lit(b"\1")), "\n")
    r = r.withColumn("n_removed", F.coalesce(n, F.lit(0)).cast("long"))
    return r.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).drop(of, t, gone, n)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines that each document has and loses, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
