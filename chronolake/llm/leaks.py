"""Benchmark decontamination by spaced seeds, with substitutions verified on the alignment."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, blobs, by_key, ints, mix, pieces, raw, store, table, unused, words

#: Words of the shortest items that are looked for.
SHORTEST = 8
LEAST, IDENTITY = 13, 0.8
#: Word positions that a seed looks at; those between are ignored. Every stretch of LEAST or more equal words that are IDENTITY
#: of it holds one of them unbroken: ``unseeded`` finds no stretch without.
MASKS = tuple((0, 1, 2, d, d + 1, d + 2) for d in (3, 6, 9, 12, 15))
#: Bytes of benchmark text that are sent to every task; a larger benchmark is joined.
SENT_BYTES = 8 << 20
#: Seed hits, and compared words, that a task holds at a time.
HITS, CELLS = 1 << 19, 1 << 22

NAMES = ("doc_id", "t", "item_id", "matched", "length", "doc_word", "item_word")
FOUND = ", ".join(f"{x} long" for x in NAMES)


def unseeded(masks: tuple, least: int, share: Fraction) -> int | None:
    """The length of a shortest stretch with ``least`` equal words that are ``share`` of it in which no mask finds its words
    equal; None if there is none. Looks at all stretches by their last words, and for each at the highest sum of
    q - p for an equal word and -p for another. A sum that only ``least`` equal words bring back to 0 can be left out, since
    these are in a stretch by themselves."""
    p, q = share.numerator, share.denominator
    n = 1 << max(m[-1] for m in masks)
    last = np.arange(n)
    free = np.ones(n, bool)  # an equal word may follow without a hit
    for m in masks:
        bits = sum(1 << (m[-1] - k - 1) for k in m[:-1])
        free &= (last & bits) != bits
    low = -(10**9)
    sums = np.full((least + 1, n), low)
    sums[0, 0] = 0
    half = n // 2
    for length in range(1, 64 * least):
        other = np.maximum(sums[:, :half], sums[:, half:]) - p
        equal = np.where(free, sums, low)
        equal = np.maximum(equal[:, :half], equal[:, half:]) + q - p
        sums = np.full((least + 1, n), low)
        sums[:, ::2] = other
        sums[1:, 1::2] = equal[:-1]
        sums[least, 1::2] = np.maximum(sums[least, 1::2], equal[least])
        sums[sums <= -least * (q - p)] = low
        if (sums[least] >= 0).any():
            return length
        if (sums == low).all():
            return None
    return length


def _masks(least: int, share: Fraction) -> tuple:
    """MASKS where they miss nothing; else as many consecutive words as every stretch to be reported has: n equal words have at
    most n * (1 - share) / share others among them, which part them into runs, and the longest has at least the mean."""
    if least >= LEAST and share >= Fraction(IDENTITY).limit_denominator(10**6):
        return MASKS
    other = (1 - share) / max(share, Fraction(1, 10**6))
    return (tuple(range(min(SHORTEST, *(-(-n // (int(n * other) + 1)) for n in range(max(least, 1), max(least, 1) + 1000))))),)


def _seeds(h: np.ndarray, first: np.ndarray, masks: tuple, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, their first words) under each mask, where all its words lie in one row (and are ``known``)."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    for k, m in enumerate(masks):
        pos = np.flatnonzero(left > m[-1] if known is None else known & (left > m[-1]))
        for j in m[1:] if known is not None else ():
            pos = pos[known[pos + j]]
        x = np.full(len(pos), k + 1, U64)
        with np.errstate(over="ignore"):
            for j in m:
                x = mix(x * U64(0x100000001B3) + h[pos + j])
        yield x, pos


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row) of the words of all texts."""
    hs, n = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for _, _, data, at in pieces(texts):
        h, _, _, first = words(data, at)
        hs.append(h)
        n.append(np.diff(first))
    return np.concatenate(hs), np.cumsum(np.concatenate(n))


class Index:
    """Seeds of the benchmark items that are sent to every task."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple):
        self.ids, self.masks = ids, masks
        self.h, self.first = _texts(pa.array(texts, pa.large_string()))
        n = np.diff(self.first)
        self.item = np.repeat(np.arange(len(n)), n)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.h & U64((1 << 22) - 1)).astype(np.int64)] = True
        self.seeds = []
        for x, pos in _seeds(self.h, self.first, masks):
            pos = pos[long := n[self.item[pos]] >= SHORTEST]
            o = np.argsort(x[long], kind="stable")
            self.seeds.append((x[long][o], pos[o].astype(np.int32)))

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word of the rows, word of the benchmark) where a seed of both agrees, for one stretch of words after the other."""
        known = self.bits[(h & U64((1 << 22) - 1)).astype(np.int64)]
        parts = []
        for (x, pos), (seeds, at) in zip(_seeds(h, first, self.masks, known), self.seeds, strict=True):
            lo = np.searchsorted(seeds, x, "left")
            n = np.searchsorted(seeds, x, "right") - lo
            hit = n > 0
            parts.append((pos[hit], lo[hit], n[hit], at))
        total = np.zeros(len(h) + 1, np.int64)
        for pos, _, n, _ in parts:
            total[pos + 1] += n
        total = np.cumsum(total)
        begin = 0
        while total[-1] > total[begin]:
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS, "right")) - 1)
            xs, ys = [], []
            for pos, lo, n, at in parts:
                s = slice(*np.searchsorted(pos, [begin, end]))
                k = n[s]
                xs.append(np.repeat(pos[s], k))
                ys.append(at[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[s], k)])
            if sum(map(len, xs)):
                yield np.concatenate(xs), np.concatenate(ys).astype(np.int64)
            begin = end


def _verify(eq: np.ndarray, least: int, share: Fraction) -> tuple[int, int, int] | None:
    """The stretch of aligned words with the most equal words, of these the shortest and then the first, among all that
    have ``least`` of them and of which they are ``share``: (matches, begin, end); None if there is none.

    With whole numbers q * equal - p * words a stretch has its share if the sum doesn't fall from its begin to its end, so
    from each begin the last end that isn't lower has the most equal words."""
    at = np.flatnonzero(eq)
    if len(at) < max(least, 1):
        return None
    p, q = share.numerator, share.denominator
    n = np.arange(len(at))
    before = q * n - p * at  # sums at the begin of each equal word, and after it
    after = before + q - p
    highest = np.maximum.accumulate(after[::-1])[::-1]
    last = np.searchsorted(-highest, -before, "right") - 1
    found = last - n + 1
    most = int(found.max())
    if most < least:
        return None
    begin = at[found == most]
    end = at[last[found == most]] + 1
    k = int(np.argmin(end - begin))
    return most, int(begin[k]), int(end[k])


def _equal(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, equal, at): whether the n[k] words from x[k] of ``a`` on agree with those from y[k] of ``b`` on, for k from i to j."""
    i, total = 0, np.concatenate([[0], np.cumsum(n)])
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CELLS, "right")) - 1)
        at = total[i : j + 1] - total[i]
        k = np.arange(at[-1]) - np.repeat(at[:-1], n[i:j])
        yield i, j, a[k + np.repeat(x[i:j], n[i:j])] == b[k + np.repeat(y[i:j], n[i:j])], at
        i = j


def _stretches(index: Index, h: np.ndarray, first: np.ndarray, least: int, share: Fraction) -> dict[tuple[int, int], tuple]:
    """For (row, item_id) the best stretch: (matches, -length, -word of the row, -word of the item)."""
    best: dict[tuple[int, int], tuple] = {}
    wide = len(h) + len(index.h) + 1
    for x, y in index.hits(h, first):
        row = np.searchsorted(first, x, "right") - 1
        # an alignment: a row, an item, and the distance of their words; seeds of one alignment meet here
        key = np.unique((row * len(index.ids) + index.item[y]) * wide + (x - y + len(index.h)))
        shift = key % wide - len(index.h)
        row, item = np.divmod(key // wide, len(index.ids))
        lo = np.maximum(first[row], index.first[item] + shift)
        n = np.minimum(first[row + 1], index.first[item + 1] + shift) - lo
        size = index.first[item + 1] - index.first[item]
        for i, j, eq, at in _equal(h, lo, index.h, lo - shift, n):
            equal = np.add.reduceat(eq, at[:-1], dtype=np.int64)
            for k in (np.flatnonzero(equal >= np.minimum(least, size[i:j]))).tolist():
                r, m = int(row[i + k]), int(item[i + k])
                got = best.get((r, index.ids[m]), (0, 0))
                if equal[k] < got[0] or (equal[k] == got[0] and got[0] == -got[1] and got[4] == m):
                    continue  # no more equal words, and those found lie closest and come first
                if s := _verify(eq[at[k] : at[k + 1]], min(least, int(size[i + k])), share):
                    begin = int(lo[i + k]) + s[1]
                    new = (s[0], s[1] - s[2], int(first[r]) - begin, int(index.first[m]) + int(shift[i + k]) - begin, m)
                    best[r, index.ids[m]] = max(got, new)
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, item_id, matched, length, doc_word, item_word): the stretch of most equal words that a document of ``docs``
    (doc_id, text) shares with an item of ``benchmark`` (item_id, text), position by position, with substituted words allowed.

    A pair is reported if, on one alignment, a stretch has at least ``least`` equal words (or all words of an item that
    has fewer, but at least SHORTEST) and they are ``identity`` of the stretch. Alignments are found by spaced seeds: words at
    the positions of a mask, hashed on both sides; what lies between may differ. Every stretch to be reported has a seed, so
    none is missed (`_masks`); items of fewer than SHORTEST words are never reported. Up to SENT_BYTES of benchmark text travel to the
    documents, which then aren't shuffled; seeds of a larger one are joined. Of stretches with equally many equal words the
    shortest counts, then the first. Null and empty texts overlap nothing; rows of null ids are ignored; equal document rows
    give equal results, once each; texts under one item_id are one item, of which the best overlap counts; documents of one
    doc_id are told apart by their texts; other columns are ignored; empty tables give none."""
    return _found(docs, benchmark, least, identity).drop("t")


def _found(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """``overlaps`` and t, the hash of the document's text."""
    share = Fraction(identity).limit_denominator(10**6)
    b = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    if (b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > SENT_BYTES:
        return _joined(d, b, least, share)
    own = b.orderBy("item_id", "text").collect()  # SENT_BYTES at most
    sent = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in own], [r.text for r in own]))
    masks = _masks(least, share)
    made: list[Index] = []

    def find(batches):
        if not made:
            made.append(Index(*sent.value, masks))
        for b in batches:
            doc, t = ints(b.column("doc_id")), ints(b.column("t"))
            for i, _, data, at in pieces(b.column("text")):
                h, _, _, first = words(data, at)
                best = _stretches(made[0], h, first, least, share)
                if best:
                    out = [(int(doc[i + r]), int(t[i + r]), item, s[0], -s[1], -s[2], -s[3]) for (r, item), s in best.items()]
                    yield batch(**dict(zip(NAMES, zip(*out, strict=True), strict=True)))

    return d.mapInArrow(find, FOUND)


def _joined(docs: DataFrame, items: DataFrame, least: int, share: Fraction) -> DataFrame:
    """``overlaps`` for a benchmark of any size: seeds of both sides are joined, then for each alignment the document's words
    beside the item, never a whole text, meet the item's words."""
    masks = _masks(least, share)

    def seeds(shortest, *names):
        def run(batches):
            for b in batches:
                ids = [ints(b.column(c)) for c in names]
                for i, _, data, at in pieces(b.column("text"), 1 << 18):
                    h, _, _, first = words(data, at)
                    for x, pos in _seeds(h, first, masks):
                        row = np.searchsorted(first, pos, "right") - 1
                        ok = np.diff(first)[row] >= shortest
                        row, pos, x = row[ok], pos[ok], x[ok]
                        yield batch(seed=x.view(np.int64), **{c: v[i + row] for c, v in zip(names, ids, strict=True)}, at=pos - first[row])

        return run

    # texts under one id are told apart by their hashes; equal rows are one here
    items = items.withColumn("u", F.xxhash64("text"))
    theirs = store(items.mapInArrow(seeds(SHORTEST, "item_id", "u"), "seed long, item_id long, u long, at long").withColumnRenamed("at", "y"))
    own = docs.mapInArrow(seeds(1, "doc_id", "t"), "seed long, doc_id long, t long, at long")
    hits = store(own.join(theirs, "seed").select("doc_id", "t", "item_id", "u", (F.col("at") - F.col("y")).alias("shift")).distinct())

    def hashed(batches):
        for b in batches:
            h, first = _texts(b.column("text"))
            yield batch(item_id=b.column("item_id"), u=b.column("u"), size=np.diff(first), item=blobs(h, np.diff(first)))

    item = store(items.mapInArrow(hashed, "item_id long, u long, size long, item binary"))
    hits = hits.join(item.select("item_id", "u", "size"), ["item_id", "u"])
    hit_ids = hits.select("doc_id", "t").distinct()
    texts = docs.join(hit_ids, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    none = F.lit(None).cast("long")
    both = texts.select("doc_id", "t", "text", *(none.alias(c) for c in ("item_id", "u", "shift", "size")))
    both = both.unionByName(hits.select("doc_id", "t", F.lit(None).cast("string").alias("text"), "item_id", "u", "shift", "size"))
    both = both.withColumn("g", F.xxhash64("doc_id", "t")).withColumn("hit", F.col("item_id").isNotNull())

    def windows(t: pa.Table):
        is_hit = ints(t.column("hit")).astype(bool)
        doc, name = (ints(t.column(c)) for c in ("doc_id", "t"))
        text_rows = np.flatnonzero(~is_hit)
        h, first = _texts(t.column("text").take(pa.array(text_rows)).combine_chunks())
        rows = np.flatnonzero(is_hit)
        k = np.cumsum(~is_hit)[rows] - 1  # a text comes before its hits
        item_id, u, shift, size = (ints(t.column(c).take(pa.array(rows))) for c in ("item_id", "u", "shift", "size"))
        lo = np.maximum(shift, 0)
        n = np.minimum(np.diff(first)[k], shift + size) - lo
        for i in range(0, len(rows), 1024):
            s = slice(i, i + 1024)
            m = n[s]
            take = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[k[s]] + lo[s], m)
            yield batch(doc_id=doc[rows[s]], t=name[rows[s]], item_id=item_id[s], u=u[s], shift=shift[s], lo=lo[s], own=blobs(h[take], m))

    met = by_key(both, "g", windows, "doc_id long, t long, item_id long, u long, shift long, lo long, own binary", "doc_id", "t", "hit")
    met = met.join(item, ["item_id", "u"])

    def verify(batches):
        for b in batches:
            doc, t, item_id, shift, lo = (ints(b.column(c)) for c in ("doc_id", "t", "item_id", "shift", "lo"))
            (a, x), (c, y) = (raw(b.column(k)) for k in ("own", "item"))
            a, c, n = a.view(U64), c.view(U64), np.diff(x) // 8
            size = np.diff(y) // 8
            out = []
            for i, j, eq, at in _equal(a, x[:-1] // 8, c, y[:-1] // 8 + lo - shift, n):
                for k in range(j - i):
                    if s := _verify(eq[at[k] : at[k + 1]], min(least, int(size[i + k])), share):
                        word = int(lo[i + k]) + s[1]
                        out.append((int(doc[i + k]), int(t[i + k]), int(item_id[i + k]), s[0], s[2] - s[1], word, word - int(shift[i + k])))
            if out:
                yield batch(**dict(zip(NAMES, zip(*out, strict=True), strict=True)))

    found = met.mapInArrow(verify, FOUND)
    best = F.min(F.struct((-F.col("matched")).alias("matched"), "length", "doc_word", "item_word")).alias("s")
    found = found.groupBy("doc_id", "t", "item_id").agg(best)
    return docs.select("doc_id", "t").join(found, ["doc_id", "t"]).select("doc_id", "t", "item_id", (-F.col("s.matched")).alias("matched"), "s.length", "s.doc_word", "s.item_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap a benchmark item."""
    d, t = unused(docs, "d", "t")
    gone = _found(docs, benchmark).select(F.col("doc_id").alias(d), F.col("t").alias(t)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with the benchmark."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
