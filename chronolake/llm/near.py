"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, blobs, by_key, components, ints, mix, pieces, raw, salts, store, table, unused, words

N_HASHES, ROWS, STEP = 96, 4, 8
#: In all steps together a pair at similarity 0.8 is dropped with probability 1.2e-6, less than bands miss.
TOLERANCE = 1e-7
#: Rows, and shingles, of about so many texts of one bucket meet in a task with as many others.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
SHINGLE = 5
BANDS = N_HASHES // ROWS
_A = (salts(101, N_HASHES) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (salts(102, N_HASHES) >> U64(32)).astype(np.uint32)
_C = salts(103, SHINGLE)


def shingles(h: np.ndarray, first: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each row) of ``n`` consecutive words; a row of fewer words has one shingle of them all."""
    if not len(h):
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    i = np.arange(len(h))
    with np.errstate(over="ignore"):
        s = h * _C[0]
        for j in range(1, n):
            x = np.zeros_like(h)
            if j < len(h):
                x[:-j] = h[j:] * _C[j]
            s += np.where(i + j < end, x, U64(0))
        s = mix(s)
    keep = (i + n <= end) | ((i == np.repeat(first[:-1], count)) & np.repeat(count < n, count))
    kept = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return s[keep], np.concatenate([[0], np.cumsum(kept)])


def _sketch(batches):
    for b in batches:
        ids, t = ints(b.column("doc_id")), ints(b.column("t"))
        for i, j, data, at in pieces(b.column("text")):
            h, _, _, first = words(data, at)
            s, own = shingles(h, first)
            rows = np.flatnonzero(np.diff(own))
            if not len(rows):
                continue
            start, wstart = own[rows], first[rows]
            with np.errstate(over="ignore"):
                pos = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(U64)
                k1 = np.add.reduceat(mix(h + pos * U64(0x9E3779B97F4A7C15)), wstart)
                k2 = np.add.reduceat(mix((h ^ U64(0xA5A5A5A5A5A5A5A5)) + pos * U64(0xC2B2AE3D27D4EB4F)), wstart)
                x = s.astype(np.uint32)
                sig = np.empty((len(rows), N_HASHES), np.uint16)
                for k in range(N_HASHES):
                    m = np.minimum.reduceat(x * _A[k] + _B[k], start).astype(U64)
                    sig[:, k] = mix(m + U64(k)).astype(np.uint16)
            yield batch(doc_id=ids[i:j][rows], t=t[i:j][rows], k1=k1.view(np.int64), k2=k2.view(np.int64), size=np.diff(own)[rows], sig=blobs(sig.ravel(), np.full(len(rows), N_HASHES)))


def _bands(sig: np.ndarray) -> np.ndarray:
    """For each row the ROWS values of each band as one number."""
    return np.ascontiguousarray(sig).view(U64)


def _band_rows(batches):
    for b in batches:
        if b.num_rows:
            with np.errstate(over="ignore"):
                key = mix(_bands(_sigs(b)) + salts(104, BANDS)).view(np.int64)
            yield batch(key=key.ravel(), band=np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows), **{c: np.repeat(ints(b.column(c)), BANDS) for c in ("rep", "size")})


def _sigs(t) -> np.ndarray:
    return raw(t.column("sig"))[0].view(np.uint16).reshape(t.num_rows, N_HASHES)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared MinHash values, the fewest agreeing ones for which, with a uniform prior, the posterior probability
    that the similarity reaches the threshold is at least the tolerance."""
    least = np.zeros(N_HASHES + 1, np.int64)
    for n in range(1, N_HASHES + 1):
        p, m = 0.0, 0
        while m <= n and (p := p + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        least[n] = m
    return least


def _surviving(g: np.ndarray, blk: np.ndarray, two: np.ndarray, band: np.ndarray, sig: np.ndarray, least: np.ndarray):
    """Pairs (i, j) of rows of one group that the incremental comparison doesn't drop, by ever larger j - i; of a pair that
    meets in several bands, only where it meets first."""
    key = _bands(sig)
    for d in range(1, len(g)):
        i = np.flatnonzero(g[:-d] == g[d:])
        if not len(i):
            return
        i = i[~two[i] | (blk[i] != blk[i + d])]
        agree = np.zeros(len(i), np.int64)
        for n in range(STEP, N_HASHES + 1, STEP):
            if not len(i):
                break
            agree += (sig[i, n - STEP : n] == sig[i + d, n - STEP : n]).sum(1)
            ok = agree >= least[n]
            i, agree = i[ok], agree[ok]
        if len(i):
            same = key[i] == key[i + d]
            i = i[(same.argmax(1) == band[i]) & same.any(1)]
        if len(i):
            yield i, i + d


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n rows the smallest row that the pairs (a, b) connect each with."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            return root


def _spread(df: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """Buckets ``key`` of ``n`` rows and ``shingles`` cut in blocks; each two blocks of a bucket, and each with itself, meet under
    one ``g``."""
    n = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("shingles") / most_shingles)).cast("int")
    df = df.withColumn("nb", n).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("two", F.col("blk") != F.col("other")).withColumn("g", F.xxhash64("key", "band", F.least("blk", "other"), F.greatest("blk", "other"))).drop("nb", "other", "n", "shingles", "key")


def _similar(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(doc_id, t, class_id, n_same, n_copies, n_links) for each doc_id and text (t: its xxhash64) that has a word; n_same
    counts the rows that agree in both."""
    d = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    sketch = store(d.mapInArrow(_sketch, "doc_id long, t long, k1 long, k2 long, size long, sig binary"))
    # copies: texts of the same words. What follows is about one row for each, numbered by writing
    rep = sketch.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    rep = store(rep.withColumn("rep", F.monotonically_increasing_id()))
    member = sketch.groupBy("doc_id", "t", "k1", "k2").agg(F.count("*").alias("n_same")).join(rep, ["k1", "k2"])
    several = sketch.select("doc_id", "t", "k1", "k2", "size", "sig").join(rep.withColumnRenamed("first", "doc_id"), ["doc_id", "k1", "k2"])
    texts = store(several.dropDuplicates(["rep"]).select("rep", "doc_id", "t", "n_copies", "size", "sig"))
    # candidate buckets
    rows = texts.select("rep", "size", "sig").mapInArrow(_band_rows, "key long, band int, rep long, size long")
    several = store(rows.groupBy("key", "band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1"))
    cand = store(rows.join(several, ["key", "band"]).drop("size"))
    least = least_matches(threshold, tolerance)

    def first_look(t: pa.Table):
        g, blk, two, band, rep = (ints(t.column(c)) for c in ("g", "blk", "two", "band", "rep"))
        pairs = list(_surviving(g, blk, two, band, _sigs(t), least))
        if pairs:
            m = np.unique(np.concatenate([x for p in pairs for x in p]))
            yield batch(g=g[m], blk=blk[m], two=two[m], band=band[m], rep=rep[m])

    met = _spread(cand, BLOCK, BLOCK_SHINGLES).join(texts.select("rep", "sig"), "rep").select("g", "blk", "two", "band", "rep", "sig")
    met = store(by_key(met, "g", first_look, "g long, blk int, two boolean, band int, rep long"))
    # shingles only of texts that a pair is left of, and only to where it is
    involved = store(met.select("rep").distinct().join(texts.select("rep", "doc_id", "t", "n_copies", "sig"), "rep"))
    involved = involved.withColumnRenamed("doc_id", "d").withColumnRenamed("t", "dt")
    sets = d.join(involved, (F.col("d") == F.col("doc_id")) & (F.col("dt") == F.col("t"))).select("rep", "n_copies", "sig", "text")

    def to_sets(batches):
        for b in batches:
            parts, sizes = [], []
            for _, _, data, at in pieces(b.column("text")):
                h, _, _, first = words(data, at)
                s, own = shingles(h, first)
                for x, y in zip(own[:-1], own[1:], strict=True):
                    parts.append(np.unique(s[x:y]))
                    sizes.append(len(parts[-1]))
            if parts:
                yield batch(rep=b.column("rep"), n_copies=b.column("n_copies"), sig=b.column("sig"), shingles=blobs(np.concatenate(parts), np.array(sizes)))

    sets = store(sets.mapInArrow(to_sets, "rep long, n_copies long, sig binary, shingles binary").dropDuplicates(["rep"]))

    def verify(t: pa.Table):
        g, blk, two, band, rep, copies = (ints(t.column(c)) for c in ("g", "blk", "two", "band", "rep", "n_copies"))
        data, at = raw(t.column("shingles"))
        data, at = data.view(U64), at // 8
        size, links = np.diff(at), np.zeros(len(g), np.int64)
        as_, bs = [], []
        for i, j in _surviving(g, blk, two, band, _sigs(t), least):
            near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                x, y = data[at[a] : at[a + 1]], data[at[b] : at[b + 1]]
                p = np.searchsorted(y, x)
                p[p == len(y)] = 0
                both = int(np.count_nonzero(y[p] == x))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    as_.append(a)
                    bs.append(b)
        if as_:
            a, b = np.array(as_), np.array(bs)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = rep[_roots(len(g), a, b)]
            m = np.flatnonzero(links)
            yield batch(rep=rep[m], links=links[m], root=root[m])

    found = met.join(sets, "rep").select("g", "blk", "two", "band", "rep", "n_copies", "sig", "shingles")
    found = store(by_key(found, "g", verify, "rep long, links long, root long"))
    label = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked = label.join(found.groupBy("rep").agg(F.sum("links").alias("links")), F.col("node") == F.col("rep")).join(rep.select("rep", "first"), "rep")
    linked = store(linked.select("rep", "label", "links", "first"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("smallest"))
    linked = linked.join(store(smallest), "label").select("rep", "smallest", "links")
    links = F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))
    return member.join(linked, "rep", "left").select("doc_id", "t", F.coalesce("smallest", "first").alias("class_id"), "n_same", "n_copies", links.alias("n_links"))


def similar(docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least ``threshold``
    (words: runs of letters, digits, _ and non-ASCII characters, A-Z folded; a text of fewer words is one shingle).
    class_id is the smallest doc_id that links lead to, n_copies counts the rows with the same words, itself
    included, n_links the rows, copies included, that it is linked with. Candidates share all ROWS MinHash values of
    a band, of which there are 24: a pair at similarity 0.8 meets with probability 0.999997. Candidate pairs are
    compared a few MinHash values at a time, in one of the buckets where they meet, and dropped when the posterior
    probability of reaching the threshold falls below ``tolerance``; the shingles of what is left are sent to where a pair
    is left, and verified there. Texts that are null or have no word link with nothing: their class is their own. Rows with a
    null doc_id get nulls and 0 links. Every row counts, those that repeat whole too; rows that agree in doc_id alone are
    documents of their own, told apart by xxhash64 of the text. Other columns are ignored; an empty table gives an empty
    table."""
    done = _similar(docs, threshold, tolerance).withColumnsRenamed({"doc_id": "d", "t": "dt"})
    ids = docs.select("doc_id", F.xxhash64("text").alias("t"))
    one = F.lit(1)
    return ids.join(done, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("dt")), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: of those that links lead to from one to the next, that of the smallest doc_id.

    Texts without a word and rows of a null doc_id are in no class and stay. Where several rows of a class have its smallest
    doc_id, that of the smallest xxhash64(text) stays, and of equal rows one."""
    d, t, n = unused(docs, "d", "t", "n")
    found = store(_similar(docs, threshold, TOLERANCE))
    least = store(found.filter("class_id = doc_id").groupBy("class_id").agg(F.min("t").alias("least")))
    gone = found.join(least, "class_id").select(F.col("doc_id").alias(d), F.col("t").alias(t), ((F.col("class_id") == F.col("doc_id")) & (F.col("t") == F.col("least"))).alias("stays"), F.col("n_same").alias(n))
    gone = store(gone.filter(f"not stays or `{n}` > 1").withColumn(n, F.when(F.col("stays"), F.col(n))).drop("stays"))
    same = (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(t))
    kept = docs.join(gone.select(d, t), same, "left_anti")
    again = gone.filter(F.col(n).isNotNull())
    if again.take(1):
        kept = kept.unionByName(docs.join(again, same).dropDuplicates(["doc_id", t]).select(*docs.columns))
    return kept


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of each document."""
    return similar(table(spark, sf_dir, "documents"))
