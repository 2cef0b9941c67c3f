"""A kept keyword index: postings by term, added to by delta, and searched without the texts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import _c, query_terms
from ..operators.fulltext import K1, B
from ..schema import _struct
from .sinks import Store

#: Folders that terms are dealt to. The next one has each delta's documents, as rows of the empty term.
BUCKETS = 64

#: Bytes of text that are cut into terms at once.
SLICE = 1 << 24

#: Bytes that can be part of a term: letters and digits of ASCII, and all bytes of other characters.
_IN = np.array([chr(i).isalnum() or i > 127 for i in range(256)])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of texts in lower case, those of ``tokens``, and for each occurrence its term and text by number.

    Texts are cut at ASCII bytes first; only the distinct results are held against the classes of other characters."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word, new = _IN[data], np.zeros(len(data) + 1, bool)
    new[at] = True  # a word doesn't go on in the next text
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | new[1:-1]
    last[:-1] &= ~word[1:] | new[1:-1]
    begin = np.flatnonzero(first)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, at)))
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - begin))
    found = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[word])]).dictionary_encode()
    parts = pc.split_pattern(pc.replace_substring_regex(found.dictionary, r"[^\p{L}\p{N}]+", " "), " ")
    of, part = pc.list_parent_indices(parts), parts.flatten()
    keep = pc.greater_equal(pc.utf8_length(part), 2)
    of, part = of.filter(keep).to_numpy(), part.filter(keep).dictionary_encode()
    count, code = np.bincount(of, minlength=len(parts)), found.indices.to_numpy()
    n, start = count[code], (np.cumsum(count) - count)[code]
    place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return part.dictionary, part.indices.to_numpy()[place], np.repeat(row, n)


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text in lower case): each slice's terms with their documents (ids, tfs, dls); the empty term with all documents of
    the slice. So a document's terms are counted where it is read, and a frequent term travels once for many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).cast(pa.string()), b.column(1).cast(pa.large_string())
            end, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + size, "right")))
                i, t, n = ids.slice(at, to - at), texts.slice(at, to - at), to - at
                terms, term, row = _words(pc.fill_null(t, ""))
                dl = np.where(t.is_null().to_numpy(zero_copy_only=False), -1, np.bincount(row, minlength=n))
                key, tf = np.unique(term.astype(np.int64) * n + row, return_counts=True)
                of, row = np.append(key // n, np.full(n, len(terms))), np.append(key % n, np.arange(n))
                offsets = pa.array(np.searchsorted(of, np.arange(len(terms) + 2)).astype(np.int32))
                docs = [i.take(pa.array(row)), pa.array(np.append(tf, np.zeros(n, np.int64)).astype(np.int32)), pa.array(dl[row].astype(np.int32))]
                terms = pa.concat_arrays([terms.cast(pa.string()), pa.array([""])])
                yield pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(offsets, x) for x in docs)], ["term", "ids", "tfs", "dls"])
                at = to

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings (bucket, term, id, tf, dl) in order of terms: blocks of each batch's terms."""
    for b in batches:
        if b.num_rows:
            run = pc.run_end_encode(b.column("term"))
            end = run.run_ends.to_numpy()
            offsets = pa.array(np.append(0, end).astype(np.int32))
            docs = [b.column("id"), b.column("tf").cast(pa.int32()), b.column("dl").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("bucket").take(pa.array(end - 1)), run.values, *(pa.ListArray.from_arrays(offsets, x) for x in docs)], ["bucket", "term", "ids", "tfs", "dls"])


_BLOCK = "term string, ids array<string>, tfs array<int>, dls array<int>"


def _inline(blocks: DataFrame) -> DataFrame:
    rest = [c for c in blocks.columns if c not in ("ids", "tfs", "dls")]
    p = blocks.select(*rest, F.inline(F.arrays_zip("ids", "tfs", "dls")).alias("id", "tf", "dl"))
    return p.withColumns({"tf": F.col("tf").cast("long"), "dl": F.col("dl").cast("long")})


class TextIndex(Store):
    """Postings (term, id, tf, dl) in folders by term, the documents' lengths, and totals, all by version as in ``Store``.

    Postings lie, as they travel, in blocks: a term with the ids, counts and lengths of some of its documents. No delta's
    postings are sorted, only its blocks.

    A delta reads its own texts and the ids known so far. Of an id that comes again, or is removed, a row in ``gone``
    hides the postings that are older; folding drops them. A search reads the folders of its terms and one row for each delta."""

    KEYS = {"postings": ["term", "id"], "docs": ["id"], "gone": ["id"], "totals": ["delta"]}
    SCHEMAS = {"postings": _struct(f"bucket int, {_BLOCK}"), "docs": _struct("id string, dl bigint"), "gone": _struct("id string"), "totals": _struct("delta bigint, n bigint, texts bigint, words bigint")}
    PARTS = {"postings": "bucket"}
    OPTIONS = {"postings": {"parquet.enable.dictionary": "false"}}  # hashing each id would take longer than writing it

    def add(self, docs: DataFrame, text: str = "text", writer: str = "", batch: int | None = None) -> None:
        """Index ``docs`` (id, text), each id once; ids that are known already are indexed anew. A null text (dl -1) has no terms,
        but counts, though not in the average length. ``writer``'s ``batch`` may run again."""
        n = self.version(writer, batch)
        t = docs.filter("id is not null").select(F.col("id").cast("string").alias("id"), F.lower(_c(text)).alias("text"))
        p = t.mapInArrow(_blocks(SLICE), _BLOCK)
        p = p.withColumn("bucket", F.when(F.col("term") == "", BUCKETS).otherwise(F.crc32("term") % BUCKETS).cast("int"))
        if t.groupBy("id").count().filter("count > 1").isEmpty():
            self.append("postings", p.repartition("bucket").sortWithinPartitions("bucket", "term"), n)
        else:  # an id that comes more than once after all: its texts' terms are its own
            self._pack(_inline(p).groupBy("bucket", "term", "id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl")), n)
        self._change(self.raw("postings", [str(BUCKETS)]).filter(F.col("_version") == n).select("id", "dl"), n)

    def raw(self, table: str, dates: Iterable[str] | None = None) -> DataFrame:
        t = super().raw(table, dates)
        return _inline(t) if table == "postings" else t

    def _pack(self, postings: DataFrame, n: int) -> None:
        p = postings.select("bucket", "term", "id", "tf", "dl").repartition("bucket").sortWithinPartitions("bucket", "term", "id")
        self.append("postings", p.mapInArrow(_packed, f"bucket int, {_BLOCK}").sortWithinPartitions("bucket", "term"), n)

    def remove(self, ids: DataFrame) -> None:
        """Drop the documents of ``ids`` (id)."""
        known = self.read("docs").filter("dl is not null").select("id")
        self._change(ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("dl")).join(known, "id", "left_semi"), self.version())

    def _change(self, docs: DataFrame, n: int) -> None:
        old = self.read("docs", before=n).filter("dl is not null").join(docs.select("id").distinct(), "id", "left_semi")
        self.append("gone", old, n)
        parts = {"n": F.count("dl"), "texts": F.count_if(F.col("dl") >= 0), "words": F.coalesce(F.sum(F.greatest("dl", F.lit(0))), F.lit(0))}
        count = lambda t, sign: t.filter("dl is not null").agg(*((x * sign).alias(c) for c, x in parts.items()))
        self.append("totals", count(docs, 1).unionByName(count(old, -1)).agg(*(F.sum(c).alias(c) for c in parts)).withColumn("delta", F.lit(n)), n)
        self.append("docs", docs, n)

    def postings(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The postings that count, of some folders."""
        t = self.raw("postings", map(str, range(BUCKETS) if buckets is None else buckets))
        older = F.lit(False)
        for part, n in self.marks("postings").items():  # one for each folder at most
            older |= (F.col("bucket") == int(part)) & (F.col("_version") < n)
        gone = self.raw("gone").filter(F.col("_version") >= self.marks("gone").get("", 0)).groupBy("id").agg(F.max("_version").alias("_gone"))
        if before is not None:
            t, gone = t.filter(F.col("_version") < before), gone.filter(F.col("_gone") < before)
        return t.filter(~older).join(gone, "id", "left").filter("_gone is null or _version >= _gone").select("term", "id", "tf", "dl")

    def refold(self) -> None:
        """Write the postings that count as one version; nothing is gone then."""
        n = self.version()
        self._pack(self.postings(before=n).withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")), n)
        self.mark("postings", map(str, range(BUCKETS + 1)), n)
        self.append("gone", self.raw("gone").limit(0), n)
        self.mark("gone", [""], n)
        self.fold("docs", keep=F.col("dl").isNotNull())

    def search(self, query: str, limit: int, least: int = 1000, digits: int | None = None) -> DataFrame:
        """(id, score): what ``bm25`` gives over the documents indexed, best first, ties by id, ``digits`` as there.

        A term adds idf * (K1 + 1) at most. If the ``limit``th best score by a query's rarer terms alone is above what
        the others can add, only documents with a rarer term can be among the best, and the others' postings count for these
        alone; that is tried where a term has ``least`` documents or more."""
        terms = query_terms(query)
        none = self.spark.createDataFrame([], "id string, score double")
        if not terms:
            return none
        p = self.postings(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})).filter(F.col("term").isin(terms))
        total = self.read("totals").agg(*(F.sum(c).alias(c) for c in ("n", "texts", "words"))).first()
        found = dict(tuple(r) for r in p.groupBy("term").agg(F.count("*")).collect())  # a row for each term of the query
        if not found:
            return none
        idf = {t: max(math.log((total.n - n + 0.5) / (n + 0.5)), 1e-6) for t, n in found.items()}
        average = total.words / total.texts
        part = lambda t: F.lit(idf[t]) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        own = F.lit(None).cast("double")
        for t in found:
            own = F.when(F.col("term") == t, part(t)).otherwise(own)
        # scores add up in the order of the query's terms, as they do without an index
        def scored(p: DataFrame, of: list[str]) -> DataFrame:
            sums = p.withColumn("s", own).groupBy("id").agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("s"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(of)))
            score = sum((F.col(f"s{i}") for i in range(len(of))), F.lit(0.0))
            return sums.select("id", (score if digits is None else F.round(score, digits)).alias("score"))

        rare = sorted(found, key=lambda t: -idf[t])
        rounded = 0.0 if digits is None else 10.0**-digits  # rounding can make scores equal that differ by less
        for j in range(1, len(rare)):
            head, rest = rare[:j], sum(idf[t] * (K1 + 1) for t in rare[j:])
            if max(found[t] for t in rare[j:]) >= least and rest < sum(idf[t] * (K1 + 1) for t in head):
                best = scored(p.filter(F.col("term").isin(head)), head).orderBy(F.desc("score")).limit(limit).agg(F.min("score"), F.count("*")).first()
                if best[1] == limit and rest + rounded < best[0]:
                    p = p.join(p.filter(F.col("term").isin(head)).select("id").distinct(), "id", "left_semi")
                    break
        return scored(p, [t for t in terms if t in found]).orderBy(F.desc("score"), "id").limit(limit)
