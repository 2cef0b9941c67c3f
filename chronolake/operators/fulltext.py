"""Keyword search with BM25."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import _c, query_terms, tokens
from ..functions.stem import stem, stemmed

K1, B = 1.2, 0.75


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, id, tf, dl): the index that keyword search would keep, derived anew from the rows as they are."""
    t = docs.select("id", tokens(text).alias("w")).withColumn("dl", F.size("w"))
    return t.select("id", "dl", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def unindexed(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that the index lacks."""
    return docs.join(index.select("id").distinct(), "id", "left_anti")


def _counts(text: str, terms: list[str]) -> Column:
    """The number of a text's tokens, then how often each term occurs among them.

    Runs of other characters become two blanks, so that every token stands between blanks of its own, a term is a plain
    substring, and there is one run more than tokens."""

    def run(t: pa.Array) -> pa.Array:
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        t = pc.binary_join_element_wise(blank, pc.fill_null(t, "").cast(pa.large_string()), blank, none)
        t = pc.replace_substring_regex(t, r"[^\p{L}\p{N}]+", "  ")
        short = pc.count_substring_regex(t, r" [\p{L}\p{N}] ")
        n = [pc.subtract(pc.subtract(pc.count_substring(t, "  "), 1), short), *(pc.count_substring(t, f" {q} ") for q in terms)]
        flat = np.stack([x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in n], 1).ravel() if len(t) else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * len(n), pa.int32()), pa.array(flat))

    return F.arrow_udf(run, "array<long>")(F.lower(text))


def bm25(docs: DataFrame, query: str, limit: int, text: str = "text", stems: bool = False, digits: int | None = None) -> DataFrame:
    """(id, score) of the rows that match any term of the query, best first, ties by id; nothing for a query without terms.
    Scores are rounded to ``digits``, if given, before they are ordered and cut, so that the ties are those of what is shown.

    Only the query's terms are counted, on Arrow batches, and the counts are shuffled but nothing of the text: so one scan gives
    both the corpus statistics, which are a single row, and the scores. Higher is better; idf = ln((N - df + 0.5) / (df + 0.5)),
    1e-6 where that isn't positive. A null text counts in N, but not in the average length. ``stems``: English words match in any inflection, at the price of an Arrow UDF."""
    terms = query_terms(query)
    terms = list(dict.fromkeys(map(stem, terms))) if stems else terms
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    known = _c(text).isNotNull().alias("known")
    if stems:
        w = docs.select("id", known, stemmed(tokens(text)).alias("w"))
        count = lambda q: F.size(F.filter("w", lambda x: x == q))
        n = [F.size("w"), *map(count, terms)]
    else:
        w = docs.select("id", known, _counts(text, terms).alias("c"))
        n = [F.col("c")[i] for i in range(len(terms) + 1)]
    t = w.select("id", F.when(F.col("known"), n[0]).alias("dl"), *(x.alias(f"tf{i}") for i, x in enumerate(n[1:]))).repartition("id")
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        score += F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = t.filter(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0)
    score = score if digits is None else F.round(score, digits)
    return hit.join(F.broadcast(stats)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)  # one row of statistics
