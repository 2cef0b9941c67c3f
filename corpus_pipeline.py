"""The training-data pipeline: toxic documents go, repeated line runs are cut, one of each near-duplicate group stays,
benchmark leaks go, and sources are mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm.common import remove, store, table, temporary
from chronolake.llm.leaks import clean
from chronolake.llm.lines import without_repeats
from chronolake.llm.mixing import mix_sources
from chronolake.llm.near import one_of_each
from chronolake.llm.toxicity import harmless


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return harmless(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; n_chars follows. Documents of which nothing is left stay,
    with an empty text."""
    cut = without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier's fit and the near-duplicate components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next. What a stage stored on its way goes
    as soon as its result is written, and the result when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with temporary(spark) as own:
            docs = store(stage(spark, docs, sf_dir))
            kept = own.pop()
        remove(spark, before)
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
