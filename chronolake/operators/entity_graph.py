"""The knowledge graph: entities found in texts, their relations, and bounded walks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import json_block
from ..schema import stable_id

# Technologies, concepts, and capitalised words that name nothing.
TECHNOLOGIES = (
    "python", "rust", "javascript", "typescript", "go", "java", "kotlin", "swift", "c++", "c#", "ruby", "php", "scala", "haskell",
    "react", "vue", "angular", "svelte", "nextjs", "nuxt", "django", "flask", "fastapi", "express", "rails", "postgres", "mysql",
    "sqlite", "mongodb", "redis", "elasticsearch", "docker", "kubernetes", "terraform", "ansible", "aws", "gcp", "azure", "git",
    "github", "gitlab", "jira", "linear", "openai", "anthropic", "claude", "gpt", "llm", "numpy", "pandas", "pytorch", "tensorflow",
    "sklearn",
)
CONCEPTS = (
    "api", "rest", "graphql", "grpc", "websocket", "authentication", "authorization", "oauth", "jwt", "microservices", "monolith",
    "serverless", "ci/cd", "devops", "mlops", "testing", "debugging", "refactoring", "performance", "security", "scalability",
)
NO_NAMES = ("The", "This", "That", "It", "We", "They", "He", "She", "You", "I", "And", "But", "Or", "So")


def contained(text: Column, patterns: tuple[str, ...]) -> Column:
    """Which of ``patterns`` each text contains, as their places in order: one pass of an automaton over each text, however many
    patterns there are. Null has none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            found.add_word(p, i)
        found.make_automaton()
        for t in batches:
            hits = [sorted({i for _, i in found.iter(x)}) if x else [] for x in t.to_pylist()]
            off = np.cumsum([0, *map(len, hits)])
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array([i for h in hits for i in h], pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def rule_entities(texts: DataFrame) -> DataFrame:
    """(id, name, type, confidence) found in ``texts`` (id, text): technologies and concepts as substrings in any case, once
    each, and capitalised words of three letters or more, once for each place. One scan, nothing shuffled."""
    known = [(n, kind, sure) for names, kind, sure in ((TECHNOLOGIES, "technology", 0.9), (CONCEPTS, "concept", 0.8)) for n in names]
    one = lambda n, kind, sure: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    table = F.array(*(one(F.lit(n), kind, sure) for n, kind, sure in known))
    t = texts.filter("text is not null").select("id", "text", contained(F.lower("text"), tuple(n for n, *_ in known)).alias("hits"))
    # a word ends where no letter, mark, digit or _ follows
    words = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{M}\p{N}_])([A-Z][a-z]{2,})(?![\p{L}\p{M}\p{N}_])"), F.lit(1))
    names = F.transform(F.filter(words, lambda w: ~w.isin(*NO_NAMES)), lambda w: one(w, "project", 0.5))
    found = F.concat(F.transform("hits", lambda i: F.get(table, i)), names)
    return t.select("id", F.explode(found).alias("e")).select("id", "e.name", "e.type", "e.confidence")


def entity_id(name: Column | str = "name", kind: Column | str = "type") -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return stable_id(F.lower(n), kind)


def merged_entities(mentions: DataFrame) -> DataFrame:
    """Entities from mentions (name, type, confidence, timestamp): one for each name in any case and type, with the number
    of mentions, the highest confidence, first and last time, and the spellings as aliases."""
    m = mentions.groupBy(entity_id().alias("id"), F.lower("name").alias("name"), "type", F.col("name").alias("spelling")).agg(F.count("*").alias("n"), F.max("confidence").alias("c"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return m.groupBy("id", "name", "type").agg(F.array_sort(F.collect_list("spelling")).alias("aliases"), F.max("c").alias("confidence"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.sum("n").alias("mention_count"))


def with_model_entities(by_rule: DataFrame, by_model: DataFrame) -> DataFrame:
    """Rule entities, and those of a model whose name in any case no rule found for the same text."""
    r = by_rule.select(F.col("id").alias("_i"), F.lower("name").alias("_n")).distinct()
    new = by_model.join(r, (by_model["id"] == r["_i"]) & (F.lower(by_model["name"]) == r["_n"]), "left_anti")
    return by_rule.unionByName(new)


def merged_relations(seen: DataFrame) -> DataFrame:
    """Relations (source_entity_id, target_entity_id, type, confidence, timestamp): one for each, of strength 1, and 0.1 more
    for each repeat."""
    return seen.groupBy("source_entity_id", "target_entity_id", "type").agg(F.max("confidence").alias("confidence"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), (1.0 + 0.1 * (F.count("*") - 1)).alias("strength"))


def resolved(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between names (id, source, target, type) with the ids of entities of one extraction; others are left out."""
    e = entities.select("id", "name", F.col("entity_id").alias("_e")).distinct()
    s = e.select("id", F.col("name").alias("source"), F.col("_e").alias("source_entity_id"))
    t = e.select("id", F.col("name").alias("target"), F.col("_e").alias("target_entity_id"))
    return relations.join(s, ["id", "source"]).join(t, ["id", "target"])


def neighbours(relations: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth) of the entities that relations (source_entity_id, target_entity_id), in either direction, reach from
    ``starts`` (id) within ``depth`` steps; the starts themselves are left out."""
    e = relations.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edge = starts.select("id").distinct()
    seen = edge.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        nxt = e.join(edge, e["a"] == edge["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        nxt = nxt.join(seen, "id", "left_anti")
        seen = seen.unionByName(nxt.withColumn("depth", F.lit(d)))
        edge = nxt
    return seen.filter("depth > 0")


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities of each type, and the numbers of all entities and relations on each row."""
    t = entities.groupBy("type").agg(F.count("*").alias("n"))
    both = entities.agg(F.count("*").alias("entities")).join(relations.agg(F.count("*").alias("relations")))  # one row and one row
    return t.join(F.broadcast(both))


def search_entities(entities: DataFrame, relations: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Entities of this name in any case, and what is within two steps of them."""
    hit = entities.filter(F.lower("name") == name.lower()).select("id")
    near = neighbours(relations, hit, 2).unionByName(hit.withColumn("depth", F.lit(0)))
    return entities.join(near, "id").orderBy("depth", "id").limit(limit)


def model_extraction(texts: DataFrame, ask, least_bytes: int = 100, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, type, confidence) and relations (id, source, target, type, confidence) that a model finds in
    ``texts`` (id, text) of more than ``least_bytes``. ``ask``: prompts to replies, on Arrow batches; a reply is JSON,
    perhaps within prose, and one that can't be read gives nothing."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(ask(s.tolist())), dtype=object)

    prompt = F.concat(F.lit('List what this text names, as JSON {"entities": [{"name", "type"}], "relationships": [{"source", "target", "type"}]}.\n\n'), F.left("text", F.lit(most)))
    shape = "entities array<struct<name:string,type:string>>, relationships array<struct<source:string,target:string,type:string>>"
    t = texts.filter(F.octet_length("text") > least_bytes).select("id", F.from_json(json_block(F.pandas_udf(run, T.StringType())(prompt)), shape).alias("r"))
    kind = lambda c, known, other: F.when(c.isin(*known), c).otherwise(other)
    e = t.select("id", F.explode("r.entities").alias("e")).filter("e.name <> ''")
    e = e.select("id", F.col("e.name").alias("name"), kind(F.col("e.type"), ("technology", "project", "person", "organization"), "concept").alias("type"), F.lit(0.8).alias("confidence"))
    r = t.select("id", F.explode("r.relationships").alias("e")).filter("e.source <> '' and e.target <> ''")
    return e, r.select("id", F.col("e.source").alias("source"), F.col("e.target").alias("target"), kind(F.col("e.type"), ("uses", "works_on"), "relates_to").alias("type"), F.lit(0.7).alias("confidence"))


def enriched(events: DataFrame, ask=None) -> DataFrame:
    """Mentions (id, name, type, confidence, timestamp) in each event's summary and the first 500 characters of its content,
    by rules, and by a model too if one is given."""
    t = events.select("id", "timestamp", F.concat_ws(" ", "summary", F.left("raw_content", F.lit(500))).alias("text"))
    found = rule_entities(t.select("id", "text"))
    if ask is not None:
        found = with_model_entities(found, model_extraction(t.select("id", "text"), ask)[0])
    return found.join(t.select("id", "timestamp"), "id")
