"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: A source and size class of n rows is dealt out by the hashes of id and text to sqrt(n) / SPREAD slices, so that neither the rows of a
#: slice, which one task numbers, nor the slices of a class grow in proportion to it.
SPREAD = 8

#: Equal rows are numbered in lots of at most 2^LOT rows, as they come.
LOT = 20

SIZE_SQL = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def name(doc_id: str, text: str) -> Column:
    """A hash of id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """Size of each document: its words, 0 for a null text; and the key that its id and text have."""
    return docs.select("doc_id", "source", F.expr(SIZE_SQL).cast("long").alias("size"), name("doc_id", "text").alias("key"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; no target
    exceeds ``limit`` times its source's size, and what is cut off goes to the others by weight. That is: with sources
    sorted by size per weight, the first few stop at their limit and all others get the same amount per unit of weight.
    One row for each source passes through a single task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = by_source.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * limit)
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", (F.sum("source_size").over(everything) * share).alias("budget"), F.sum("w").over(everything).alias("all_w"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    t = t.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    t = t.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("w"), F.coalesce("source", F.lit("")), F.col("source").isNull()))).over(everything))
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def offset(source: Column) -> Column:
    """The source's random offset in [0, 1): the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("~null~")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, source, text).

    Every document of a source expects target / source_size copies, which is at most ``limit``; copies are that, rounded up or
    down. Their prefix sums run over the source's documents, those of like size side by side, so that the words taken stay
    near the target; a document is emitted once for each whole number that its step crosses, after the source's one random
    offset. The prefix sums come from counts of small bins (source, size class, slice), so that no source has to pass through one
    task: only a bin's different rows are numbered together, and equal rows, that is rows that agree in source, id and text, in lots. Null texts have size
    0; a null source is a source of its own, the last; equal rows are rows of their own, any of which may get the higher count; an empty table gives an empty
    table; null doc_ids are sampled as any others. Other columns are not looked at."""
    d = sizes(docs).withColumn("lot", F.shiftright(F.monotonically_increasing_id(), LOT))
    d = d.withColumn("hash", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))
    # size class: sizes of equal length in binary that agree in their first five digits
    d = d.withColumn("class", F.length(F.bin("size")) * 32 + F.conv(F.rpad(F.substring(F.bin("size"), 1, 5), 5, "0"), 2, 10).cast("int"))
    d = store(d.withColumn("nth", F.row_number().over(Window.partitionBy("source", "key", "lot").orderBy("size"))))
    by_class = store(d.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    in_order = Window.partitionBy("source").orderBy("class")
    slices = F.greatest(F.lit(1), F.floor(F.sqrt("n") / SPREAD)).cast("long").alias("slices")
    starts = by_class.select(F.col("source").alias("src"), F.col("class").alias("c"), slices, (F.sum("n").over(in_order) - F.col("n")).alias("before"))
    by_source = store(targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit).withColumnRenamed("source", "of"))
    starts = store(starts.join(by_source, F.col("src").eqNullSafe(F.col("of"))).drop("of"))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("class") == F.col("c"))).withColumn("slice", F.col("hash") % F.col("slices"))
    # equal rows of a lot are one row with a count from here on
    lots = store(d.groupBy("src", "c", "slice", "size", "doc_id", "key", "lot").agg(F.count("*").alias("m")))
    bins = lots.groupBy("src", "c", "slice").agg(F.sum("m").alias("m"))
    in_class = Window.partitionBy("src", "c").orderBy("slice")
    bins = store(bins.select(F.col("src").alias("s"), F.col("c").alias("cc"), F.col("slice").alias("sl"), (F.sum("m").over(in_class) - F.col("m")).alias("before_slice")))
    own = Window.partitionBy("src", "c", "slice").orderBy("size", "doc_id", "key", "lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.withColumn("before_lot", F.coalesce(F.sum("m").over(own), F.lit(0)))
    lots = lots.join(bins, F.col("src").eqNullSafe(F.col("s")) & (F.col("c") == F.col("cc")) & (F.col("slice") == F.col("sl")))
    lots = lots.select(F.col("src").alias("of"), F.col("key").alias("of_key"), F.col("lot").alias("of_lot"), (F.col("before_slice") + F.col("before_lot")).alias("before_row"))
    r = d.join(lots, F.col("src").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")) & (F.col("lot") == F.col("of_lot")))
    step = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rank, u = F.col("before") + F.col("before_row") + F.col("nth"), offset(F.col("src"))
    copies = (F.floor(rank * step + u) - F.floor((rank - 1) * step + u)).cast("long")
    return r.select("doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
c as (select *, ('0x' || substr(key, 1, 8))::bigint as hash, length(bin(size)) * 32 + list_reduce(list_transform(string_split(rpad(substr(bin(size), 1, 5), 5, '0'), ''), lambda x: x::int), lambda a, b: a * 2 + b) as class from d),
z as (select *, hash % greatest(1, floor(sqrt(count(*) over (partition by source, class)) / 8)::bigint) as slice from c),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from c group by source),
n as (select *, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as budget, sum(w) over () as all_w from s),
l as (select *, (budget - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) /
  (all_w - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from n),
f as (select level from l where level * w <= cap order by cap / w, source nulls last limit 1),
t as (select source, source_size, least(cap, coalesce((select level from f) * w, cap)) as target from l),
r as (select c.doc_id, c.source, c.size, t.source_size, t.target,
  row_number() over (partition by c.source order by c.class, c.slice, c.size, c.doc_id nulls first, c.key) as rank,
  case when t.source_size = 0 then 0 else t.target / t.source_size end as step,
  ('0x' || substr(md5(coalesce(c.source, '~null~')), 1, 8))::bigint / 4294967296.0::double as u
  from z c join t on c.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rank * step + u) - floor((rank - 1) * step + u))::bigint * size as taken,
  (floor(rank * step + u) - floor((rank - 1) * step + u))::bigint as copies from r
"""
