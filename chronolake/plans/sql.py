"""The tools for those who write SQL: views of events and their graph, and table functions over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from ..functions import expr as X
from ..operators import temporal_graph
from ..operators.entity_graph import CONCEPTS, TECHNOLOGIES


@arrow_udtf(returnType="id string, name string, type string")
class EntitiesOf:
    """entities_of(table(select id, text from ...)): the technologies and concepts that each text contains in any case."""

    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for kind, names in (("technology", TECHNOLOGIES), ("concept", CONCEPTS)):
            for n in names:
                self.found.add_word(n, (n, kind))
        self.found.make_automaton()

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs = zip(texts.column(0).to_pylist(), texts.column(1).to_pylist(), strict=True)
        rows = [(str(i), *x) for i, t in pairs if t for x in sorted({v for _, v in self.found.iter(t.lower())})]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "name", "type"])


#: Table functions: of a text, its words in chunks of ``most`` that share ``overlap`` with the one before; over the views
#: ``activity`` and ``activity_edges``, what their names say.
FUNCTIONS = {
    "chunks_of(text string, most int, overlap int)": (
        "chunk_index int, total_chunks int, chunk string",
        r"select pos, size(starts), array_join(slice(w, at + 1, most), ' ') from (select w, case when size(w) <= most then array(0) else sequence(0, size(w) - overlap - 1, most - overlap) end as starts"
        r" from (select filter(split(coalesce(text, ''), '\\s+'), x -> x <> '') as w)) lateral view posexplode(starts) as pos, at",
    ),
    "recent_activity(since timestamp, until timestamp)": (
        "id string, timestamp timestamp, line string",
        "select id, timestamp, line from activity where timestamp > since and timestamp <= until",
    ),
    "activity_session(of_id string)": (
        "id string, timestamp timestamp, session_id string, line string",
        "select a.id, a.timestamp, a.session_id, a.line from activity a join activity b on a.session_id = b.session_id where b.id = of_id",
    ),
    "activity_context(of_id string, steps int)": (
        "id string, step bigint, line string",
        "select id, step, line from (select a.id, a.line, a.place - b.place as step from activity a join activity b on a.session_id = b.session_id where b.id = of_id) where abs(step) <= steps",
    ),
    "connected_to(node string)": (
        "id string, timestamp timestamp, line string",
        "select distinct a.id, a.timestamp, a.line from activity a join activity_edges e on e.src_id = a.id where e.dst_id = node",
    ),
    "activity_hours(day date)": (
        "hour int, event_count bigint, apps array<string>",
        "select hour(timestamp), count(*), array_sort(collect_set(metadata['app_name'])) from activity where date = day group by hour(timestamp)",
    ),
    "activity_apps(since timestamp, until timestamp)": (
        "app string, event_count bigint",
        "select metadata['app_name'], count(*) from activity where timestamp > since and timestamp <= until group by metadata['app_name']",
    ),
}


def register(spark: SparkSession, events: DataFrame, keys: list[str]) -> None:
    """Make ``events`` known as the view ``activity`` (with session_id, place in the session, and line), its graph as
    ``activity_edges``, and FUNCTIONS and entities_of as table functions of the session."""
    from pyspark.sql import Window

    e = temporal_graph.with_sessions(events, keys)
    place = F.row_number().over(Window.partitionBy(*keys, "session_id").orderBy("timestamp", "id")).cast("long")
    e.withColumn("place", place).withColumn("line", X.line()).createOrReplaceTempView("activity")
    temporal_graph.edges(e, keys).createOrReplaceTempView("activity_edges")
    spark.udtf.register("entities_of", EntitiesOf)
    for head, (returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} returns table ({returns}) return {body}")
