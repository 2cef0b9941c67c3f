"""Searches of the kept index give what a scan of the texts gives."""

import random

import pytest
from pyspark.sql import functions as F

from chronolake.operators import fulltext
from chronolake.sources.textindex import BUCKETS, TextIndex

rnd = random.Random(3)
WORDS = [f"w{i}" for i in range(40)]
texts = {f"d{i:03}": " ".join(rnd.choice(WORDS[: rnd.choice((3, 10, 40))]) for _ in range(rnd.randint(0, 40))) for i in range(150)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string")


def rows(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(spark, str(tmp_path / "index"))


def test_deltas_updates_and_removals(spark, index):
    ids = sorted(texts)
    index.add(frame(spark, {i: texts[i] for i in ids[:90]}), writer="w", batch=0)
    index.add(frame(spark, {i: texts[i] for i in ids[90:]}), writer="w", batch=1)
    index.add(frame(spark, {i: texts[i] for i in ids[90:]}), writer="w", batch=1)  # runs again
    now = dict(texts)
    check = lambda: [rows(index.search(q, 12)) == rows(fulltext.bm25(frame(spark, now), q, 12)) for q in ("w1", "W0, w25 w1!", "w39 nothing", "nothing", "", "w0 w1 w2 w3 w30")]
    assert all(check())
    changed = {i: "w25 w25 w1 new" for i in ids[::7]} | {ids[1]: None, "d999": "w25 once"}
    now |= changed
    index.add(frame(spark, changed))
    assert all(check())
    index.remove(frame(spark, {ids[2]: "", ids[0]: "", "unknown": ""}).select("id"))
    now = {i: t for i, t in now.items() if i not in (ids[0], ids[2])}
    assert all(check()) and index.read("totals").agg(F.sum("n")).first()[0] == len(now)
    index.refold()
    index.vacuum()
    assert all(check()) and index.raw("postings").count() == index.postings().count() and index.raw("gone").count() == 0
    index.add(frame(spark, {ids[0]: "w25 back"}))
    now[ids[0]] = "w25 back"
    assert all(check())


def test_only_the_folders_of_the_terms_are_read(spark, index, monkeypatch):
    index.add(frame(spark, texts))
    seen = []
    own = TextIndex.raw
    monkeypatch.setattr(TextIndex, "raw", lambda self, table, parts=None: seen.append((table, None if parts is None else list(parts))) or own(self, table, seen[-1][1]))
    files = index.search("w1 w2", 5).inputFiles()
    assert {len(p) for t, p in seen if t == "postings"} <= {1, 2} and "docs" not in {t for t, _ in seen}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files if "bucket=" in f}) <= 2 < BUCKETS


def test_common_terms_count_only_where_a_rare_one_is(spark, index):
    docs = {f"c{i:04}": "common " * (1 + i % 3) + f"x{i}" for i in range(1200)} | {f"r{i}": "rare rare rare common" for i in range(30)}
    index.add(frame(spark, docs))
    plan = index.search("common rare", 20)
    assert rows(plan) == rows(fulltext.bm25(frame(spark, docs), "common rare", 20))
    assert "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert rows(index.search("common rare", 40)) == rows(fulltext.bm25(frame(spark, docs), "common rare", 40))


def test_scores_are_rounded_before_they_are_ordered_and_cut(spark, duck, index):
    """In the SQL ``order by score`` means the rounded column that it selects; a null text is not in its average length."""
    from chronolake.queries import ORACLE_SQL, SEARCH

    docs = [(i, "the" + " zz" * (90 - i)) for i in range(60)] + [(i, "re" + " zz" * i) for i in range(100, 105)] + [(i, None) for i in range(900, 920)] + [(990, "")]
    f = spark.createDataFrame([(str(i), t) for i, t in docs], "id string, text string")
    index.add(f)
    cur = duck.cursor()
    cur.execute("create temp table documents (doc_id bigint, text varchar)")
    cur.executemany("insert into documents values (?, ?)", docs)
    want = cur.execute(ORACLE_SQL["x3_bm25"]).fetchall()
    assert len({s for _, s in want}) < 40  # ties
    for df in (index.search(SEARCH, 40, digits=6), fulltext.bm25(f, SEARCH, 40, digits=6)):
        assert [(r.id, round(r.score, 6)) for r in df.collect()] == want


def test_a_text_is_cut_once_and_its_terms_travel_once(spark, index, monkeypatch):
    """One shuffle, by folder; the lengths come from what is written. Terms are those of ``tokens``, in slices of any size."""
    from chronolake.sources import textindex

    odd = {"a": "Ünder_score X1 ÄÖ x1, a b cc", "b": None, "c": "", "d": "  ...  ", "e": "é à Ωmega ωMEGA 42 4", "f": "cc " * 5000}
    monkeypatch.setattr(textindex, "SLICE", 8)
    plans, own = {}, TextIndex.append

    def append(self, table, rows, version):
        plans.setdefault(table, rows._jdf.queryExecution().executedPlan().toString())
        own(self, table, rows, version)

    monkeypatch.setattr(TextIndex, "append", append)
    index.add(frame(spark, odd | texts))
    assert plans["postings"].count("Exchange hashpartitioning") == 1 and plans["postings"].count("MapInArrow") == 1
    assert all("MapInArrow" not in plans[t] and "split" not in plans[t] for t in ("docs", "totals"))
    want = {tuple(r) for r in fulltext.postings(frame(spark, odd | texts)).select("term", "id", "tf", "dl").collect()}
    assert {tuple(r) for r in index.postings().collect()} == want
    assert {r.id: r.dl for r in index.read("docs").collect() if r.id in odd} == {"a": 6, "b": -1, "c": 0, "d": 0, "e": 3, "f": 5000}


def test_an_id_given_twice_has_the_terms_of_both_texts(spark, index):
    index.add(spark.createDataFrame([("a", "one two two"), ("a", "two three"), ("b", "two")], "id string, text string"))
    assert {(r.term, r.id, r.tf) for r in index.postings().collect()} == {("one", "a", 1), ("two", "a", 3), ("three", "a", 1), ("two", "b", 1)}


def test_postings_are_written_as_blocks_sorted_once(spark, index, monkeypatch):
    """A delta's postings are not sorted themselves: one sort, of blocks, whose order the writer takes as it is."""
    jobs = spark._jsparkSession.sharedState().statusStore()
    n = jobs.executionsCount()
    index.add(frame(spark, texts))
    index.refold()
    plans = [jobs.executionsList(n, 1000).apply(i).physicalPlanDescription().split("== Initial Plan ==")[0] for i in range(jobs.executionsList(n, 1000).size())]
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and "MapInArrow" in p]
    assert len(writes) == 2
    tree = writes[0].split("\n\n\n")[0]
    assert tree.count(" Sort (") == 1 and "Generate" not in tree
    assert sorted(rows(index.search("w1 w2", 200))) == sorted(rows(fulltext.bm25(frame(spark, texts), "w1 w2", 200)))
    stored = spark.read.parquet(f"{index.path}/postings")
    assert 0 < stored.filter(F.col("_version") == 2).count() < index.postings().count()


def test_words_are_those_of_tokens(spark):
    """Cut at bytes first, and at other characters' classes only where words differ."""
    import pyarrow as pa

    from chronolake.functions.expr import tokens
    from chronolake.sources.textindex import _words

    some = ["a", "bc", "Z9", " ", "_", "\n", "\0", "-", "é", "Ωm", "“", "”", "\u00a0", "…", "中文", "٣٤", "½x", "🙂", "e\u0301", "\u200b"]
    odd = ["", " ", "a", "ab", "“ab”cd", "…", "ab\u00a0cd ef", "x"] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    lower = [r[0] for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(F.lower("t")).collect()]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(tokens("t")).collect()]
    for a, b in ((0, len(odd)), (5, 40), (1, 2), (0, 1)):
        terms, term, row = _words(pa.array(lower, pa.large_string()).slice(a, b - a))
        got = [[] for _ in range(b - a)]
        for t, r in zip(terms.take(pa.array(term)).to_pylist(), row.tolist(), strict=True):
            got[r].append(t)
        assert got == want[a:b]


def test_what_is_not_there_is_read_without_tasks(spark, index):
    assert "LocalRelation <empty>" in index.raw("docs")._jdf.queryExecution().optimizedPlan().toString()
    assert [(f.name, f.dataType) for f in index.raw("docs").schema] == [(f.name, f.dataType) for f in index.SCHEMAS["docs"]] + [("_version", index.raw("gone").schema["_version"].dataType)]
    assert index.raw("docs").count() == index.postings().count() == 0
