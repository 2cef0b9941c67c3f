"""Hard negatives, spelling variants and lattice hashing against brute force, and on odd rows."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from compare import rows_of  # noqa: E402

from chronolake.llm import lattice, negatives, registry, spelling  # noqa: E402

rnd = random.Random(5)
CLASH = "vec_id long, label int, v array<long>, dim int, c int, grp long, n long, score double, rep long, part int, `_gone_vec_id` int"


def table_of(spark, rows, schema=CLASH):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5.0, 6, 7, 8) for r in rows], schema)


# hard negatives


def negatives_of(rows, k=5, positives=5):
    own = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and None not in v:
            own[i] = min(own.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (la, va) in own.items():
        if a % 10:
            continue
        s = sorted((-dot(va, v), i, label) for i, (label, v) in own.items() if i != a and len(v) == len(va))
        for ps, p, _ in [x for x in s if x[2] == la][:positives]:
            fit = [x for x in s if x[2] != la and 80 * -ps <= 100 * -x[0] <= 100 * -ps]
            out += [(a, p, r + 1, i, -ps, -ns) for r, (ns, i, _) in enumerate(fit[:k])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_like_brute_force(spark):
    rows = [(i, rnd.randrange(3), [rnd.randint(-3, 9) for _ in range(70)]) for i in range(150)]
    rows += [(1000 + i, 1, rows[i % 5][2]) for i in range(60)]  # a hot label of equal vectors: ties everywhere
    got = mined(table_of(spark, rows))
    assert got == negatives_of(rows) and len(got) > 100


def test_hard_negatives_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ROWS", 8)
    monkeypatch.setattr(negatives, "WIDTH", 4)
    rows = [(i, i % 2, [rnd.randint(0, 5) for _ in range(10)]) for i in range(120)]
    assert mined(table_of(spark, rows), k=3, positives=2) == negatives_of(rows, 3, 2)


def test_hard_negatives_beyond_exact_doubles(spark):
    rows = [(i, i % 2, [10**7 * rnd.randint(1, 40) + rnd.randint(0, 9) for _ in range(6)]) for i in range(60)]
    assert mined(table_of(spark, rows)) == negatives_of(rows)


def test_hard_negatives_of_odd_rows(spark):
    v = [3, 1, 2]
    rows = [(0, 1, v), (1, 1, v), (2, 2, v), (2, 2, v), (2, 3, [9, 9, 9]), (None, 2, v), (3, None, v), (4, 2, None), (5, 2, [1, None, 2]), (6, 2, []), (7, 2, [3, 1]), (10, 7, [5, 5]), (20, 8, [-1, -1, -1]), (21, 8, [1, 1, 1]), (30, 9, [0, 0, 0]), (31, 9, [0, 0, 0])]
    got = mined(table_of(spark, rows))
    assert got == negatives_of(rows) and (0, 1, 1, 2, 14, 14) in got and not any(r[0] in (10, 20) for r in got) and any(r[0] == 30 for r in got)
    assert mined(table_of(spark, [])) == []


def test_products_are_whole_numbers():
    a = np.array([[2**40, 1], [3, -(2**41)]])
    assert (negatives.product(a, a) == a @ a.T).all() and negatives.product(a, a).dtype == np.int64
    assert negatives._narrow(np.array([127, -128])) == 1 and negatives._narrow(np.array([128])) == 2 and negatives._narrow(np.array([2**31])) == 8


def test_best_of_ties():
    keep = negatives.best(np.array([0, 0, 0, 1]), np.array([2, 0, 1, 0]), np.array([5, 5, 7, 1]), np.array([10, 20, 30]), 2)
    assert sorted(keep.tolist()) == [1, 2, 3]


# spelling variants


def counted(rows):
    c = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: k for w, k in c.items() if len(w) >= 5 and k >= 3}


def spelled(n):
    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    of = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in of.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(of[w]), n.get(form.get(w), 0)) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def words_like(w, k):
    out = {w}
    while len(out) < k:
        x = list(rnd.choice(sorted(out)))
        i = rnd.randrange(len(x))
        x[i : i + rnd.choice((0, 1, 1))] = rnd.choice("abeé")
        out.add("".join(x))
    return sorted(out)


def test_variants_like_brute_force(docs):
    vocab = [w for base in ("banana", "aaaaaa", "strasse", "élève", "colour") for w in words_like(base, 25)]
    rows = [(i, " ".join(rnd.choice(vocab[: rnd.choice((5, 30, 125))]) for _ in range(60))) for i in range(60)]
    rows += [(None, "Banana BANANA banana"), (61, None), (62, ""), (63, "12 !! 4"), (63, "banana banana"), (63, "banana banana"), (64, "Ünder×under÷UNDER naïveĀnaïve x" * 3)]
    n = counted(rows)
    got = found(spelling.spelling_variants(docs(rows)))
    assert got == spelled(n) and sum(r[1] != "" for r in got) > 10 and any(r[1] != r[2] != r[0] for r in got if r[1])


def test_variants_of_long_words_and_texts(docs):
    long = "abcde" * 300_000  # one run of 1.5 million letters, longer than PIECE
    rows = [(i, f"{long}x {long}") for i in range(6)] + [(7, ("words and other words " * 100_000))]
    n = counted(rows)
    got = found(spelling.spelling_variants(docs(rows)))
    assert {(r[0], r[3]) for r in got} == set(n.items())
    assert {r[0]: r[4] for r in got}[long] == sum(w in n for w in (long + "x", long[1:], long[:-1]))


def test_no_words(docs):
    assert found(spelling.spelling_variants(docs([]))) == [] and found(spelling.spelling_variants(docs([(1, None), (2, "a b c")]))) == []


def test_chains_of_forms(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    n = {w: 3 * 2**i for i, w in enumerate(chain)} | {"zzzzz": 4, "zzzzy": 7, "zzzzx": 8}
    got = found(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == spelled(n) and {r[0]: r[2] for r in got}["abcde"] == chain[-1]
    with pytest.raises(ValueError, match="2 at least"):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_keys_of_a_word_in_pieces(monkeypatch):
    def keys(words):
        t = pa.RecordBatch.from_pydict({"wid": pa.array(range(len(words)), pa.int64()), "word": words})
        return sorted(tuple(r.values()) for b in spelling._keys([t]) for r in b.to_pylist())

    words = ["aabbccddeeffgghhiij" * 20, "short", "x", "aaaa"]
    want = keys(words)
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert keys(words) == want


def test_one_key_for_all_still_finds_only_what_shares_a_place():
    t = pa.table({"key": [1] * 6, "wid": [0, 1, 2, 0, 1, 2], "place": [-1, -1, -1, 0, 0, 0], "last": [True, True, True, True, False, True]})
    got = [tuple(r.values()) for b in spelling._pairs(t) for r in b.to_pylist()]
    assert {(a, b) for a, b, _, kind in got if kind == 1} == {(0, 1), (1, 2), (0, 2)} and all(last != 1 for last, _, _, kind in got if kind == 0)


def test_checksums_like_zlib():
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(5000)), np.uint8)
    start = np.array([rnd.randrange(4000) for _ in range(300)])
    end = start + np.array([rnd.choice((1, 2, 7, 63, 64, 65, 400)) for _ in range(300)])
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(x)) for s, e, x in zip(start, end, state, strict=True)]
    assert spelling.checksums(data, start, end, state).tolist() == want


# lattice hashing


def links_of(rows, threshold=0.9):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links, root = Counter(), {k: rows[k][0] for k in ok}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, _ in pairs:
        links[a] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    out = []
    for k, (i, _) in enumerate(rows):
        c = root.get(k, i)
        out.append((str(i), links[k], str(c), None if i is None else c == i))
    return sorted(out, key=str)


def linked(df, **more):
    return sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.similar_vectors(df, **more).collect()), key=str)


FLOATS = CLASH.replace("array<long>", "array<float>")


def float32(v):
    return [float(x) for x in np.asarray(v, np.float32)]


def near_vectors(n, dim, noise, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    return [float32(base[i % len(base)] + noise * rng.normal(size=dim)) for i in range(n)]


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_links_like_brute_force(spark, dim):
    vs = near_vectors(180, dim, 0.12)
    rows = [(7 * i % 1000, v) for i, v in enumerate(vs)] + [(2000 + i, vs[0]) for i in range(30)]
    got = linked(table_of(spark, [(i, None, v) for i, v in rows], FLOATS))
    assert got == links_of(rows) and sum(r[1] for r in got) > 500


def test_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rows = list(enumerate(near_vectors(12, 32, 0.1) * 1 + [float32(np.ones(32) + 0.1 * np.random.default_rng(i).normal(size=32)) for i in range(90)]))
    assert linked(table_of(spark, [(i, None, v) for i, v in rows], FLOATS)) == links_of(rows)


def test_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (2, [-1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (None, v), (None, None), (9, [1.0, 2.0]), (10, [1e30, 2e30, 3e30]), (11, [1e-38, 2e-38, 3e-38]), (12, [0.0, -0.0, 5.0]), (13, [-0.0, 0.0, 5.0])]
    schema = CLASH.replace("array<long>", "array<double>")
    got = linked(table_of(spark, [(i, None, v) for i, v in rows], schema))
    assert got == links_of(rows)
    assert linked(table_of(spark, [], FLOATS)) == []
    kept = lattice.one_of_each_vector(table_of(spark, [(i, None, v) for i, v in rows], schema))
    assert len(kept.columns) == 11 and sorted(str(r.vec_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in (2, 10, 11, 13))


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    for cosine, least, most in ((0.902, 0.97, 1), (0.95, 0.999, 1), (0.898, 0, 0)):
        both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * z])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, v array<double>")
        found = lattice.similar_vectors(df).agg(F.sum("n_links")).head()[0] / len(both)
        assert least <= found <= most


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(2000, 8)) * 3
    p = lattice.decode(y)
    assert ((p % 2 == p[:, :1] % 2).all(1)).all() and (p.sum(1) % 4 == 0).all()
    d = ((2 * y - p) ** 2).sum(1)
    assert (d <= 4 + 1e-9).all()  # the covering radius is 1
    for v in lattice.NEAR:
        assert (((2 * y - p - v) ** 2).sum(1) >= d - 1e-9).all()
    assert len({tuple(v) for v in lattice.NEAR.tolist()}) == 240 and ((lattice.NEAR**2).sum(1) == 8).all()


def test_shape_follows_the_number_of_vectors():
    blocks, tables = zip(*(lattice.shape(10**k) for k in range(1, 10)), strict=True)
    assert list(blocks) == sorted(blocks) and list(tables) == sorted(tables) and blocks[-1] > blocks[0]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_lattice_dedup"])
def test_queries_give_the_rows_of_their_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    cur = duck.execute(registry.ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_spelling_query_like_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = found(registry.QUERIES["op12_spelling_variants"](spark, data))
    n = counted(rows)
    # all pairs are too many here; a word's near words are its edits that are words
    def near(w):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for x in letters}
        return {v for v in edits if v in n and v != w}

    letters = sorted({x for w in n for x in w})
    assert {(r[0], r[3], r[4]) for r in got} == {(w, k, len(near(w))) for w, k in n.items()}
