"""The text operators against brute force, and on rows that are null, empty, very long, tied, repeated or absent."""

import inspect
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import naive  # noqa: E402

from chronolake.llm import language, leaks, licences, lines, mixing, near, registry, substrings, tokens, toxicity, vectors  # noqa: E402

rnd = random.Random(7)
VOCAB = ["".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
prose = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))


def edited(t, n):
    w = t.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
    return " ".join(w)


BASE = [prose(rnd.randint(20, 120)) for _ in range(12)]
PASSAGE = "\n".join(prose(20) for _ in range(4))
LONG = "\n".join(prose(30) for _ in range(900))
UGLY = [
    *BASE, BASE[0], BASE[0], BASE[0].upper(), *(edited(BASE[i % 4], i % 5) for i in range(20)), None, "", "   \n\t ", "one", "one", "a b c d", "x" * 5000, "é" * 300, LONG, LONG + " end",
    *(f"{prose(15)}\n{PASSAGE}\n{prose(15)}" for _ in range(6)), PASSAGE, "same same same " * 60, "naïve ☃ " * 40, "\n\n\n" + PASSAGE + "\n\n", "tab\there\r\nand\x0bthere \x00 nul",
]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ugly(docs):
    order = list(range(len(UGLY)))
    random.Random(1).shuffle(order)
    return docs([(10 * i + 3, UGLY[o], None if o % 9 == 0 else f"s{o % 4}") for i, o in enumerate(order)]).cache()


@pytest.fixture(scope="module")
def odd(docs):
    """Rows that repeat whole, and null ids."""
    return docs([(1, BASE[0]), (1, BASE[0]), (2, BASE[0]), (None, BASE[1]), (None, None), (4, None)])


def test_jaccard_like_brute_force(ugly):
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in near.similar(ugly).collect()}
    assert got == naive.classes(rows(ugly))


def test_jaccard_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    base = prose(200)
    d = docs([(i, edited(base, i % 8)) for i in range(60)])
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in near.similar(d).collect()}
    assert got == naive.classes(rows(d))


def test_jaccard_of_long_texts_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 500)
    base = prose(200)
    d = docs([(i, edited(base, i % 8)) for i in range(40)])
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in near.similar(d).collect()}
    assert got == naive.classes(rows(d))


def test_jaccard_of_repeated_rows(docs):
    a, b, near_a = prose(80), prose(80), None
    near_a = " ".join([*a.split()[:-1], "other"])
    own = [(1, a), (1, a), (2, near_a), (2, b), (3, b), (3, None), (4, ""), (4, ""), (None, a), (5, a.upper()), (5, a)]
    got = sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in near.similar(docs(own)).filter("doc_id is not null").collect())
    # a: two rows of 1, two of 5; near_a: one; b: two
    assert got == sorted([(1, 1, 4, 4), (1, 1, 4, 4), (2, 1, 1, 4), (2, 2, 2, 1), (3, 2, 2, 1), (3, 3, 1, 0), (4, 4, 1, 0), (4, 4, 1, 0), (5, 1, 4, 4), (5, 1, 4, 4)])
    kept = sorted((str(i), str(t)) for i, t in rows(near.one_of_each(docs(own))))
    assert kept == sorted((str(i), str(t)) for i, t in [(1, a), (2, b), (3, None), (4, ""), (4, ""), (None, a)])


def test_bayesian_bound():
    least = near.least_matches(0.8, 1e-5)
    assert least[0] == 0 and (np.diff(least) >= 0).all() and 50 < least[96] < 77
    assert near.shingles(np.zeros(0, np.uint64), np.zeros(3, np.int64))[0].size == 0


def test_bound_drops_no_more_than_bands_miss():
    least = near.least_matches(0.8, inspect.signature(near.similar).parameters["tolerance"].default)
    step = [math.comb(near.STEP, k) * 0.8**k * 0.2 ** (near.STEP - k) for k in range(near.STEP + 1)]
    left, dropped = np.ones(1), 0.0
    for n in range(near.STEP, near.N_HASHES + 1, near.STEP):
        left = np.convolve(left, step)
        dropped += left[: least[n]].sum()
        left[: least[n]] = 0
    assert dropped < (1 - 0.8**near.ROWS) ** (near.N_HASHES // near.ROWS)


def test_one_of_each_keeps_all_columns(ugly):
    kept = near.one_of_each(ugly)
    want = naive.classes(rows(ugly))
    assert kept.columns == ugly.columns and {r.doc_id for r in kept.collect()} == {i for i, (c, _, _) in want.items() if c == i}


def test_substrings_like_brute_force(spark, ugly):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in substrings.without_repeats(ugly).withColumn("s", F.sha2("kept", 256)).collect()}
    assert got == naive.substrings(rows(ugly))


def test_substrings_of_large_buckets(ugly, monkeypatch):
    monkeypatch.setattr(substrings, "LARGE", 1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in substrings.without_repeats(ugly).withColumn("s", F.sha2("kept", 256)).collect()}
    assert got == naive.substrings(rows(ugly))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_letters(docs, seed):
    r = random.Random(seed)
    d = docs([(i, "".join(r.choice("ab") for _ in range(r.choice([0, 99, 100, 101, 400]))) * r.randint(1, 3)) for i in range(12)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in substrings.without_repeats(d).withColumn("s", F.sha2("kept", 256)).collect()}
    assert got == naive.substrings(rows(d))


@pytest.mark.parametrize("piece", [100, 331])
def test_substrings_in_pieces(docs, ugly, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    rng = random.Random(piece)
    shared = "".join(rng.choice("abcdefgh ü") for _ in range(1500))
    d = docs([r.text for r in ugly.collect()] + [shared + "x" * 450, "y" + shared[200:], shared[:99], shared[:100], shared[700:] + shared[:801]])
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in substrings.without_repeats(d).withColumn("s", F.sha2("kept", 256)).collect()}
        assert got == naive.substrings(rows(d))
        monkeypatch.setattr(substrings, "LARGE", 1)


def test_substrings_of_a_long_text_take_bounded_memory(spark, docs):
    text = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 1 << 23)))
    pieces = substrings._pieces(docs([text, text[1000:]]).selectExpr("doc_id", "text", "0L as t", "0L as row"), "doc_id", "t", "row").toArrow()
    assert pieces.num_rows == 2 * (1 << 23) // substrings.PIECE
    tracemalloc.start()
    n = sum(b.num_rows for b in substrings._run_rows(pieces.to_batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1 << 18 and peak < 64 << 20  # at 112 bytes for each byte at once it was 900 MB
    lost = {r.doc_id: r.n_removed for r in substrings.without_repeats(docs([text, text[1000:]])).collect()}
    assert lost == {0: 0, 1: len(text) - 1000}


def test_substrings_of_repeated_rows(docs):
    lost = lambda own: sorted((x.doc_id, x.n_bytes, x.n_removed) for x in substrings.without_repeats(docs(own)).collect())
    p = " ".join(f"w{i}" for i in range(40))  # 150 bytes
    n = len(p)
    assert lost([(1, p), (2, p)]) == [(1, n, 0), (2, n, n)]
    assert lost([(1, p), (2, p), (2, p)]) == [(1, n, 0), (2, n, n), (2, n, n)]
    assert lost([(1, p), (2, p), (2, "other text")]) == [(1, n, 0), (2, 10, 0), (2, n, n)]
    assert lost([(1, p), (1, p), (3, "x" * 99)]) == [(1, n, 0), (1, n, 0), (3, 99, 0)]
    twice = p + p
    assert lost([(5, twice), (5, twice), (6, twice + "!")]) == [(5, 2 * n, n), (5, 2 * n, n), (6, 2 * n + 1, 2 * n)]


def test_substrings_of_texts_under_one_id(docs):
    """Like documents of their own, in the order of their hashes."""
    own = [(i % 3, t) for i, t in enumerate(UGLY) if t is not None]
    d = docs(own).select("doc_id", "text", F.xxhash64("text").alias("t")).distinct().orderBy("doc_id", "t").collect()
    want = naive.substrings([(k, x.text) for k, x in enumerate(d)])
    want = {(x.doc_id, x.text): want[k] for k, x in enumerate(d)}
    got = substrings.without_repeats(docs(own)).withColumn("s", F.sha2("kept", 256)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.s) for r in got) == sorted((i, *want[i, t]) for i, t in own)


def test_refined_buckets_are_the_strings():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(90, 130))) * r.randint(1, 3) for _ in range(8)] + [b"x" * 250, b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, off = substrings._strings(at)
    names = {}
    for k, x, o in zip(substrings._refined(data, at)[at[row] + off].tolist(), row.tolist(), off.tolist(), strict=True):
        names.setdefault(k, set()).add(texts[x][o : o + 100])
    assert all(len(x) == 1 for x in names.values()) and len(set().union(*names.values())) == len(names)


def test_buckets_name_equal_strings():
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    n = substrings.Buckets(data)[100]
    assert len(n) == 221 and len(set(n.tolist())) == 8


def test_line_runs_like_brute_force(ugly):
    got = {r.doc_id: r.text for r in lines.without_repeats(ugly).collect()}
    want = naive.line_runs(rows(ugly))
    assert {i: t or "" for i, t in got.items()} == want
    assert got[next(i for i, t in rows(ugly) if t is None)] is None
    assert sum(len(t or "") for _, t in rows(ugly)) > sum(map(len, want.values()))


@pytest.mark.parametrize("seed", range(4))
def test_line_runs_at_random(docs, seed):
    r = random.Random(seed)
    pool = [" ".join(f"w{i}" for _ in range(r.choice([1, 5, 20, 60]))) for i in range(6)]
    d = docs([(i, "\n".join(r.choice([*pool, "", f"own {r.random()}"]) for _ in range(r.randint(0, 12)))) for i in range(14)])
    assert {r.doc_id: r.text for r in lines.without_repeats(d).collect()} == naive.line_runs(rows(d))


def test_leaks(spark, docs):
    item = prose(40).split()
    swapped = [*item]
    for k in (3, 11, 17, 26, 33):
        swapped[k] = "zzz"
    b = spark.createDataFrame([(1, " ".join(item), 0), (2, " ".join(item[:9]) + " q1 q2", 0), (3, "too short", 0), (None, " ".join(item), 0), (4, None, 0), (1, " ".join(item), 0)], "item_id long, text string, doc_id int")
    d = docs([(1, f"{prose(30)} {' '.join(item)} {prose(30)}"), (2, " ".join(swapped)), (3, prose(200)), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(item[:9]) + " q1 q2"), (7, " ".join(item[:12])), (8, "Too SHORT")])
    got = {(r.doc_id, r.item_id): (r.matched, r.length, r.doc_word, r.item_word) for r in leaks.overlaps(d, b).collect()}
    assert got[1, 1] == (40, 40, 30, 0) and got[2, 1] == (35, 40, 0, 0) and got[6, 2] == (11, 11, 0, 0)
    assert {i for i, _ in got} == {1, 2, 6}
    assert {r.doc_id for r in leaks.clean(d, b).collect()} == {3, 4, 5, 7, 8, None} and leaks.clean(d, b).columns == d.columns
    assert leaks.overlaps(d, b.limit(0)).count() == 0 and leaks.overlaps(d.limit(0), b).count() == 0


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.25, 0.4])
def test_leak_stretches_like_brute_force(rate):
    r = np.random.default_rng(int(100 * rate))
    for size in r.integers(1, 90, 60).tolist():
        eq, least = r.random(size) >= rate, min(13, size)
        fit = [(int(eq[i:j].sum()), i - j, -i) for i in range(size) for j in range(i + 1, size + 1) if eq[i:j].sum() >= least and 5 * eq[i:j].sum() >= 4 * (j - i)]
        n, length, begin = max(fit, default=(0, 0, 0))
        assert leaks._verify(eq, least, Fraction(4, 5)) == ((n, -begin, -begin - length) if fit else None)


def test_leak_beside_weaker_words(spark, docs):
    item = [f"w{i}" for i in range(120)]
    own = [x if i < 20 or i % 4 else f"z{i}" for i, x in enumerate(item)]
    got = leaks.overlaps(docs([(1, " ".join(own))]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]
    assert got[0].matched >= 20 and got[0].matched >= 0.8 * got[0].length


def test_leaks_found_whatever_is_substituted(spark, docs):
    r, rate, items, texts = np.random.default_rng(5), 0.2, [], []
    for i in range(300):
        size = int(r.integers(8, 26))
        item = [f"w{i}x{j}" for j in range(size)]
        items.append((i, " ".join(item)))
        texts.append((i, [x if r.random() >= (rate if size > 12 else 0.02) else "zzz" for x in item]))
    want = set()
    for (i, own), (_, text) in zip(texts, items, strict=True):
        eq = [a == b for a, b in zip(own, text.split(), strict=True)]
        spans = [(sum(eq[x:y]), y - x) for x in range(len(eq)) for y in range(x + 1, len(eq) + 1)]
        if any(n >= min(13, len(eq)) and 5 * n >= 4 * length for n, length in spans):
            want.add((i, i))
    got = leaks.overlaps(docs([(i, f"{prose(5)} {' '.join(own)} {prose(5)}") for i, own in texts]), spark.createDataFrame(items, "item_id long, text string"))
    assert 100 < len(want) < 300 and {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_line_runs_of_repeated_rows(docs):
    lost = lambda own: sorted((x.doc_id, x.text, x.n_removed) for x in lines.without_repeats(docs(own)).collect())
    p = PASSAGE
    assert lost([(1, p), (2, p)]) == [(1, p, 0), (2, "", 4)]
    assert lost([(1, p), (2, p), (2, p)]) == [(1, p, 0), (2, "", 4), (2, "", 4)]
    assert lost([(1, p), (2, p), (2, "other text")]) == [(1, p, 0), (2, "", 4), (2, "other text", 0)]
    assert lost([(1, p), (1, p), (3, "x")]) == [(1, p, 0), (1, p, 0), (3, "x", 0)]
    one, two = lost([(1, p), (1, p + "\nmore")])
    assert sorted((one[2], two[2])) == [0, 4]
    assert lost([(1, p + "\n" + p), (1, p + "\n" + p)]) == [(1, p, 4), (1, p, 4)]


def test_line_runs_in_parts(docs, monkeypatch):
    monkeypatch.setattr(lines, "TOGETHER", 7)
    r = random.Random(5)
    pool = [" ".join(f"w{i}" for _ in range(r.choice([1, 2, 9, 20]))) for i in range(5)]
    d = docs([(i, "\n".join(r.choice([*pool, "own line"]) for _ in range(r.randint(0, 90)))) for i in range(8)])
    assert {x.doc_id: x.text for x in lines.without_repeats(d).collect()} == naive.line_runs(rows(d))


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_leaks_like_brute_force(spark, docs, monkeypatch, sent):
    """Broadcast and joined; repeated ids with equal and with other texts on both sides, common words, long items, ties."""
    monkeypatch.setattr(leaks, "SENT_BYTES", sent)
    monkeypatch.setattr(leaks, "HITS", 50)
    monkeypatch.setattr(leaks, "CELLS", 300)
    r = random.Random(11)
    few = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, edited(prose(r.randint(5, 40)), 0)) for i in range(8)] + [(1, few(20)), (8, few(14)), (9, "same " * 30), (9, "same " * 30 + "other"), (9, "same " * 30), (None, prose(20)), (10, None), (11, "")]
    own = [(i, f"{prose(r.randint(0, 9))} {edited(t or 'x', r.randint(0, 4))} {prose(r.randint(0, 9))}") for i, (_, t) in enumerate(items)]
    own += [(0, "again " + items[3][1]), own[1], own[1], (20, "same " * 70), (21, few(60)), (22, few(9) + " " + items[4][1]), (None, items[2][1]), (23, None), (24, "")]
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    d = docs(own)
    got = sorted((x.doc_id, x.item_id, x.matched, x.length, x.doc_word, x.item_word) for x in leaks.overlaps(d, b).collect())
    want = naive.leaks(own, items)
    assert got == sorted((i, m, *want[i, t, m]) for i, t in own for m in {x for x, _ in items} if (i, t, m) in want)
    kept = leaks.clean(d, b)
    assert kept.columns == d.columns
    gone = {(i, t) for i, t, _ in want}
    assert sorted(map(str, rows(kept))) == sorted(str(x) for x in own if x not in gone)
    assert leaks.overlaps(d.limit(0), b).count() == 0 and leaks.overlaps(d, b.limit(0)).count() == 0


def test_every_stretch_has_a_seed():
    assert leaks.unseeded(leaks.MASKS, leaks.LEAST, Fraction(4, 5)) is None
    assert leaks.unseeded(leaks.MASKS[:-1], leaks.LEAST, Fraction(4, 5)) == 20
    for least, share in ((5, Fraction(9, 10)), (6, Fraction(2, 3))):
        assert leaks.unseeded(leaks._masks(least, share), least, share) is None
    assert min(m[-1] for m in leaks.MASKS) < leaks.SHORTEST


def test_leaks_of_one_repeated_word():
    import tracemalloc

    index = leaks.Index([7], ["same " * 100 + "other"], leaks.MASKS)
    h, _, _, first = next((leaks.words(data, at) for _, _, data, at in leaks.pieces(leaks.pa.array(["same " * 100_000]))))
    tracemalloc.start()
    assert leaks._stretches(index, h, first, 13, Fraction(4, 5)) == {(0, 7): (100, -100, 0, 0, 0)}
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_toxicity(spark, docs):
    bad = ["vilefool", "vilescum", "rotten"]
    made = [(i, prose(rnd.randint(5, 60)) + (f" {rnd.choice(bad)}" if i % 8 == 0 else "")) for i in range(800)]
    d = docs([*made, (900, None), (901, ""), (902, "vilefools are new"), (903, prose(5000)), (None, "rotten")])
    y = spark.createDataFrame([(i, int(i % 8 == 0), 1) for i in range(600)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, score int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == 805
    hit = sum(got[i].predicted == int(i % 8 == 0) for i in range(800))
    assert hit >= 790 and got[901].score == got[900].score and not got[900].predicted and got[902].predicted and not got[903].predicted
    assert {r.doc_id for r in toxicity.harmless(d, y).collect()} == {i for i, r in got.items() if not r.predicted}
    again = {r.doc_id: r.score for r in toxicity.toxicity(d, y).collect()}
    assert again == {i: r.score for i, r in got.items()}
    none = toxicity.toxicity(d, y.limit(0))
    assert none.filter("score <> 0 or predicted <> 0").count() == 0 and toxicity.toxicity(d.limit(0), y).count() == 0


def test_toxicity_of_repeated_ids(spark, docs):
    d = docs([(i % 4, prose(20) + (" vilefool" if i % 4 == 0 else "")) for i in range(400)] + [(i, prose(9)) for i in range(4, 60)])
    y = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (3, 0)] + [(i, 0) for i in range(4, 60)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, y).collect()
    assert len(got) == 456
    # the one toxic id counts once, however many rows have it: nothing occurs three times among the toxic, no feature is chosen
    assert len({r.score for r in got}) == 1 and 0 < got[0].score < 1


def test_toxicity_never_reads_held_out_labels(spark, docs):
    d = docs([(i, prose(20) + (" vilefool" if i % 4 == 0 else "")) for i in range(300)])
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    flipped = y.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda labels: {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    assert score(y) == score(flipped)


def plain_features(text):
    """Words and word beginnings of a text, each once."""
    found = set()
    for w in re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        found |= {(None, w)} | {(k, w[:k]) for k in toxicity.PREFIXES if len(w) >= k}
    return found


def test_toxicity_features_and_scores_like_brute_force():
    texts = [prose(rnd.randint(0, 40)) + " Ünder_score X1 ÄÖ" * (i % 3) for i in range(28)] + ["", "A a"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    f, row = toxicity._distinct(data, at)
    plain = [plain_features(t) for t in texts]
    assert np.bincount(row, minlength=30).tolist() == [len(x) for x in plain]
    h, of = toxicity.features(data, at)
    hashes = [set(h[of == i].tolist()) for i in range(30)]
    for x in set().union(*plain):  # a hash that all rows with the feature have, and no other row has
        own = set.intersection(*(hashes[i] for i in range(30) if x in plain[i]))
        assert own.difference(*(hashes[i] for i in range(30) if x not in plain[i]))
    chosen = np.unique(f)[::3]
    w = np.zeros(toxicity.MOST_FEATURES + 1)
    w[: len(chosen)], w[-1] = np.linspace(-1, 1, len(chosen)), -0.5
    got = toxicity.Scorer(chosen, w).score(data, at)
    weight = dict(zip(chosen.tolist(), w.tolist(), strict=False))
    for i in range(30):
        z = -0.5 + sum(weight.get(b, 0.0) for b in f[row == i].tolist())
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_risk_like_brute_force(prior):
    """Weights against steps along slopes of the risk that are measured, not derived, on 30 rows."""
    r = np.random.default_rng(5)
    n, k, rounds, decay = 30, 3, 40, 2e-4
    toxic = np.arange(n) < 8
    x = r.random((n, k)) < np.where(toxic[:, None], [0.9, 0.3, 0.5], [0.3, 0.5, 0.5])
    loss = lambda z: math.log1p(math.exp(z))
    score = lambda w, i: w[k] + sum(w[j] for j in range(k) if x[i, j])
    mean = lambda values: sum(values) / len(values)
    yes, rest = np.flatnonzero(toxic).tolist(), np.flatnonzero(~toxic).tolist()
    below = 0

    def negative(w):
        return mean([loss(score(w, i)) for i in rest]) - prior * mean([loss(score(w, i)) for i in yes])

    def slope(fn, w):
        e = 1e-5
        return [(fn([*w[:j], w[j] + e, *w[j + 1 :]]) - fn([*w[:j], w[j] - e, *w[j + 1 :]])) / (2 * e) for j in range(k + 1)]

    w, m, v, total = [0.0] * k + [math.log(prior / (1 - prior))], [0.0] * (k + 1), [0.0] * (k + 1), [0.0] * (k + 1)
    for t in range(1, rounds + 1):
        if negative(w) >= 0:
            g = slope(lambda w: prior * mean([loss(-score(w, i)) for i in yes]) + negative(w), w)
        else:
            below += 1
            g = slope(lambda w: -negative(w), w)
        for j in range(k + 1):
            s = g[j] + (decay * w[j] if j < k else 0.0)
            m[j], v[j] = 0.9 * m[j] + 0.1 * s, 0.999 * v[j] + 0.001 * s * s
            w[j] -= 0.1 / math.sqrt(1 + t / 30) * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            total[j] += w[j] if 2 * t > rounds else 0.0
    row, col = np.nonzero(x)
    got = toxicity.fit(row, col, n, k, toxic, prior, rounds, decay)
    assert np.allclose(got[:k], np.array(total[:k]) / (rounds - rounds // 2), atol=1e-4)
    assert abs(mean([1 / (1 + math.exp(-score(got, i))) for i in rest]) - prior) < 1e-6
    assert below or prior < 0.5


def test_risk_stays_non_negative():
    w = toxicity.fit(np.arange(10), np.zeros(10, np.int64), 40, 1, np.arange(40) < 10, 0.2)
    assert w[0] > 0 and np.isfinite(w).all()


def test_top_k_like_brute_force(spark):
    r = np.random.default_rng(2)
    v = {i: r.integers(-60, 60, 6).tolist() for i in range(130)} | {i: [1, 2, 3, 4, 5, 6] for i in range(130, 150)} | {i: [i] for i in range(150, 153)} | {200: [10**8] * 6, 201: [-(10**8)] * 6}
    bad = [(300, None), (301, [1, None, 2, 3, 4, 5]), (None, [1] * 6), (302, []), (5, v[5]), (10, [999] * 6), (400, [3, 1]), (400, [2, 9]), (405, [7, 7])]
    v |= {10: min(v[10], [999] * 6), 400: [2, 9], 405: [7, 7]}
    t = spark.createDataFrame([(*x, 1.0, 2) for x in [*v.items(), *bad]], "vec_id long, v array<long>, score double, dim int")
    got = {}
    for x in vectors.top_k(t, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = {q: s for q, s in naive.top(v, [i for i in v if i % 5 == 0], 5).items() if s}
    assert got == want
    assert vectors.top_k(t.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    r = np.random.default_rng(3)
    v = {i: r.integers(-60, 60, 5).tolist() for i in range(100)}
    t = spark.createDataFrame(list(v.items()), "vec_id long, v array<long>")
    got = {}
    for x in vectors.top_k(t, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert got == naive.top(v, range(0, 100, 5), 5)


def test_top_k_ties_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    v = {i: [i % 3, 1, -(i % 2)] for i in range(90)} | {i: [2**30 + i % 2, -(2**30), 3] for i in range(90, 100)}
    got = {}
    for x in vectors.top_k(spark.createDataFrame(list(v.items()), "vec_id long, v array<long>"), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert got == naive.top(v, range(0, 100, 10), 5)


def test_top_k_of_many_equal_vectors(spark):
    v = {i: [3, 4, -5] if i % 3 else [i % 7, 1, 2] for i in range(400)}
    t = spark.createDataFrame(list(v.items()), "vec_id long, v array<long>")
    got = {}
    for x in vectors.top_k(t, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert got == naive.top(v, range(0, 400, 10), 5)
    first, rest = vectors._reads(vectors._file(t, F.col("vec_id") % 10 == 0), 5)
    assert first.count() + rest.count() <= 40 * 60


def test_cells_pack():
    r = np.random.default_rng(1)
    for dim in (1, 3, 8, 65):
        c = r.integers(0, 1 << vectors.BITS, (7, dim))
        assert (vectors._unpack(vectors._pack(c), dim) == c).all()


def test_few_exact_vectors_are_read(spark):
    """On unit vectors of 64 random components, which lie almost as far from each other as can be."""
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    t = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, v array<long>")
    first, rest = vectors._reads(vectors._file(t, F.col("vec_id") % 50 == 0), 5)
    assert first.count() + rest.count() < 0.03 * 2000 * 40


def test_licences(docs):
    mit = [licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")]
    wrapped = "# " + " ".join(mit).replace(" of ", " of\n# ")
    d = docs([(1, f"text. {licences.SENTENCES['apache-named']}\nmore"), (2, wrapped), (3, "We say: licensed under the apache license version 2.0 or later is nice"), (4, None), (5, ""), (6, f"{mit[0]} Something between. {mit[1]}"), (None, "RELEASED under the MIT license!")])
    got = sorted((str(r.doc_id), r.licence, r.sentences, r.begin) for r in licences.scan(d).collect())
    assert got == [("1", "Apache-2.0", 1, 6), ("2", "MIT", 4, 2), ("6", "MIT", 2, 0), ("None", "MIT", 1, 0)]
    r = licences.scan(d.filter("doc_id = 1")).first()
    assert f"text. {licences.SENTENCES['apache-named']}"[r.begin : r.end] == licences.SENTENCES["apache-named"][:-1]
    own = licences.scan(docs([(1, "One. Two. One.")]), {"a": "One.", "b": "Two."}, [("X", ("a", "b")), ("Y", ("b", "a"))])
    assert [(r.licence, r.begin, r.end) for r in own.collect()] == [("X", 0, 8)]
    assert licences.scan(d.limit(0)).count() == 0


def test_every_licence_rule_fires(docs):
    sentences, rules, names = licences._default()
    assert len({x for x, *_ in rules}) >= 90 and len({x for x, seq, *_ in rules if len(seq) > 1}) >= 20
    texts, want = [], []
    for licence, seq, *_ in rules:
        if not seq[0].startswith("named-"):
            texts.append("Some words here.\n" + "\n".join(sentences[x].replace(licences.HOLDER, "A. Holder Inc.") for x in seq) + "\nOther words.")
            want.append((licence, len(seq)))
    r = random.Random(8)
    for key, own in names.items():
        for x in own:
            texts.append(f"Some words here. {r.choice(licences.NOTICES)} {x}.\nOther words.")
            want.append((key.removeprefix("named-"), 1))
    got = {x.doc_id: (x.licence, x.sentences) for x in licences.scan(docs(texts)).collect()}
    first = {}  # of names or sentences with the same words the first counts
    for i, w in enumerate(want):
        t = tuple(naive.terms(texts[i]))
        assert got[i] == first.setdefault(t, w), (texts[i], got[i], w)
        assert got[i][1] >= w[1]
    assert len({x for x, _ in got.values()}) >= 90


def test_licences_by_brute_force(docs):
    """Sentences and rules of few words, against a plain reading of the docstring."""
    r = random.Random(3)
    sentences, names = {"a": "one two.", "b": "two.", "c": "one two three.", "d": "four, four!"}, {"n": ["five", "five six"]}
    rules = [("X", ("a", "b")), ("Y", ("b",)), ("Z", ("a", "b", "c")), ("V", ("d", "n")), ("W", ("n",))]
    texts = [" ".join(r.choice(["one", "two", "three", "four, four", "Licensed under the five", "licensed under five six", "x"]) + r.choice(["", ".", ".", ";\n", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(80)] + [None, "", "one two. " + "x " * 1500 + "two.", "one two.\n" * 3000]

    def plain(t):
        t = t or ""
        parts, at = [], 0
        for m in [*re.finditer(r"[.!?;:](?=[\s]|$)|\n", t), None]:
            parts.append((at, t[at : m.start() if m else len(t)]))
            at = m.end() if m else 0
        w = [(x.group().lower(), p + x.start(), p + x.end(), k) for k, (p, s) in enumerate(parts) for x in re.finditer(r"\w+", s)]
        known = {tuple(naive.terms(s)): k for k, s in sentences.items()}
        for x in names["n"]:
            known |= {(*naive.terms(o), *x.split()): "n" for o in licences.NOTICES}
        found = []
        for i in range(len(w)):
            if i == 0 or w[i][3] != w[i - 1][3]:
                for n in range(min(12, len(w) - i), 0, -1):
                    if (k := known.get(tuple(x[0] for x in w[i : i + n]))) and (i + n == len(w) or w[i + n][3] != w[i + n - 1][3]):
                        found.append((k, w[i][1], w[i + n - 1][2]))
                        break
        out, k = [], 0
        while k < len(found):
            for name, seq in sorted(rules, key=lambda x: -len(x[1])):
                own = found[k : k + len(seq)]
                if tuple(x[0] for x in own) == seq and all(y[1] - x[2] <= licences.GAP for x, y in zip(own[:-1], own[1:], strict=True)):
                    out.append((name, len(seq), own[0][1], own[-1][2]))
                    k += len(seq) - 1
                    break
            k += 1
        return out

    own = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    got = sorted((x.doc_id, x.licence, x.sentences, x.begin, x.end) for x in licences.scan(docs(own), sentences, rules, names).collect())
    assert got == sorted((i, *x) for i, t in own for x in plain(t)) and len(got) > 100


def test_token_counts(spark, ugly, odd):
    P = pytest.importorskip("public_tokenizers")
    T = pytest.importorskip("tokenizers").Tokenizer
    content = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    t = T.from_str(content)
    more = ["<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "aaaaaaaaaaaaaaa aaaa", "it's we'll I'D 1234567890 ½", "日本語😀😀", " \n \n\n  x", "a" * 5001]
    c = tokens.Counter(content)
    assert c.count(more) == [len(e.ids) for e in t.encode_batch(more, add_special_tokens=False)]
    for df in (ugly, odd):
        for r in tokens.token_counts(df, content).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert tokens.token_counts(odd, content).count() == 6 and tokens.token_counts(odd.limit(0), content).count() == 0


def test_long_words(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    T = pytest.importorskip("tokenizers").Tokenizer
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    t, c, r = T.from_str(content), tokens.Counter(content), random.Random(9)
    long = ["a" * 40_001, "".join(r.choice("etaoinshrdlu") for _ in range(80_000)), "ab" * 30_000 + "é" * 9000, "的一是" * 20_000]
    assert [c.merged_long(x.encode()) for x in long] == [len(t.encode(x, add_special_tokens=False).ids) for x in long] == c.count(long)
    assert not any(len(x) > tokens.SHORT for x in c.known)
    for _ in range(60):
        w = bytes(r.choice(b"aeinorst ") for _ in range(r.randint(1, 200)))
        assert c.merged_long(w) == c.merged([w])[0]


def test_other_tokenizers_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="normalizer"):
        tokens.Counter(f.read())


def test_merging_one_pair_at_a_time():
    P = pytest.importorskip("public_tokenizers")
    c = tokens.Counter(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    words = [bytes(rnd.choice(b"aeinorst ") for _ in range(rnd.randint(0, 30))) for _ in range(300)]

    def naive_count(w):
        s = [int(c.byte_id[b]) for b in w]
        while len(s) > 1:
            r = c._ranks(np.array([x * c.n + y for x, y in zip(s[:-1], s[1:], strict=True)]))
            if r.min() >= 1 << 40:
                break
            k = int(np.argmin(r))
            s[k : k + 2] = [int(c.made[r[k]])]
        return len(s)

    assert c.merged(words).tolist() == [naive_count(w) for w in words]


def test_mix(spark, docs):
    made = [(i, prose(rnd.randint(0, 80)), [None, "a", "b", "c", "ü"][min(4, i % 9)]) for i in range(900)]
    d = docs([*made, (901, None, "a"), (902, "", "empty"), (903, prose(3000), "b"), (None, "x y", "b"), (950, "x y", "b"), (950, "x y", "b")])
    got = mixing.mix_sources(d).join(d.select(F.col("doc_id").alias("i"), F.col("source").alias("src")).distinct(), F.expr("doc_id <=> i")).collect()
    by = {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        by.setdefault(r.src, []).append(r)
    total = sum({s: x[0].source_size for s, x in by.items()}.values())
    targets = {s: x[0].target for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total) and targets["empty"] == 0
    for s, x in by.items():
        assert targets[s] <= 2 * x[0].source_size + 1e-6
        assert abs(sum(r.taken for r in x) - targets[s]) <= 2 * max(r.size for r in x) + 1, s
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(d.repartition(3)).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in got if r.doc_id not in (950, None))
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_mix_of_rows_without_ids(spark, monkeypatch):
    """A hundred thousand rows without an id, most of them the same, and many more under one id."""
    d = spark.range(0, 100000, 1, 8).selectExpr("case when id % 3 = 0 then 7L end as doc_id", "if(id % 10 = 0, 's', null) as source", "if(id % 2 = 0, 'a b c', concat('a b ', id)) as text")
    monkeypatch.setattr(mixing, "SPREAD", 1)
    key = ["doc_id", "size", "target", "taken"]
    got = [tuple(r) for r in mixing.mix_sources(d).groupBy(*key).count().orderBy(*key).collect()]
    monkeypatch.setattr(mixing, "LOT", 8)
    assert got == [tuple(r) for r in mixing.mix_sources(d.repartition(5)).groupBy(*key).count().orderBy(*key).collect()]
    taken = {}
    for doc, size, target, words, n in got:
        assert size == 3 and 0 <= words <= 6
        taken[target] = taken.get(target, 0) + words * n
    assert sum(n for *_, n in got) == 100000 and len(taken) == 2
    assert all(abs(a - b) <= 6 for a, b in taken.items())


@pytest.mark.parametrize("share, limit", [(1.5, 1.5), (1.5, 3.0), (0.5, 2.0), (2.5, 2.0), (2.5, 3.0), (1.0, 1.0)])
def test_mix_takes_its_targets(docs, monkeypatch, share, limit):
    monkeypatch.setattr(mixing, "SPREAD", 1)
    d = docs([(32 * i, prose(rnd.randint(1, 9)), "abc"[min(2, i % 5)]) for i in range(900)])
    got = mixing.mix_sources(d, share=share, limit=limit).join(d.select(F.col("doc_id").alias("i"), F.col("source").alias("src")), F.expr("doc_id = i")).collect()
    by = {}
    for r in got:
        assert math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
        by.setdefault(r.src, []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(min(share, limit) * sum(r.size for r in got))
    for s, x in by.items():
        assert abs(sum(r.taken for r in x) - x[0].target) <= limit * 9 + 1, s


def test_targets_share_what_is_cut_off(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 30)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    left, open_ = 1.5 * 2040, {"a": 3, "b": 1, "c": 2, None: 3}
    caps, want = {"a": 20, "b": 2000, "c": 2000, None: 60}, {}
    while True:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > caps[s]]
        if not full:
            want |= {s: unit * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
            del open_[s]
    assert got == pytest.approx(want)


def check_scores(df, slack=1e-9):
    got = {r.doc_id: r for r in language.scores(df).collect()}
    for i, (out, n, known, total, base) in naive.unigram(rows(df)).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total), i
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and np.isfinite(r.score) and r.score <= 1e-9
    return got


def test_scores(spark, ugly, docs):
    check_scores(ugly)
    assert language.scores(ugly.limit(0)).count() == 0
    assert {(r.n_tokens, r.train_tokens) for r in language.scores(docs([(None, "A b"), (None, "a b"), (None, None)])).collect()} == {(3, 7), (1, 7)}


def test_scores_with_rare_words_joined(ugly, monkeypatch):
    monkeypatch.setattr(language, "CARRIED", 40)
    monkeypatch.setattr(language, "SYMBOLS", 20)
    check_scores(ugly)


def test_scores_of_repeated_rows_agree(docs, monkeypatch):
    monkeypatch.setattr(language, "CARRIED", 2)
    got = language.scores(docs([(1, "rare words here"), (1, "rare words here"), (3, "the the the")])).filter("doc_id = 1").collect()
    assert len(got) == 2 and got[0] == got[1]


def test_model_beats_unigrams(docs):
    a, b = VOCAB[:150], VOCAB[150:]
    r = random.Random(3)
    d = docs([(i, " ".join(r.choice(a if i % 2 else b) for _ in range(80))) for i in range(300)])
    got = check_scores(d)
    out = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


@pytest.mark.parametrize("carried", [1 << 18, 12])
def test_scores_like_a_plain_forward_pass(spark, docs, monkeypatch, carried):
    """The trained model, and the score of each text by its definition: symbols by a forward pass, words in classes by counts."""
    monkeypatch.setattr(language, "CARRIED", carried)
    monkeypatch.setattr(language, "SYMBOLS", 9)
    r = random.Random(4)
    own = [(i, " ".join(r.choice(VOCAB[: r.choice((4, 12, 40))]) for _ in range(r.randint(0, 15)))) for i in range(60)] + [(70, "never seen " * 3), (71, None), (72, VOCAB[0].upper())]
    df = docs(own)
    model, _, _ = language.train(df, ~language.held_out())
    got = {x.doc_id: x.score for x in language.scores(df).collect()}
    train = [naive.solid(naive.fold(t)) for i, t in own if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for ws in train for w in ws)

    def named(w):
        data = np.frombuffer(w.encode(), np.uint8)
        h, cls, _ = language.tokens(data, np.array([0, len(data)]))
        return h, int(cls[0])

    def symbol(w):
        h, cls = named(w)
        place = int(model.lookup(h)[0])
        k = int(model.symbol[place]) if place >= 0 and len(model.symbol) else -1
        return (k, None) if k >= 0 else (model.end + 1 + cls, cls)

    in_class = {}
    for w, c in count.items():
        k, cls = symbol(w)
        if cls is not None:
            n, v = in_class.get(cls, (0, 0))
            in_class[cls] = n + c, v + 1
    for i, t in own:
        extra, a = 0.0, None
        for w in [*naive.solid(naive.fold(t)), None]:
            k, cls = (model.end, None) if w is None else symbol(w)
            if cls is not None:
                n, v = in_class.get(cls, (0, 0))
                extra += math.log10((count[w] + 1) / (n + v + 1))
            a = (model.pi if a is None else a @ model.trans) * model.emit[k]
        assert got[i] == pytest.approx(math.log10(a.sum()) + extra, rel=1e-9), i


def test_slices_cover_all_texts(spark, ugly, monkeypatch):
    """Each text is in one slice, and every round reads one of them or all."""
    monkeypatch.setattr(language, "SLICE_TOKENS", 3000)
    check_scores(ugly)
    _, _, coded = language.train(ugly, ~language.held_out())
    slices = {r.slice: r["count"] for r in coded.groupBy("slice").count().collect()}
    assert len(slices) > 4 and sum(n for k, n in slices.items() if k >= 0) == coded.filter("training").count() and slices.get(-1) == coded.filter("not training").count()


def small_model():
    keys = np.arange(1, 4, dtype=np.uint64) << np.uint64(40)
    return language.Model(keys, np.array([5, 3, 2]), np.arange(3), 13, 4, np.zeros(language.CLASSES), np.zeros(language.CLASSES), 3, np.array([5.0, 3, 2]))


def plain_counts(m, seqs):
    """Unscaled forward and backward recursions: (likelihoods, emissions, transitions, first states)."""
    emit, trans, pi, lls = np.zeros_like(m.emit), np.zeros_like(m.trans), np.zeros_like(m.pi), []
    for s in seqs:
        a, b = [m.pi * m.emit[s[0]]], [np.ones(len(m.pi))]
        for x in s[1:]:
            a.append((a[-1] @ m.trans) * m.emit[x])
        for x in s[:0:-1]:
            b.insert(0, m.trans @ (m.emit[x] * b[0]))
        lls.append(total := a[-1].sum())
        for t, x in enumerate(s):
            emit[x] += a[t] * b[t] / total
            if t:
                trans += m.trans * np.outer(a[t - 1], m.emit[x] * b[t]) / total
        pi += a[0] * b[0] / total
    return np.array(lls), emit, trans, pi


@pytest.mark.parametrize("piece, sweep", [(1 << 15, 400_000), (3, 400_000), (3, 7), (1, 2)])
def test_expected_counts_like_plain_baum_welch(monkeypatch, piece, sweep):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "SWEEP", sweep)
    m, r = small_model(), random.Random(2)
    seqs = [[r.randrange(3) for _ in range(n)] + [m.end] for n in (3, 0, 7, 1, 20, 8)]
    sym, at = np.array([x for s in seqs for x in s], np.uint16), np.cumsum([0, *map(len, seqs)])
    for _ in range(3):
        ll, got, total = np.zeros(len(seqs)), [0, 0, 0], 0.0
        for s, row, alive, came, after, opens in m.sweeps(sym, at):
            ll += np.bincount(row, np.log(m.forward(s, alive, came, opens)[1]), len(ll))
            *made, bits = m.expect(s, alive, came, after, opens)
            got, total = [x + y for x, y in zip(got, made, strict=True)], total + bits
        want, *counts = plain_counts(m, seqs)
        assert ll == pytest.approx(np.log(want)) and total == pytest.approx(np.log10(want).sum())
        for x, y in zip(got, counts, strict=True):
            assert x == pytest.approx(y)
        m.update(*got)


def test_scores_of_null_ids_and_a_long_text(docs):
    d = docs([(None, f"word{i % 7} of a text") for i in range(1000)] + [(3, " ".join(VOCAB[i % 97] for i in range(300_000))), (1, "of a text")])
    got = check_scores(d.filter("doc_id is not null"))
    assert not got[3].held_out and got[3].score > got[3].base_score
    r = language.scores(d)
    assert r.count() == 1002 and r.filter("doc_id is null").select("score").distinct().count() <= 7  # one for each text


def test_odd_rows(spark, odd):
    assert near.similar(odd).count() == 6
    assert {r.n_links for r in near.similar(odd).filter("doc_id = 2").collect()} == {2}
    assert substrings.without_repeats(odd).count() == 6
    assert lines.without_repeats(odd).count() >= 6
    assert language.scores(odd).count() == 6
    for f in (near.similar, substrings.without_repeats, lines.without_repeats):
        assert f(odd.limit(0)).count() == 0


def test_stored_tables_go(spark):
    import os

    from chronolake.llm import common

    there = lambda df: [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]
    kept = common.store(spark.range(5))
    with common.temporary(spark) as own:
        inner, result = common.store(spark.range(3)), common.store(spark.range(4))
        files = inner.inputFiles()
        own.pop()
    assert all(there(kept)) and all(there(result)) and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert spark.conf.get(common.CLEAN, None) in (None, "false")


def test_sql_queries(spark, duck, data):
    from compare import rows_of

    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, data)
        cur = duck.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall()), name


def test_pipeline(spark, data, ugly):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{data}/documents.parquet")
    seen = d
    for n, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, seen, data)
        if n < len(p.STAGES) - 1:
            assert out.columns == d.columns, name
            out = out.cache()
        if name == "toxicity":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in toxicity.toxicity(d, spark.read.parquet(f"{data}/labels.parquet")).filter("predicted = 0").collect()}
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == naive.line_runs(rows(seen))
        if name == "ngram_jaccard":
            assert {r.doc_id for r in out.collect()} == {i for i, (c, _, _) in naive.classes(rows(seen)).items() if c == i}
        seen = out
    ran = {(r.doc_id, r.taken) for r in p.run(spark, data).collect()}
    assert ran == {(r.doc_id, r.taken) for r in seen.collect()}
    for _, stage in p.STAGES[:4]:
        out = stage(spark, ugly, data)
        assert out.columns == ugly.columns and out.count() > 0
        assert stage(spark, ugly.limit(0), data).count() == 0


def test_language_model_slices_do_not_depend_on_size(spark):
    from chronolake.llm import language
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i} of text {i % 7}") for i in range(200)], "doc_id long, text string")
    coded = language.train(docs, F.lit(True))[2]
    assert sorted(r["slice"] for r in coded.select("slice").distinct().collect()) == list(range(language.ROUNDS))
