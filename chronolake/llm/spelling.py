"""Spelling variants: words one code point apart, found by rolling hashes of the words with one code point left out."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, by_key, folding, ints, mix, raw, salts, store, table

#: Letters whose hashes are taken at once: what a task holds doesn't grow with a text or word.
PIECE = 1 << 20
#: Runs of more bytes get their checksum one by one.
LONG = 64
#: Leading bits of a key that name its radix partition.
RADIX = 20
#: An odd base and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LETTERS = folding(lambda b: b < 128 and chr(b).isalpha())
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # by linearity the table of one byte
_BYTE = salts(1201, 256)


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, end) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 rows; letters: the bytes with A-Z as a-z.

    The code points U+00C0 to U+00FF are the byte C3 and one more; C3 begins nothing else."""
    b = LETTERS[data]
    lead = data == 0xC3
    b[lead] = 0xC3
    second = np.flatnonzero(lead) + 1
    b[second] = data[second]
    w = b != 0
    edge = np.zeros(len(w) + 1, bool)
    edge[at] = True  # rows end to end: a run ends where its row does
    before = np.concatenate([[False], w[:-1]]) & ~edge[:-1]
    after = np.concatenate([w[1:], [False]]) & ~edge[1:]
    return b, np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of ``data``, carried on from ``state``; short stretches all at once, byte by byte."""
    out = state.astype(np.uint32)
    size = end - start
    crc = ~out
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    many = int(np.count_nonzero(size > LONG))
    short = order[many:]
    left = np.searchsorted(-size[short], -np.arange(1, LONG + 1), "right")  # how many have so many bytes
    for k in range(int(size[short].max(initial=0))):
        i = short[: left[k]]
        crc[i] = _CRC[(crc[i] ^ data[start[i] + k]) & 255] ^ (crc[i] >> np.uint32(8))
    out = ~crc
    for i in order[:many].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def _groups(sizes: np.ndarray, most: int):
    """Ranges of rows of about ``most`` in all, one row at least."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def _named(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each stretch of bytes."""
    size = end - start
    own = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(int(size.max()) - 1, 0xD6E8FEB86659FD93, U64)]))
        k = np.arange(int(size.sum())) - np.repeat(own, size)
        return mix(np.add.reduceat(_BYTE[b[np.repeat(start, size) + k]] * power[k], own) + size.astype(U64))


def _counted(noise: int):
    """(word, n): the runs of each text, lower-cased, after a code point is left out of one run in ``noise``."""

    def run(batches):
        for t in batches:
            data, at = raw(t.column("text"))
            ids = t.column("doc_id").to_pylist()
            sizes = np.diff(at)
            for i, j in _groups(sizes, 4 * PIECE):
                b, start, end = runs(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if not len(start):
                    continue
                row = np.searchsorted(at[i : j + 1] - at[i], start, "right") - 1
                states = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[i:j]], np.uint32)
                for lo, hi in _groups(end - start, PIECE):
                    yield from _words(b, start[lo:hi], end[lo:hi], checksums(b, start[lo:hi], end[lo:hi], states[row[lo:hi]]), noise)

    return run


def _words(b: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, noise: int):
    hit = crc % np.uint32(noise) == 0
    texts, counts = [], []
    if not hit.all():
        s, e = start[~hit], end[~hit]
        _, first, n = np.unique(_named(b, s, e), return_index=True, return_counts=True)
        s, size = s[first], (e - s)[first]
        own = np.cumsum(size) - size
        letters = b[np.repeat(s - own, size) + np.arange(int(size.sum()))]
        off = np.concatenate([own, [int(size.sum())]]).astype(np.int64)
        texts.append(pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off), pa.py_buffer(letters)]).cast(pa.string()))
        counts.append(n)
    if hit.any():
        changed = []
        for s, e, h in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), strict=True):
            w = b[s:e].tobytes().decode()
            k = h % len(w)
            changed.append(w[:k] + w[k + 1 :])
        texts.append(pa.array(changed, pa.string()))
        counts.append(np.ones(len(changed), np.int64))
    yield batch(word=pa.concat_arrays(texts), n=np.concatenate(counts))


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text): maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z as a-z. If
    ``noise`` divides crc32 of '<doc_id>:<run>', the code point at that number modulo the run's length is left out. Words of
    ``least_length`` code points that occur ``least_count`` times in all are kept. A null text has none; a null doc_id counts
    as an empty one in the checksum."""
    w = docs.filter("text is not null").select("doc_id", "text").mapInArrow(_counted(noise), "word string, n long")
    return w.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _gaps(terms: np.ndarray, upto: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The hash of a word without each of its places: what comes before the gap stays, what comes after it moves one place
    down, which divides by BASE. terms: c[k] * BASE^k; upto: their sums up to each place; total: over the whole word."""
    with np.errstate(over="ignore"):
        return (upto - terms) + (total - upto) * U64(INVERSE)


def _keys(batches):
    """For each word a row under its own hash (place -1), and one for each code point under the hash of the word without it;
    ``last``: the code point is the last of a run of equal ones, so that of equal remainders one is marked."""
    seven = U64(0x2545F4914F6CDD1D)
    for b in batches:
        ids = ints(b.column("wid"))
        words = b.column("word").to_pylist()
        sizes = np.array([len(w) for w in words], np.int64)
        for i, j in _groups(sizes, PIECE):
            own, size = ids[i:j], sizes[i:j]
            cp = np.frombuffer("".join(words[i:j]).encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(size)])
            if j == i + 1 and len(cp) > PIECE:  # a word that is longer: piece by piece
                yield from _long_keys(int(own[0]), cp)
                continue
            with np.errstate(over="ignore"):
                c = mix(cp.astype(U64) * seven)
                place = np.arange(len(cp)) - np.repeat(at[:-1], size)
                power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(int(size.max()) - 1, BASE, U64)]))[place]
                terms = c * power
                total = np.add.reduceat(terms, at[:-1])
                upto = np.cumsum(terms)
                upto -= np.repeat(upto[at[:-1]] - terms[at[:-1]], size)  # within the word
                gap = _gaps(terms, upto, np.repeat(total, size))
                last = np.ones(len(cp), bool)
                last[:-1] = cp[1:] != cp[:-1]
                last[at[1:] - 1] = True
                key = np.concatenate([mix(total + size.astype(U64) * seven), mix(gap + np.repeat(size - 1, size).astype(U64) * seven)])
            yield _key_rows(key, np.concatenate([own, np.repeat(own, size)]), np.concatenate([np.full(len(own), -1), place]), np.concatenate([np.ones(len(own), bool), last]))


def _long_keys(wid: int, cp: np.ndarray):
    """What ``_keys`` gives for one word, PIECE code points at a time."""
    seven, n = U64(0x2545F4914F6CDD1D), len(cp)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(PIECE - 1, BASE, U64)]))
        starts = range(0, n, PIECE)
        shift = [U64(pow(BASE, s, 1 << 64)) for s in starts]
        hashed = lambda s: mix(cp[s : s + PIECE].astype(U64) * seven)
        sums = [int((hashed(s) * power[: min(PIECE, n - s)] * f).sum()) for s, f in zip(starts, shift, strict=True)]
        total = sum(sums) % (1 << 64)
        yield _key_rows(mix(np.array([total], U64) + U64(n) * seven), np.full(1, wid), np.full(1, -1), np.ones(1, bool))
        before = 0
        for s, f, own in zip(starts, shift, sums, strict=True):
            m = min(PIECE, n - s)
            terms = hashed(s) * power[:m] * f
            key = mix(_gaps(terms, np.cumsum(terms) + U64(before), U64(total)) + U64(n - 1) * seven)
            last = np.ones(m, bool)
            last[:-1] = cp[s + 1 : s + m] != cp[s : s + m - 1]
            if s + m < n:
                last[-1] = cp[s + m] != cp[s + m - 1]
            yield _key_rows(key, np.full(m, wid), np.arange(s, s + m), last)
            before = (before + own) % (1 << 64)


def _key_rows(key, wid, place, last):
    return batch(radix=(key >> U64(64 - RADIX)).view(np.int64), key=key.view(np.int64), wid=wid, place=place.astype(np.int64), last=last)


def _pairs(t: pa.Table):
    """(a, b, place, kind) of words that a key brings together: a without the place is b (kind 0), or a and b without it are
    equal (kind 1); each pair once."""
    key, wid, place, last = (ints(t.column(c)) for c in ("key", "wid", "place", "last"))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    # whole words stand first under their key; several only if hashes collide
    whole = np.flatnonzero(place == -1)
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(key)]])
    for i in whole[ends[group[whole]] - whole > 1].tolist():
        u = np.arange(i + 1, ends[group[i]])
        u = u[(place[u] >= 0) & last[u]]
        if len(u):
            yield batch(a=wid[u], b=np.full(len(u), wid[i]), place=place[u], kind=np.zeros(len(u), np.int8))
    for d in range(1, len(key)):
        i = np.flatnonzero((group[:-d] == group[d:]) & (place[:-d] == place[d:]) & (place[d:] >= 0))
        if not len(i):
            return
        yield batch(a=wid[i], b=wid[i + d], place=place[i], kind=np.ones(len(i), np.int8))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, a_word, b_word, a_n, b_n): the pairs of ``words`` (wid, word, n; each word once) that differ by exactly one
    inserted, deleted or replaced code point, each pair once.

    Each word has a row under its hash and under that of each remainder with one code point left out, made from hashes of what
    comes before and after it. Keys are dealt out by their leading bits and sorted; a word meets those that it is a remainder
    of, and words that lack the same place. Under a key there are, hash collisions aside, no more words than code points in use
    times places of a word. What meets is verified on the strings."""
    keys = words.select("wid", "word").mapInArrow(_keys, "radix long, key long, wid long, place long, last boolean")
    pairs = by_key(keys, "radix", _pairs, "a long, b long, place long, kind byte", "key", "place", "wid")
    side = lambda x: words.select(F.col("wid").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    p = store(pairs).join(side("a"), "a").join(side("b"), "b")
    i = F.col("place").cast("int")
    cut = lambda c: F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.char_length(c)))
    equal = F.when(F.col("kind") == 0, cut("a_word") == F.col("b_word")).otherwise((cut("a_word") == cut("b_word")) & (F.char_length("a_word") == F.char_length("b_word")))
    return p.filter(equal & (F.col("a_word") != F.col("b_word"))).select("a", "b", "a_word", "b_word", "a_n", "b_n")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n; each word once, neither null).

    n_near counts the words one code point away; form is the most frequent of these (ties: the smallest in code-point order),
    if it is at least ``ratio`` times as frequent as the word, else null; form_n is its n. root is where forms lead to in the
    end: the word itself if it has none. ``ratio`` is 2 at least, so that no forms lead round."""
    if ratio < 2:
        raise ValueError("ratio is 2 at least")
    w = store(words.filter("word is not null and n is not null").select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    p = store(near_words(w))
    end = lambda x, y: p.select(F.col(x).alias("wid"), F.col(f"{y}_n").alias("near_n"), F.col(f"{y}_word").alias("near_word"), F.col(y).alias("near"))
    both = end("a", "b").unionByName(end("b", "a"))
    best = both.groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near_word", "near")).alias("best"))
    best = best.select("wid", "n_near", "best.near", "best.near_word", (-F.col("best.m")).alias("near_n"))
    is_form = F.col("near_n") >= ratio * F.col("n")
    w = store(w.join(best, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(is_form, F.col(c)).alias(d) for c, d in (("near", "form_id"), ("near_word", "form"), ("near_n", "form_n")))))
    # each round doubles how far a word sees along its forms, of which there are no more than n has bits
    see = store(w.filter("form_id is not null").select("wid", F.col("form_id").alias("to"), F.col("form").alias("root")))
    while True:
        onward = see.select(F.col("wid").alias("to"), F.col("to").alias("next"), F.col("root").alias("next_root"))
        if not see.join(onward, "to", "left_semi").take(1):
            break
        see = store(see.join(onward, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.coalesce("next_root", "root").alias("root")))
    return w.join(see.select("wid", "root"), "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, noise: int = 97, ratio: int = 2) -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs`` (doc_id, text).

    Texts that are null or have no letter add nothing, rows that repeat count again, other columns are ignored, and an empty
    table gives an empty table. Texts and words of any length are hashed PIECE letters at a time."""
    return variants(vocabulary(docs, least_length, least_count, noise), ratio)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents, their near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))
