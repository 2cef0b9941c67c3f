"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WORDS, batch, blobs, ints, mix, pieces, raw, store, table, words

#: Fitting uses at most so many confirmed toxic and so many unlabelled documents, those of the smallest xxhash64(doc_id).
MOST_TOXIC, MOST_UNLABELLED = 6000, 14000
#: Features that the classifier weighs at most.
MOST_FEATURES = 4096
#: Besides whole words, their first so many bytes.
PREFIXES = (3, 4, 5, 6)
BITS = 22
SURE = 5.0
CUT = 0.3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word and word beginning; repeats included."""
    h, start, end, first = words(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    out, rows = [h], [row]
    b = WORDS[data]
    with np.errstate(over="ignore"):
        x = np.full(len(h), 7, U64)
        live = np.arange(len(h))
        for k in range(max(PREFIXES)):
            live_now = live[end[live] - start[live] > k]
            x = x[np.searchsorted(live, live_now)] if len(live_now) != len(live) else x
            live = live_now
            x = x * U64(0x100000001B3) + b[start[live] + k].astype(U64) + U64(1)
            if k + 1 in PREFIXES:
                out.append(mix(x * U64(31) + U64(k)))
                rows.append(row[live])
    return np.concatenate(out), np.concatenate(rows)


def _distinct(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row): each feature bin once for each row."""
    f, row = features(data, at)
    key = np.unique((row.astype(np.int64) << BITS) | (f >> U64(64 - BITS)).astype(np.int64))
    return key & ((1 << BITS) - 1), key >> BITS


def fit(x_row: np.ndarray, x_col: np.ndarray, n: int, k: int, toxic: np.ndarray, prior: float, rounds: int = 300, decay: float = 2e-4) -> np.ndarray:
    """Weights (the last one the intercept) of a logistic classifier over ``n`` rows of ``k`` binary features.

    The risk is prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic)) with logistic losses: what toxic text there
    is among the unlabelled is taken off by the class prior, and where that would make the negative part fall below zero,
    a step leads back up. ``toxic`` marks the confirmed rows, all others are unlabelled."""
    w, m, v, mean = (np.zeros(k + 1) for _ in range(4))
    n_p, n_u = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(x_row, w[x_col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[~toxic].mean() - prior * loss_neg[toxic].mean() if (~toxic).any() else 0.0
        up = np.where(toxic, prior * (p - 1) / n_p, 0.0)
        down = np.where(toxic, -prior * p / n_p, p / n_u)
        g = up + down if negative >= 0 else -down
        grad = np.append(np.bincount(x_col, g[x_row], k), g.sum()) + decay * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 / np.sqrt(1 + t / 30) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > rounds:
            mean += w / (rounds - rounds // 2)
    # the intercept at which the mean score of the unlabelled is the class prior
    z = np.bincount(x_row, mean[x_col], n)[~toxic]
    lo, hi = -30.0, 30.0
    for _ in range(60 if len(z) else 0):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (1 / (1 + np.exp(-np.clip(z + mid, -30, 30)))).mean() > prior else (mid, hi)
    mean[-1] = (lo + hi) / 2 if len(z) else mean[-1]
    return mean


class Scorer:
    def __init__(self, bins: np.ndarray, weights: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int16)
        self.place[bins] = np.arange(len(bins))
        self.w = weights

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        f, row = features(data, at)
        col = self.place[(f >> U64(64 - BITS)).astype(np.int64)]
        hit = col >= 0
        key = np.unique(row[hit].astype(np.int64) * MOST_FEATURES + col[hit])
        z = self.w[-1] + np.bincount(key // MOST_FEATURES, self.w[key % MOST_FEATURES], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, toxic_ids: DataFrame, fold: Column, prior: float) -> Scorer | None:
    """Learns from the documents of ``toxic_ids`` (doc_id) and from others of ``fold``, whose labels are never read."""
    spark = docs.sparkSession
    pick = F.xxhash64("doc_id")
    p = toxic_ids.select("doc_id").distinct().orderBy(pick, "doc_id").limit(MOST_TOXIC)
    u = docs.select("doc_id").filter(fold).distinct().orderBy(pick, "doc_id").limit(MOST_UNLABELLED)
    ids = {r.doc_id: True for r in p.collect()}
    if not ids:
        return None
    # a document may be on both sides: the unlabelled are a sample of all text, the toxic included
    marked = [(r.doc_id, False) for r in u.collect()] + list(ids.items())
    sample = F.broadcast(spark.createDataFrame([(*m, n) for n, m in enumerate(marked)], "_id long, _toxic boolean, _nth long"))  # bounded by the two constants
    text = docs.select("doc_id", "text").filter("text is not null").join(sample, F.col("doc_id") == F.col("_id")).groupBy("_nth", "_toxic").agg(F.min("text").alias("text"))
    text = store(text)  # read twice; of texts under one id the smallest counts

    def counts(batches):
        n = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            toxic = b.column("_toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, at in pieces(b.column("text")):
                f, row = _distinct(data, at)
                y = toxic[i:j][row]
                n[0] += np.bincount(f[y == 1], minlength=1 << BITS).astype(np.int32)
                n[1] += np.bincount(f[y == 0], minlength=1 << BITS).astype(np.int32)
        f = np.flatnonzero(n.any(0))
        for k in range(0, len(f), 1 << 16):
            g = f[k : k + (1 << 16)]
            yield batch(f=g, p=n[0, g].astype(np.int64), u=n[1, g].astype(np.int64))

    n_p, n_u = len(ids), max(1, len(marked) - len(ids))
    c = text.mapInArrow(counts, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("p >= 3")
    p1 = F.col("p") / n_p
    p0 = F.greatest(F.lit(0.0), (F.col("u") / n_u - prior * p1) / (1 - prior))
    ratio = F.log((p1 + 1 / n_u) / (p0 + 1 / n_u))
    # far more often among the toxic than chance puts there: beyond SURE standard deviations of the count expected
    expected = F.greatest((F.col("u") + 1) / n_u * n_p, F.lit(0.25))
    sure = (F.col("p") - expected) / F.sqrt(expected) > SURE
    best = c.filter(sure).select("f", (p1 * ratio).alias("gain"), ratio.alias("r")).filter("r > 1.1").orderBy(F.desc("gain"), "f").limit(MOST_FEATURES)
    bins = np.array(sorted(r.f for r in best.collect()), np.int64)
    place = np.full(1 << BITS, -1, np.int16)
    place[bins] = np.arange(len(bins))

    def chosen(batches):
        """A row for each document: which of the chosen features it has."""
        for b in batches:
            for i, j, data, at in pieces(b.column("text")):
                f, row = _distinct(data, at)
                col = place[f]
                hit = col >= 0
                own = b.slice(i, j - i)
                yield batch(nth=own.column("_nth"), cols=blobs(col[hit].astype(np.int16), np.bincount(row[hit], minlength=j - i)))

    x = text.mapInArrow(chosen, "nth long, cols binary").toArrow()  # at most 2 * MOST_FEATURES bytes for each of the sample
    flat, at = raw(x["cols"]) if x.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    rows = np.repeat(ints(x["nth"]), np.diff(at) // 2) if x.num_rows else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")  # the same sums in every run
    rows, cols = rows[order], flat.view(np.int16).astype(np.int64)[order]
    w = fit(rows, cols, len(marked), len(bins), np.array([t for _, t in marked]), prior)
    full = np.zeros(MOST_FEATURES + 1)
    full[: len(bins)], full[-1] = w[:-1], w[-1]
    return Scorer(bins, full)


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``cut``).

    Learned from labels (doc_id, toxic) whose documents are not held out. A classifier is fitted by non-negative
    positive-unlabelled risk to at most MOST_TOXIC confirmed toxic documents and MOST_UNLABELLED documents without regard
    to their labels; the class prior is the toxic share of all training labels. Scores look at the whole text and at
    nothing else: whole words and word beginnings of PREFIXES bytes, of which the MOST_FEATURES that tell most are
    weighed. Null and empty texts get the score of a text without features. Without a toxic training label every score
    is 0. Null labels and labels of null doc_ids are skipped, a document labelled twice counts as toxic if one label
    says so; a null doc_id is not held out. Columns named as the three results are replaced; empty tables give none."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model = train(docs, known.filter("toxic = 1"), ~held_out(), min(0.95, max(0.001, share))) if share else None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [f for f in docs.schema.fields if f.name.lower() not in ("held_out", "score", "predicted")]

    def score(batches):
        model = sent.value
        for b in batches:
            s = [model.score(data, at) if model else np.zeros(len(at) - 1) for _, _, data, at in pieces(b.column("text"))]
            yield b.append_column("score", pa_float(np.concatenate(s) if s else np.zeros(0)))

    schema = T.StructType([*own, T.StructField("score", T.DoubleType())])
    scored = docs.select(*(f.name for f in own)).mapInArrow(score, schema)
    return scored.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def pa_float(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x, pa.float64())


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic."""
    return toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
