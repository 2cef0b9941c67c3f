"""Hidden Markov language model: Baum-Welch over all training texts, exact scores by the scaled forward recursion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SOLID, U64, batch, blobs, ints, mix, pieces, raw, store, table, words

STATES = 8
#: Words that are symbols of their own; all others are symbols by class, which their last two bytes give.
SYMBOLS = 1 << 14
CLASSES = 509
#: Words whose counts travel with the model; rarer ones are looked up by a join.
CARRIED = 1 << 18
#: The first rounds of Baum-Welch read a slice of the training texts each, so that together they read all of them once, whatever
#: the size of the table.
ROUNDS = 12
#: Tokens that a slice has on tables of 18 million; it decides nothing.
SLICE_TOKENS = 1_500_000
#: Then whole passes follow, until one gains less than this share of the log likelihood, or there were so many.
SETTLED, PASSES = 2e-4, 4
#: Tokens that one forward-backward sweep holds; a longer text is swept in pieces of PIECE tokens that hand on their states.
SWEEP, PIECE = 400_000, 1 << 15
#: Expected counts are added up as whole numbers of this fraction, so that their order doesn't matter.
GRAIN = 1 << 16
PRIOR = 2000.0


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, first of each row) of the words."""
    h, start, end, first = words(data, at, SOLID)
    if not len(h):
        return h, np.zeros(0, np.int64), first
    b = SOLID[data].astype(np.int64)
    return h, (b[end - 1] * 256 + b[np.maximum(end - 2, start)] + (end - start > 1) * 7) % CLASSES, first


class Lookup:
    """Places of 64-bit hashes in a sorted list; -1 for those it lacks."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        self.start = np.searchsorted(keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        top = (h >> U64(64 - self.bits)).astype(np.int64)
        p, stop = self.start[top], self.start[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(p < stop)
        p, stop = p[live], stop[live]
        while len(live):
            hit = self.keys[p] == h[live]
            out[live[hit]] = p[hit]
            p = p + 1
            go = ~hit & (p < stop)
            live, p, stop = live[go], p[go], stop[go]
        return out


class Model:
    """Symbols: SYMBOLS words, then the end, then CLASSES classes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, symbol: np.ndarray, n: int, v: int, class_n: np.ndarray, class_v: np.ndarray, ends: int, own: np.ndarray):
        self.lookup = Lookup(keys)
        self.counts, self.symbol, self.n, self.v, self.ends = counts, symbol, n, v, ends
        self.end = SYMBOLS
        self.size = SYMBOLS + 1 + CLASSES
        self.class_bits = np.log10(class_n + class_v + 1.0)
        uni = np.ones(self.size)
        uni[: len(own)] += own
        uni[self.end] += ends
        uni[self.end + 1 :] += class_n
        uni[len(own) : self.end] = 0
        self.uni = uni / uni.sum()
        self.pi = np.full(STATES, 1 / STATES)
        self.trans = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
        noise = (mix(np.arange(self.size * STATES, dtype=U64) + U64(977)) >> U64(11)).astype(np.float64) / 2**53
        self.emit = self.uni[:, None] * (0.5 + noise.reshape(self.size, STATES))
        self.emit /= self.emit.sum(0)

    def update(self, emit: np.ndarray, trans: np.ndarray, pi: np.ndarray) -> None:
        """Maximisation from expected counts, with the words' overall shares and a few extra steps as priors."""
        self.emit = (emit + PRIOR * self.uni[:, None]) / (emit.sum(0) + PRIOR)
        self.trans = (trans + 1.0) / (trans.sum(1, keepdims=True) + STATES)
        self.pi = (pi + 1.0) / (pi.sum() + STATES)

    def encode(self, h: np.ndarray, cls: np.ndarray, first: np.ndarray):
        """(place of each word's count, symbol of each token, first token of each row): an end closes each row."""
        place = self.lookup(h)
        sym = np.where(place >= 0, self.symbol[place], -1) if len(self.symbol) else np.full(len(h), -1)
        sym = np.where(sym >= 0, sym, self.end + 1 + cls)
        return place, np.insert(sym, first[1:], self.end), first + np.arange(len(first))

    def links(self, sym: np.ndarray, at: np.ndarray):
        """All rows cut to pieces of at most PIECE tokens: (row of each piece, where it begins and ends, the states before it,
        the likelihood of all after it for each state, whether it is a row's first). What the pieces of a long row hand on
        comes from the product of each piece's transfer matrices, which is made for all pieces side by side."""
        n = np.maximum(1, -(-np.diff(at) // PIECE))
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = at[row] + nth * PIECE
        came, after = np.zeros((len(row), STATES)), np.ones((len(row), STATES))
        long = np.flatnonzero(n > 1)
        if len(long):
            end = np.minimum(begin + PIECE, at[row + 1])
            later = np.flatnonzero(np.repeat(n > 1, n))  # the pieces of long rows
            m = np.tile(np.eye(STATES), (len(later), 1, 1))
            for t in range(int((end - begin)[later].max())):
                live = begin[later] + t < end[later]
                x = m[live]
                # the first token of a text has no step before it
                x = np.where(((nth[later[live]] == 0) & (t == 0))[:, None, None], x, x @ self.trans) * self.emit[sym[begin[later[live]] + t]][:, None, :]
                m[live] = x / x.sum((1, 2))[:, None, None]
            place = np.searchsorted(later, np.cumsum(n)[long] - n[long])
            for k, r in zip(place.tolist(), long.tolist(), strict=True):
                a = self.pi
                for j in range(k, k + int(n[r]) - 1):
                    a = a @ m[j]
                    a = a / a.sum()
                    came[later[j + 1]] = a
                b = np.ones(STATES)
                for j in range(k + int(n[r]) - 1, k, -1):
                    b = m[j] @ b
                    b = b / b.sum()
                    after[later[j - 1]] = b
        return row, begin, np.minimum(begin + PIECE, at[row + 1]), came, after, nth == 0

    def sweeps(self, sym: np.ndarray, at: np.ndarray):
        """Pieces of rows sorted by length, at most SWEEP tokens of them: (tokens by time, row of each, pieces alive at each
        time, and as ``links`` has them the states before each, what follows it, whether it is a row's first)."""
        row, begin, end, came, after, opens = self.links(sym, at)
        size = end - begin
        order = np.argsort(-size, kind="stable")
        i, total = 0, np.cumsum(size[order])
        while i < len(order):
            done = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + SWEEP, "right")))
            own = order[i:j]
            n = size[own]
            flat = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            time = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            o = np.argsort(time, kind="stable")
            yield sym[flat[o]].astype(np.int64), np.repeat(row[own], n)[o], np.bincount(time), came[own], after[own], opens[own]
            i = j

    def forward(self, sym: np.ndarray, alive: np.ndarray, came: np.ndarray, opens: np.ndarray):
        """Scaled forward values and scales of tokens in order of time."""
        start = np.where(opens[:, None], self.pi, came @ self.trans)
        e = self.emit[sym]
        scale = np.empty(len(sym))
        at, prev = 0, None
        for n in alive.tolist():
            a = e[at : at + n] * (start if prev is None else prev[:n] @ self.trans)
            s = a.sum(1)
            a /= s[:, None]
            scale[at : at + n] = s
            prev = e[at : at + n] = a
            at += n
        return e, scale

    def expect(self, sym: np.ndarray, alive: np.ndarray, came: np.ndarray, after: np.ndarray, opens: np.ndarray):
        """Expected counts, and what they come from: (emissions, transitions, first states, log10 likelihood)."""
        alpha, scale = self.forward(sym, alive, came, opens)
        total = len(sym)
        begin = np.cumsum(alive) - alive
        back = self.emit[sym] / scale[:, None]  # becomes e * beta / scale
        # a piece's last token: what follows it, in the scale where alpha * beta sums to 1
        size = np.searchsorted(-alive, -np.arange(1, alive[0] + 1), "right")
        last = begin[size - 1] + np.arange(alive[0])
        beta = np.ones((total, STATES))
        beta[last] = after / (alpha[last] * after).sum(1)[:, None]
        back_t = self.trans.T
        for t in range(len(alive) - 2, -1, -1):
            o, nxt, m = begin[t], begin[t + 1], alive[t + 1]
            back[nxt : nxt + m] *= beta[nxt : nxt + m]
            beta[o : o + m] = back[nxt : nxt + m] @ back_t
        back[: alive[0]] *= beta[: alive[0]]
        gamma = alpha * beta
        before = np.arange(alive[0], total) - np.repeat(alive[:-1], alive[1:])
        trans = self.trans * (alpha[before].T @ back[alive[0] :])
        inner = np.flatnonzero(~opens)  # steps from one piece to the next
        trans += self.trans * (came[inner].T @ back[inner])
        emit = np.stack([np.bincount(sym, gamma[:, k], self.size) for k in range(STATES)], 1)
        return emit, trans, gamma[: alive[0]][opens].sum(0), float(np.log10(scale).sum())


def _by_part(model: Model, batches):
    """Expected counts of a partition in units of 1 / GRAIN: a row (symbol, c0, c1, ...); symbols below 0 are rows of the
    transition matrix, the first states, and the log likelihood."""
    emit, trans, pi, bits = np.zeros((model.size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros(STATES)
    for b in batches:
        for s, _, *piece in model.sweeps(*_symbols(b)):
            *got, ll = model.expect(s, *piece)
            bits[0] += ll
            for x, y in zip((emit, trans, pi), got, strict=True):
                x += y
    used = np.flatnonzero(emit.any(1))
    c = np.rint(np.concatenate([emit[used], trans, pi[None], bits[None]]) * GRAIN).astype(np.int64)
    yield batch(symbol=np.concatenate([used, -1 - np.arange(STATES + 2)]), **{f"c{k}": c[:, k] for k in range(STATES)})


def _symbols(b) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(b.column("sym"))
    return data.view(np.uint16), at // 2


def train(docs: DataFrame, training: Column) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training documents; (w, c), the counts of all their words; and all documents as symbols, with what
    their words add to the scores whatever the states."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), training.alias("training"))
    t = docs.filter("training")

    def count(batches):
        keep: list = []
        for b in batches:
            for _, _, data, at in pieces(b.column("text"), 1 << 20):
                h, cls, _ = tokens(data, at)
                if len(h):
                    u, i, c = np.unique(h, return_index=True, return_counts=True)
                    keep.append((u, cls[i], c))
                if sum(len(x[0]) for x in keep) > 2_000_000:
                    keep = [_added(keep)]
                    if len(keep[0][0]) > 1_000_000:
                        yield batch(w=keep[0][0].view(np.int64), cls=keep[0][1], c=keep[0][2])
                        keep = []
        if keep:
            w, cls, c = _added(keep)
            for i in range(0, len(w), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield batch(w=w[s].view(np.int64), cls=cls[s], c=c[s])

    c = store(t.select("text").mapInArrow(count, "w long, cls long, c long").groupBy("w").agg(F.sum("c").alias("c"), F.first("cls").alias("cls")))
    ends = t.count()
    by_class = c.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow().to_pandas()
    # all words from that count on which at most CARRIED reach: found on a scale of counts, not by sorting the words
    grade = F.floor(F.log2("c") * 16).cast("int")
    scale = c.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("g", ascending=False)
    full = scale["g"][scale["n"].cumsum() <= CARRIED]
    least = int(full.min()) if len(full) else 1 << 20
    head = c.filter(grade >= least).toArrow().to_pandas().sort_values(["c", "w"], ascending=[False, True])
    n, v = int(by_class["n"].sum()) + ends, int(by_class["v"].sum()) + (ends > 0)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[by_class["cls"]], class_v[by_class["cls"]] = by_class["n"], by_class["v"]
    own = head[:SYMBOLS]
    np.subtract.at(class_n, own["cls"].to_numpy(np.int64), own["c"].to_numpy())
    np.subtract.at(class_v, own["cls"].to_numpy(np.int64), 1)
    keys = head["w"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    symbol = np.where(order < SYMBOLS, order, -1)
    model = Model(keys[order], head["c"].to_numpy(np.int64)[order], symbol, n, v, class_n, class_v, ends, own["c"].to_numpy(np.float64))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    total = float(np.log10(n + v + 1.0))

    def encode(batches):
        m = sent.value
        for b in batches:
            for i, j, data, at in pieces(b.column("text"), 1 << 19):
                h, cls, first = tokens(data, at)
                place, sym, first_t = m.encode(h, cls, first)
                row = np.repeat(np.arange(j - i), np.diff(first))
                c = np.where(place >= 0, m.counts[place], 0) if len(m.counts) else np.zeros(len(h), np.int64)
                bits = np.log10(c + 1.0)
                base = np.bincount(row, bits, j - i).astype(np.float64) + np.log10(m.ends + 1.0) - total * np.diff(first_t)
                known = np.bincount(row, c > 0, j - i).astype(np.int64) + (m.ends > 0)
                own = place >= 0
                own[own] = m.symbol[place[own]] >= 0
                ll = np.bincount(row, np.where(own, 0.0, bits - m.class_bits[cls]), j - i).astype(np.float64)  # whole numbers if there is none
                rest = {x: b.column(x).slice(i, j - i) for x in ("doc_id", "training")}
                miss = place < 0
                rare = blobs(h[miss].view(np.int64), np.bincount(row[miss], minlength=j - i))
                yield batch(**rest, n_tokens=np.diff(first_t), known=known, base=base, ll=ll, sym=blobs(sym.astype(np.uint16), np.diff(first_t)), rare=rare)

    coded = docs.mapInArrow(encode, "doc_id long, training boolean, n_tokens long, known long, base double, ll double, sym binary, rare binary")
    own = F.when(F.col("training"), F.pmod(F.xxhash64("doc_id", "sym"), F.lit(ROUNDS))).otherwise(-1).cast("int")
    coded = store(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("slice", own), "slice")  # rows may share ids
    if not ends:
        return model, c, coded
    columns = [f"c{k}" for k in range(STATES)]

    def round_over(part: DataFrame) -> float:
        """One round of Baum-Welch; the log likelihood before it."""
        sent = spark.sparkContext.broadcast(model)
        run = (lambda sent: lambda batches: _by_part(sent.value, batches))(sent)
        e = part.select("sym").mapInArrow(run, "symbol long, " + ", ".join(f"{x} long" for x in columns))
        e = e.groupBy("symbol").agg(*(F.sum(x).alias(x) for x in columns)).toArrow().to_pandas()  # one row for each symbol
        sent.unpersist()
        s, x = e["symbol"].to_numpy(np.int64), e[columns].to_numpy(np.float64) / GRAIN
        emit, trans = np.zeros((model.size, STATES)), np.zeros((STATES + 2, STATES))
        emit[s[s >= 0]] = x[s >= 0]
        trans[-1 - s[s < 0]] = x[s < 0]
        if emit.any():  # a slice may be empty
            model.update(emit, trans[:STATES], trans[STATES])
        return float(trans[STATES + 1, 0])

    for k in range(ROUNDS):
        round_over(coded.filter(F.col("slice") == k))  # a folder of its own
    before = None
    for _ in range(PASSES):
        now = round_over(coded.filter("slice >= 0"))
        if before is not None and now - before < SETTLED * abs(now):
            break
        before = now
    return model, c, coded


def _added(keep: list):
    w, cls, c = (np.concatenate(x) for x in zip(*keep, strict=True))
    u, i, back = np.unique(w, return_index=True, return_inverse=True)
    return u, cls[i], np.bincount(back, c, len(u)).astype(np.int64)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    A hidden Markov model of STATES states is trained on all documents that are not held out. Its symbols are the SYMBOLS
    most frequent words, the end, and CLASSES classes of all other words; a word of a class has probability
    (c + 1) / (N + V + 1) in it, with the class's N words, V of them distinct, and what is left for unseen ones, whatever
    the state. So the forward recursion over symbols, times these, is the exact likelihood with every word counted over
    the whole corpus. Expected counts are summed by all partitions: in the first ROUNDS rounds over a slice of the training texts
    each, in turn, then over all of them until the likelihood settles. A text of any length is one sequence: long ones are swept in pieces that hand on their states. base_score is the unigram score with add-one counts. Words are [^\\x20\\x09-\\x0D]+ with A-Z
    folded; a null text counts as empty and has its end alone. Every row is scored, equal rows equally; a null doc_id
    trains; other columns are ignored; an empty table gives none."""
    model, counts, coded = train(docs, ~held_out())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        for b in batches:
            sym, at = _symbols(b)
            ll = ints(b.column("ll")).copy()
            for s, r, alive, came, _, opens in m.sweeps(sym, at):
                ll += np.bincount(r, np.log10(m.forward(s, alive, came, opens)[1]), len(ll))
            yield batch(**{x: b.column(x) for x in ("row", "doc_id", "n_tokens", "known", "base")}, ll=ll)

    def rare(batches):
        for b in batches:
            data, at = raw(b.column("rare"))
            if len(data):
                yield batch(w=data.view(np.int64), d=np.repeat(ints(b.column("row")), np.diff(at) // 8))

    part = coded.select("row", "doc_id", "n_tokens", "known", "base", "ll", "sym").mapInArrow(score, "row long, doc_id long, n_tokens long, known long, base double, ll double")
    if model.v - (model.ends > 0) > len(model.counts):
        more = coded.select("row", "rare").mapInArrow(rare, "w long, d long")
        more = more.join(counts.select("w", "c"), "w").groupBy("d").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("n_more"))
        part = part.join(more, F.col("row") == F.col("d"), "left")
    else:
        part = part.select("*", F.lit(0.0).alias("more"), F.lit(0).alias("n_more"))
    more = F.coalesce("more", F.lit(0.0))
    return part.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("ll") + more).alias("score"))


def op9_hmm_scores(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of each document under the unigram base and the hidden Markov model."""
    return scores(table(spark, sf_dir, "documents"))
