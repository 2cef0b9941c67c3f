"""Token counts: byte-pair merging of many pre-tokens at once."""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import U64, batch, mix, table

#: Fixed by the library: how its byte-level pre-tokenizer cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens, of so many characters at most, whose counts a worker remembers; it then starts anew.
REMEMBERED, SHORT = 1 << 20, 64
#: Bytes of pre-tokens that are merged at a time.
AT_ONCE = 1 << 21
#: Pre-tokens from so many bytes on are merged one by one, where a round looks at the pairs of its rank alone.
LONG = 1 << 15
NONE = 1 << 40


def _check(file: dict) -> None:
    """Refuse a tokenizer whose counts would differ from those of byte-level pair merging as it is done here."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("normalizer", "truncation", "padding") if file.get(k)]
    odd += ["model"] if model.get("type") != "BPE" else []
    odd += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
    odd += ["added_tokens"] if any(t.get(k) for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")) else []
    if odd:
        raise ValueError(f"only byte-level BPE without more settings is counted; the file sets {', '.join(odd)}")


class Counter:
    """Counts tokens of pre-tokens under the merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: str):
        file = json.loads(content)
        _check(file)
        vocab = file["model"]["vocab"]
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(visible)]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        n = len(vocab) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.n = n
        # open addressing: one or two looks find a pair's rank
        self.bits = max(18, int(np.ceil(np.log2(4 * len(pairs) + 4))))
        size = 1 << self.bits
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        for rank, key in enumerate((left * n + right).tolist()):
            s = self._slot(np.array([key]))[0]
            while self.slot_key[s] >= 0:
                s = (s + 1) & (size - 1)
            self.slot_key[s], self.slot_rank[s] = key, rank
        self.made = made
        self.specials = [t["content"] for t in file.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known: dict[str, int] = {}
        self.cut = regex.compile(PATTERN).findall

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(key.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the vocabulary has no such merge."""
        s = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        i = np.arange(len(key))
        while len(i):
            k = self.slot_key[s]
            hit = k == key[i]
            out[i[hit]] = self.slot_rank[s[hit]]
            go = ~hit & (k >= 0)
            i, s = i[go], (s[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols remain of each pre-token once no pair of neighbours can be merged.

        All pre-tokens lie end to end. In a round each of them has its own lowest-rank pair merged at all its places,
        from left to right without overlap; a finished one leaves the arrays."""
        size = np.array([len(t) for t in tokens], np.int64)
        out = size.copy()
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), size)
        rank = np.full(len(sym), NONE, np.int64)
        if len(sym) > 1:
            same = seq[:-1] == seq[1:]
            rank[:-1][same] = self._ranks(sym[:-1][same] * self.n + sym[1:][same])
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(seq)))
            done = low >= NONE
            out[seq[begin[done]]] = length[done]
            keep = np.repeat(~done, length)
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            if not len(sym):
                break
            take = rank == np.repeat(low[~done], length[~done])
            # places next to each other can only be of a pair of equal symbols: every other one of such a run counts
            at = np.flatnonzero(take)
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():
                head = np.concatenate([[True], at[1:] != at[:-1] + 1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            gone_before = at[at > 1]
            fresh[gone_before - 2] |= ~stay[gone_before - 1]
            sym, seq, rank, fresh = sym[stay], seq[stay], rank[stay], np.flatnonzero(fresh[stay])
            last = fresh == len(sym) - 1
            rank[fresh[last]] = NONE
            fresh = fresh[~last]
            same = seq[fresh] == seq[fresh + 1]
            rank[fresh[~same]] = NONE
            fresh = fresh[same]
            rank[fresh] = self._ranks(sym[fresh] * self.n + sym[fresh + 1])
        return out

    def merged_long(self, token: bytes) -> int:
        """``merged`` for one pre-token of any length: each round merges the pairs of the lowest rank, wherever they are, and
        looks again only at the pairs beside them. A pair with a symbol that a merge made has a higher rank than that merge,
        so each rank has one round at most."""
        n = len(token)
        sym = self.byte_id[np.frombuffer(token, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE, np.int64)
        places: dict[int, list] = {}
        queue: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[after[at] < n]
            r = self._ranks(sym[at] * self.n + sym[after[at]])
            rank[at] = r
            at, r = at[r < NONE], r[r < NONE]
            o = np.argsort(r, kind="stable")
            at, r = at[o], r[o]
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
            for k, part in zip(r[edge].tolist(), np.split(at, edge[1:]), strict=False):
                if k not in places:
                    places[k] = []
                    heapq.heappush(queue, k)
                places[k].append(part)

        look(np.arange(n))
        left = n
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # a run of equal symbols: every other pair of it
                head = np.concatenate([[True], after[at[:-1]] != at[1:]])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            gone = after[at]
            rank[at], rank[gone] = NONE, NONE
            sym[at] = self.made[r]
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left -= len(at)
            beside = before[at]
            fresh = np.unique(np.concatenate([at, beside[beside >= 0]]))
            rank[fresh] = NONE
            look(fresh)
        return left

    def counts(self, tokens: set[str]) -> dict[str, int]:
        """How many symbols remain of each pre-token."""
        out, part, size = {}, [], 0
        for t in tokens:
            data = t.encode()
            if len(data) >= LONG:
                out[t] = self.merged_long(data)
                continue
            part.append((t, data))
            size += len(data)
            if size >= AT_ONCE:
                out.update(zip([x for x, _ in part], self.merged([x for _, x in part]).tolist(), strict=True))
                part, size = [], 0
        if part:
            out.update(zip([x for x, _ in part], self.merged([x for _, x in part]).tolist(), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut, fixed = [], []
        for t in texts:
            if self.special is not None and any(s in t for s in self.specials):
                parts = self.special.split(t)
                cut.append([x for p in parts for x in self.cut(p)])
                fixed.append(len(parts) - 1)
            else:
                cut.append(self.cut(t))
                fixed.append(0)
        new = {x for c in cut for x in c}.difference(self.known)
        self.known.update(self.counts(new))
        known = self.known.__getitem__
        n = [sum(map(known, c)) + k for c, k in zip(cut, fixed, strict=True)]
        for x in new:
            if len(x) > SHORT:
                del self.known[x]
        return n


def token_counts(docs: DataFrame, content: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text); ``content``: the
    tokenizer's file, byte-level BPE without a normalizer; others are refused.

    Counts are of whole texts, as the tokenizers library gives them without added special tokens: a special token's
    string inside a text counts as one token. A null text counts as empty: 0 bytes, 0 tokens. Rows are independent of
    each other: equal rows give equal results, null doc_ids are kept, other columns ignored, an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(content)
    made: list[Counter] = []

    def count(batches):
        if not made:
            made.append(Counter(sent.value))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n: list[int] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < 1 << 20:
                    size += len(texts[j])
                    j += 1
                n += made[0].count(texts[i:j])
                i = j
            if texts:
                tokens = np.array(n, np.int64)
                yield batch(doc_id=b.column("doc_id"), n_bytes=np.array([len(t.encode()) for t in texts], np.int64), n_tokens=tokens, over_limit=tokens > limit)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Tokens of each document under a public vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        return token_counts(table(spark, sf_dir, "documents"), f.read())
