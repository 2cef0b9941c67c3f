"""Brute-force versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def terms(t):
    return re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", fold(t))


def solid(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def classes(rows, threshold=0.8):
    """{doc: (class, copies, links)}"""
    sets, words = {}, {}
    for i, t in rows:
        w = words[i] = tuple(terms(t))
        sets[i] = {w[j : j + 5] for j in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    same = Counter(w for w in words.values() if w)
    return {i: (find(i), same[words[i]] if words[i] else 1, links[i]) for i in ids}


def substrings(rows, n=100):
    """{doc: (bytes, removed, spans, digest)}"""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(s)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def line_runs(rows, least=50):
    """{doc: kept text}"""
    seqs = [(i, (t or "").split("\n")) for i, t in sorted(rows)]
    seqs = [(i, ls, [(k, tuple(solid(x))) for k, x in enumerate(ls) if solid(x)]) for i, ls in seqs]
    out = {}
    for a, (i, ls, s) in enumerate(seqs):
        gone = set()
        for b in range(len(s)):
            best = 0
            for c in range(a + 1):
                o = seqs[c][2]
                for e in range(len(o) if c < a else b):
                    n = 0
                    while b + n < len(s) and e + n < len(o) and s[b + n][1] == o[e + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(len(s[b + x][1]) for x in range(best)) >= least:
                gone |= {s[b + x][0] for x in range(best)}
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def top(vectors, queries, k):
    """{query: [(score, id)]}"""
    out = {}
    for q in queries:
        if q in vectors:
            s = [(-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            out[q] = [(-x, i) for x, i in sorted(s)[:k]]
    return out


def unigram(rows, mod=7, rest=2):
    """{doc: (held out, tokens, known, N, base)}"""
    words = {i: [*solid(fold(t)), "\n"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % mod == rest for i, _ in rows}
    c = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (out[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


def leaks(docs, items, least=13, shortest=8):
    """{(doc, text, item): (matched, length, doc word, item word)}"""
    out = {}
    for d, t in docs:
        a = terms(t)
        for m, u in items:
            b = terms(u)
            if d is None or m is None or t is None or u is None or len(b) < shortest:
                continue
            for shift in range(1 - len(b), len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                for x in range(lo, hi):
                    n = 0
                    for y in range(x, hi):
                        n += a[y] == b[y - shift]
                        if n >= min(least, len(b)) and 5 * n >= 4 * (y + 1 - x):
                            new = (-n, y + 1 - x, x, x - shift)
                            out[d, t, m] = min(out.get((d, t, m), new), new)
    return {k: (-n, *v) for k, (n, *v) in out.items()}
