"""Brute-force versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter
from statistics import NormalDist

import numpy as np


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().split()


def substrings(rows, length=50):
    """rows: (doc_id, text); doc_id: (n_words, n_removed, kept_sha256)."""
    rows = [(d, words(t)) for d, t in rows]
    first = {}
    for d, w in sorted(rows, key=lambda r: r[0]):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = {}
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def suffixes(rows, length=100):
    seen, out = set(), {}
    for d, text in sorted((d, (t or "").encode()) for d, t in rows):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[d] = (len(text), sum(gone), runs, sha(bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return out


def counts(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again)


def components(rows, n=4, numerator=85, denominator=100):
    """doc_id: (n_shingles, component_id)."""
    sets = {}
    for d, t in rows:
        w = lower(t).encode().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]) > 0:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(rows, items, n=10):
    """doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for i, t in items:
        w = _WORD.findall(lower(t))
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w = _WORD.findall(lower(t))
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit[p : p + k] = [True] * k
                    found |= windows[tuple(w[p : p + k])]
        out[d] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return out


def mcd_distances(x, floor, share=0.75, starts=60):
    """Squared distances of rows from their minimum-covariance-determinant estimate."""
    n, d = x.shape
    quantile = lambda p: d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3

    def moments(rows):
        cov = np.cov(rows.T, bias=True)
        return rows.mean(0), cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0)) + 0.1 * np.eye(d)

    def distance(mean, cov):
        return (((x - mean) @ np.linalg.inv(cov)) * (x - mean)).sum(1)

    rng, best, h = np.random.default_rng(1), None, int(np.ceil(share * n))
    spread = np.maximum(np.median(np.abs(x - np.median(x, 0)), 0) * 1.4826, np.maximum(floor, 1))
    for k in range(starts):
        mean, cov = (np.median(x, 0), np.diag(spread**2)) if not k else moments(x[rng.choice(n, d + 1, replace=False)])
        for _ in range(60):
            mean, cov = moments(x[np.argsort(distance(mean, cov))[:h]])
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    _, mean, cov = best
    cov = cov * max(np.median(distance(mean, cov)) / quantile(0.5), 1)
    mean, cov = moments(x[distance(mean, cov) <= quantile(0.975)])
    return distance(mean, cov * max(np.median(distance(mean, cov)) / quantile(0.5), 1))
