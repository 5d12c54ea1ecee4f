"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import numpy as np


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def near_duplicates(docs, k=4, percent=80):
    """{doc_id: (n_shingles, component, kept)} by comparing all pairs."""
    sets, groups = {i: shingle_set(t, k) for i, t in docs}, Union()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        groups.find(a)
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i), groups.find(i) == i) for i in ids}


def near_vectors(rows, threshold=0.95):
    """{vec_id: (n_links, component, kept)} by all cosines."""
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, groups = {i: 0 for i, _ in rows}, Union()
    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i), groups.find(i) == i) for i, _ in rows}
