"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text, fold=True):
    return SPACE.findall((text or "").translate(FOLD) if fold else text or "")


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(rows, num=90, den=100):
    """[(id, n_shingles, n_similar, component_id)] in the order of rows (id, text)."""
    sets = [shingle_set(t) if i is not None else set() for i, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    n = Counter()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                    n[a] += 1
                    n[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for v in range(len(rows)):
        groups[find(v)].append(v)
    least = {v: min(rows[u][0] for u in vs) if rows[v][0] is not None else None for vs in groups.values() for v in vs}
    return [(i, len(shingle_set(t)), n[v], least[v]) for v, (i, t) in enumerate(rows)]


def quality_counts(text):
    w = words(text, fold=False)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)
