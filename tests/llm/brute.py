"""Plain Python forms of the operators, for tests."""

import re
import string
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def ngram_components(rows, percent=80, n=5):
    """rows: (doc_id, text). For each row: (doc_id, n_shingles, component_id)."""
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t, n), []).append(d)
    keys = [s for s in sets if s]
    where = {}
    for i, s in enumerate(keys):
        for g in s:
            where.setdefault(g, []).append(i)
    both = Counter(p for found in where.values() for p in combinations(found, 2))
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for (i, j), common in both.items():
        if 100 * common >= percent * len(keys[i] | keys[j]):
            up[root(i)] = root(j)
    least = {}
    for i, s in enumerate(keys):
        ids = [d for d in sets[s] if d is not None]
        least.setdefault(root(i), []).extend(ids)
    out = []
    at = {s: i for i, s in enumerate(keys)}
    for d, t in rows:
        s = shingles(t, n)
        out.append((d, len(s), min(least[root(at[s])], default=None) if s else d))
    return out


def repeats(rows, units, window):
    """rows: (key, text); ``units`` splits a text. For each key: units, and which are covered
    by a window that also starts earlier, in the order of (key, place)."""
    texts = {k: units(t) for k, t in rows}
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - window + 1):
            first.setdefault(tuple(texts[k][i:i + window]), (k, i))
    out = {}
    for k, u in texts.items():
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i:i + window])] != (k, i):
                gone[i:i + window] = [True] * window
        out[k] = (u, gone)
    return out
