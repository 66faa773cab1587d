"""Plain counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size, 0) + 1)}


def jaccard_components(rows, size, percent):
    """{key: (set size, smallest key reachable)} over (key, text) rows."""
    sets = [(k, shingle_set(t, size)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def repeated(rows, window):
    """(key, words, removed, sha256) over (key, text) rows with different keys."""
    first, out = {}, []
    for k, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if first.setdefault(w, (k, i)) != (k, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((k, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def edit_matches(docs, items, similarity, words):
    """{(key, item): least edits} where a run of words is near the item; by full dynamic programming."""
    out = {}
    for key, text in docs:
        d = words(text)
        for item, item_text in items:
            w = words(item_text)
            if not w:
                continue
            # full dynamic programming, one row of the table at a time
            across = np.arange(len(d) + 1)
            row = np.zeros(len(d) + 1, dtype=np.int64)
            for i, x in enumerate(w, 1):
                best = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in d], dtype=np.int64))
                row = np.minimum.accumulate(np.r_[i, best] - across) + across
            edits = int(row.min())
            if edits <= int(len(w) * (1 - similarity) + 1e-9):
                out[key, item] = edits
    return out
