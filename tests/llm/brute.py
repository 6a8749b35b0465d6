"""Plain versions of the operators, for small inputs."""

import collections
import re

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return [w for w in re.split("[\x20\x09-\x0d]+", text.translate(LOWER) if lower else text) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """doc_id -> (n_shingles, least linked doc_id) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def deduplicated(rows, size=13):
    """doc_id -> (n_words, kept words)."""
    texts = [(i, words(t, lower=False)) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in texts:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out[i] = (len(w), [x for p, x in enumerate(w) if p not in gone])
    return out
