"""Small documents with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import random
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid int, score string, text_key int"


def prose(seed: int, n: int, words: int = 40) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(words)}" for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); further columns have names that operators use themselves."""
    full = [(i, t, g, s, None if t is None else len(t), 7, "s", 1) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 90)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "b"), (4, base + " tail end", "en", None),
        (5, None, None, None), (6, "", "en", "a"), (7, "   \t\n ", "en", "b"), (8, "one", "de", "a"), (9, "one two three", "de", "c"), (10, "One two three", "de", "c"),
        (11, other, "fr", "b"), (12, " ".join(other.split()[:80] + ["changed"] + other.split()[81:]), "fr", "b"), (13, prose(3, 5000), "en", "a"),
        (14, "again " * 300, "en", "b"), (15, prose(4, 30) + "\n" + base, "en", "c"), (None, "no id at all", "en", "a"), (None, None, None, None),
        (2, other + " second text of id two", "en", "a"), (8, "one", "de", "a"), (20, "é ü ß x \U0001F600", "de", "ü"),
    ]


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs; rows of (doc_id, text) with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    union, ids = Union(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def removed_words(rows, window=20):
    """{doc_id: (n_words, kept words)} by reading all windows in order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        under = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                under[s:s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), [w for w, x in zip(words, under, strict=True) if not x])
    return out


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out
