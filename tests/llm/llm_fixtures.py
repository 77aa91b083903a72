"""Small tables and brute-force versions for the operator tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use for themselves
CLASHING = "kept boolean, component_id long, score double, digest string, rate double, copies long, ids string, row long"

#: null, empty, white space, short, long, repeated and tied rows
ROWS = [
    (1, "one two three four five six seven eight"),
    (2, "One  two three\tfour five six seven eight"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "short text"),
    (7, "short\ntext"),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (10, "the <|endoftext|> mark, café naïve 日本語 \U0001f600 end"),
    (10, "a second row with the same identifier as another one"),
    (None, "one two three four five six seven eight"),
    (None, None),
    (11, "This work is licensed under the GNU General Public License, version 3. All rights reserved. cc by"),
]


def docs(spark, rows=None, extra=False):
    rows = ROWS if rows is None else rows
    full = [(i, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    if extra:
        full = [r + (None,) * 8 for r in full]
    return spark.createDataFrame(full, f"{DOC_SCHEMA}, {CLASHING}" if extra else DOC_SCHEMA)


def shingles(text, size=5):
    """Set of shingles by the contract's rule, without hashing."""
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def near_components(rows, percent=75):
    """Smallest reachable doc_id per row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), (least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows)]


def near_copies(n_groups=12, copies=6, words=80, seed=1):
    """Texts in groups of near copies at many similarities, with a chain in each group."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for _ in range(n_groups):
        text = rnd.choices(vocabulary, k=words)
        for _ in range(copies):
            rows.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for at in rnd.sample(range(words), rnd.randint(1, 3)):
                text[at] = rnd.choice(vocabulary)
    rnd.shuffle(rows)
    return rows
