"""License scans with a positional rare-token index (operator 6).

Templates are word sequences of licence notices with a mandatory key phrase. Document frequencies
of the templates' words are counted over the whole corpus; every template is indexed by ``ANCHORS`` words
with their positions: its lead, the rarest word (highest IDF) of the key phrase, and the rarest words outside
the key phrase. For a file, the postings of the words it holds are intersected by place, which is the position in
the file minus that in the template: a place is followed up only if the lead and another anchor agree
on it (for a template that is nothing but its key phrase, as base phrases are, the lead alone). It counts only
if the mandatory key phrase stands there word by word. The rarest word of a key phrase occurs in every
place of the phrase, so no place is missed, however frequent its other words are. A key phrase that
stands without the words around it is no notice.

Base phrases are templates whose key phrase is the whole phrase. ``n_base`` counts all their
places; ``labels`` adds the other templates found. ``score`` is the largest IDF-weighted share of a
found template's words that stand at their places. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z. Null and empty texts have no words, empty labels and score 0. Files are
scanned one by one and whole, however long: null or repeated doc_ids and further columns, whatever their names,
change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import text_of

#: index words per template: the lead and others outside the key phrase
ANCHORS = 3

# FIXED VALUES: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# FIXED VALUES: opening words of licence notices, with the key phrase that must be there
NOTICES = {
    "agpl": ("gnu affero general public license", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "cc by nd"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("cc0 1 0 universal public domain dedication", "cc0 1 0"),
    "creative-commons": ("licensed under a creative commons attribution 4 0 international license",
                         "creative commons attribution"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted", "permission to use copy modify and or distribute this software"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", "permission is hereby granted free of charge"),
    "mit-named": ("licensed under the mit license", "mit license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  "free and unencumbered software"),
}

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


@dataclass
class Template:
    label: str
    words: list[bytes]
    key: list[bytes]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i:i + n] == self.key)


def templates() -> list[Template]:
    base = [Template(label, p.encode().split(), p.encode().split(), True) for p, label in BASE.items()]
    return base + [Template(label, notice.encode().split(), key.encode().split(), False)
                   for label, (notice, key) in NOTICES.items()]


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, idf: dict[bytes, float], found: list[Template] | None = None):
        self.templates = found or templates()
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int, bool]]] = {}
        self.weight, self.alone = [], []
        for t, template in enumerate(self.templates):
            rare = lambda w: (-idf.get(w, 0.0), w)
            lead = min(template.key, key=rare)
            lead_at = template.key_at + template.key.index(lead)
            others = sorted(set(template.words) - set(template.key), key=rare)[:ANCHORS - 1]
            self.alone.append(not others)
            self.postings.setdefault(lead, []).append((t, lead_at, True))
            for word in others:
                for at, w in enumerate(template.words):
                    if w == word:
                        self.postings.setdefault(word, []).append((t, at, False))
            self.weight.append(sum(idf.get(w, 0.0) for w in template.words) or 1.0)

    def scan(self, words: list[bytes]) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score) of a file."""
        postings = self.postings
        places = {w: [] for w in postings.keys() & set(words)}
        if places:
            for i, w in enumerate(words):
                if w in places:
                    places[w].append(i)
        leads: set[tuple[int, int]] = set()
        votes: set[tuple[int, int]] = set()
        for word in sorted(places, key=lambda w: -self.idf.get(w, 0.0)):
            for t, at, lead in postings[word]:
                (leads if lead else votes).update((t, i - at) for i in places[word])
        starts: set[int] = set()
        base_labels, labels, score, n_base = set(), set(), 0.0, 0
        for t, start in leads:
            if not (self.alone[t] or (t, start) in votes):
                continue
            template = self.templates[t]
            key_at = start + template.key_at
            if key_at < 0 or words[key_at:key_at + len(template.key)] != template.key:
                continue
            labels.add(template.label)
            if template.base:
                base_labels.add(template.label)
                starts.add(start)
                n_base += 1
            there = sum(self.idf.get(w, 0.0) for k, w in enumerate(template.words)
                        if 0 <= start + k < len(words) and words[start + k] == w)
            score = max(score, min(1.0, there / self.weight[t]) if there else 1.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return (len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def idf_of_index_words(docs: DataFrame) -> dict[bytes, float]:
    """IDF of every template word over all documents; as many rows as there are template words."""
    vocabulary = sorted({w for t in templates() for w in t.words})

    def count(frames):
        known, counts, n = set(vocabulary), Counter(), 0
        for frame in frames:
            for text in frame["text"]:
                counts.update(known.intersection(words_of(text)))
                n += 1
        yield pd.DataFrame([(w.decode(), c) for w, c in counts.items()] + [("", n)], columns=["word", "docs"])

    rows = (docs.select(text_of().alias("text")).mapInPandas(count, "word string, docs long")
            .groupBy("word").agg(F.sum("docs").alias("docs")).collect())
    found = {r["word"]: r["docs"] for r in rows}
    n = found.pop("", 0)
    return {w: math.log((n + 1.0) / (found.get(w.decode(), 0) + 0.5)) for w in vocabulary}


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def scanned(text: Column, idf: dict[bytes, float]) -> Column:
    """Struct (see ``RESULT``) for each text."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        index = Index(idf)
        frame = pd.DataFrame([index.scan(words_of(t)) for t in texts], columns=names)
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``RESULT``; one row per row of ``docs``."""
    found = docs.select("doc_id", scanned(text_of(), idf_of_index_words(docs)).alias("found"))
    return found.select("doc_id", "found.*")
