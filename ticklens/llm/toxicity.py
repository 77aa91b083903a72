"""Toxicity by a weighted lexicon with Aho-Corasick matching (operator 5).

Folding: compatibility forms (full-width letters) to plain ones, lower case, homoglyphs of other
scripts and accents on Latin letters to the plain letter they imitate (only inside words that mix
scripts or digits, so that foreign words keep their letters), digits and signs that stand for letters
to those letters, repeated letters to one pair. Zero-width characters and loose combining marks inside
a word with Latin letters are dropped, and make it a mixed word; other words end there. A word with
signs at an edge has two readings, without them and with them as letters ("idiot!", "@sshole"); it
counts once, by the heavier reading.

Lexicon: word beginnings and whole words that are in more labelled toxic documents than chance
explains. Of all beginnings seen in k documents some are in toxic ones only by chance; with b of k toxic,
their expected number is at most the number of such candidates times exp(-k D), D the relative entropy of
b/k to the share of toxic documents. An entry is taken if that is at most ``BY_CHANCE``, so rare fragments of ordinary
words stay out however many there are. Its weight is the lower confidence bound of the log odds ratio. It is
learned from a bounded sample of labelled rows (``SAMPLE_ROWS``), counted as Spark aggregations
in which equal texts (but for case and white space) count once. At most ``MAX_ENTRIES`` entries reach the
driver; a warning tells when there were more. Exception phrases are word pairs around an entry that clean
labelled documents use and toxic ones do not; a match inside one does not count.

Score: the matched weight of a text, divided by a power of its length, through a logistic curve
that is fitted on the same sample (a histogram of bounded size). Labels, language, source and
doc_id never enter a score. Null and empty texts match nothing and score as such. Rows are scored
one by one, so null or repeated doc_ids and further columns, whatever their names, change nothing. A text is
scored whole in one task, however long. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ticklens.llm.common import stored, text_of
from ticklens.llm.vocab import Memo

#: labelled rows that the lexicon and the curve are learned from, at most
SAMPLE_ROWS = 20_000
#: lexicon entries and exception phrases that reach the driver, at most
MAX_ENTRIES = 2_000
#: entries expected in the lexicon by chance, at most, for each number of documents with the entry; of 1, 5, 20,
#: 100 and 300 the one with the least log loss over three inner folds of the learned rows of a 10,000-row corpus
BY_CHANCE = 100.0
#: (entry, label) counts that a task holds before it passes them on
COUNTED_AT_ONCE = 150_000
#: rows with crc32(doc_id as text) % FOLDS == HELD_OUT are never learned from
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

# FIXED VALUES: letters of other scripts that look like a Latin one, and signs read as letters
HOMOGLYPHS = str.maketrans({
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
})
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
                        "@": "a", "$": "s", "!": "i"})
# FIXED VALUES: harmless phrases around words that are otherwise insults, for a lexicon that is not learned
HARMLESS = ("trash can", "trash bin", "clown fish", "clown fishes", "pathetic fallacy")
#: Latin letters with a stroke, which have no decomposition
STROKES = str.maketrans("øłđħŧɨƀ", "oldhtib")

# zero-width characters, combining marks and variation selectors
_LOOSE = ("\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufeff"
          "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f")
_MARKS = re.compile(f"[{_LOOSE}]+")
# signs before a word only where a run of them begins, so that a long run is read once
_WORD = re.compile(rf"(?:(?<![@$!])[@$!]++)?[^\W_](?:[\w@$!{_LOOSE}]*[^\W_])?[@$!]*")
_PLAIN = re.compile(r"[a-z]+\Z")
_REPEATS = re.compile(r"([a-z])\1{2,}")
_BREAK = "\n"


def _bare(letter: str) -> str:
    """The plain Latin letter under accents or a stroke, or the letter itself."""
    base = unicodedata.normalize("NFKD", letter)[0].translate(STROKES).translate(HOMOGLYPHS)
    return base if "a" <= base <= "z" else letter


def _latin(word: str) -> bool:
    return any("a" <= c <= "z" for c in word)


def folded_word(word: str, mixed: bool = False) -> str:
    """A lower-case word as the lexicon spells it."""
    if _PLAIN.match(word):
        return _REPEATS.sub(r"\1\1", word) if len(word) > 4 else word
    if any(c.isdigit() or c in "@$!" for c in word) and any(c.isalpha() for c in word):
        word = word.translate(DIGITS)
        mixed = True
    if not word.isascii():
        turned = word.translate(HOMOGLYPHS)
        # Greek and Cyrillic letters beside Latin ones
        mixed = mixed or _latin(word) and any("\u0370" <= c <= "\u052f" for c in word)
        if turned.isascii() or _latin(word):
            word = turned
        if mixed and _latin(word):
            word = "".join(map(_bare, word))
    return _REPEATS.sub(r"\1\1", word)


def _readings(word: str) -> list[str]:
    """The folded words of a matched word; the readings of one word are joined by ``_BREAK``."""
    if _PLAIN.match(word):
        return [folded_word(word)]
    core = word.strip("@$!")
    mixed = False
    if _MARKS.search(core):
        if not _latin(core):
            return [r for part in filter(None, _MARKS.split(core)) for w in _WORD.findall(part) for r in _readings(w)]
        word, core, mixed = _MARKS.sub("", word), _MARKS.sub("", core), True
    plain = folded_word(core, mixed)
    if core == word or not any(c.isalpha() for c in core):
        return [plain]
    others = (folded_word(w, True) for w in (word.rstrip("@$!"), word.lstrip("@$!"), word))
    return [_BREAK.join(dict.fromkeys((plain, *others)))]


def _folded(word: str) -> str:
    return " ".join(_readings(word))


#: folded words that a worker remembers, at most, and the length of a word it remembers, at most
KNOWN_WORDS, KNOWN_LENGTH = 200_000, 40
_KNOWN = Memo(_folded, KNOWN_WORDS, KNOWN_LENGTH)


def folded_words(text: str) -> list[str]:
    """The words of a text as the lexicon spells them; a word of several readings has all of them,
    the one without signs at its edges first, joined by ``_BREAK``."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    found = [_KNOWN[w] for w in _WORD.findall(text.lower())]
    return " ".join(found).split(" ") if found else []


def _first(word: str) -> str:
    return word.partition(_BREAK)[0]


@dataclass
class Lexicon:
    """Weighted entries (``^abc`` a beginning, ``^abc$`` a whole word) and the score's curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = HARMLESS
    slope: float = 0.0
    intercept: float = -4.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry.replace("^", _BREAK).replace("$", _BREAK), (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(_BREAK + phrase.replace(" ", _BREAK) + _BREAK, (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


#: exponent of the length by which the matched weight is divided, and words added to any length
LENGTH_POWER, LENGTH_PAD = 0.75, 50


def density(words: list[str], automaton) -> float:
    """Matched weight per length: each word counts the heaviest entry of its readings, unless inside
    an exception."""
    if not words or not len(automaton):
        return 0.0
    line = _BREAK + _BREAK.join(words) + _BREAK
    more = line.count(_BREAK) > len(words) + 1          # some word has several readings
    if more:
        plain = list(map(_first, words))
        line = _BREAK + _BREAK.join(plain) + _BREAK
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(line):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    if more:
        start = 0
        for word, first in zip(words, plain):
            if len(word) > len(first):
                for _, (_, weight) in automaton.iter(word[len(first):] + _BREAK):
                    if weight is not None and weight > hits.get(start, 0.0):
                        hits[start] = weight
            start += len(first) + 1
    total = sum(w for start, w in hits.items() if not any(a <= start < b for a, b in spared))
    return total / (len(words) + LENGTH_PAD) ** LENGTH_POWER


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out third (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _entries(word: str) -> list[str]:
    return [f"^{word[:k]}" for k in range(3, min(len(word), 12) + 1)] + [f"^{word}$"]


def _count_entries(frames):
    """Documents per entry and label, summed up to bounded size per task."""
    counts: Counter = Counter()
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            entries = {e for w in set(_BREAK.join(folded_words(text)).split(_BREAK)) if w for e in _entries(w)}
            counts.update((e, toxic) for e in entries)
            if len(counts) > COUNTED_AT_ONCE:
                yield _entry_frame(counts)
                counts.clear()
    yield _entry_frame(counts)


def _entry_frame(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(e, n if t else 0, 0 if t else n) for (e, t), n in counts.items()],
                        columns=["entry", "bad", "good"])


def _normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of a bounded sample of labelled rows outside the held-out third.

    The sample is the ``SAMPLE_ROWS`` rows with the smallest hash of doc_id, hence small enough to
    broadcast; of documents with the same normalised text and label the one with the smallest doc_id
    is taken, every other one counts. A doc_id that is repeated gives one row, its smallest text, so the
    rows are as bounded as the ids.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    sample = (usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    rows = (docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").where("text <> ''")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    return (rows.groupBy(F.sha2(_normalised(F.col("text")), 256).alias("digest"), F.col("toxic").cast("int").alias("toxic"))
            .agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "toxic"))


def _bound(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """Log odds ratio less 1.5 standard errors."""
    b, g = bad + F.lit(0.5), good + F.lit(0.5)
    spread = F.sqrt(F.lit(1.0) / b + F.lit(1.0) / g)
    return F.log(b / F.lit(n_bad + 1.0)) - F.log(g / F.lit(n_good + 1.0)) - F.lit(1.5) * spread


def _by_chance(share: float) -> Column:
    """Bound on the expected number of entries that chance puts into as many toxic documents (``bad`` of ``seen``;
    ``rivals`` entries are in ``seen`` documents), where toxic documents have the given share."""
    k, b = F.col("seen"), F.col("bad") / F.col("seen")
    entropy = b * F.log(b / F.lit(share)) + F.when(b < 1, (1 - b) * F.log((1 - b) / F.lit(1 - share))).otherwise(0.0)
    return F.when(b <= F.lit(share), F.col("rivals")).otherwise(F.col("rivals") * F.exp(-k * entropy))


def _chosen(rows: list) -> dict[str, float]:
    """Entries by falling weight, none that an earlier one already covers.

    Of nested beginnings that weigh the same the longest is taken: it says no more than was seen.
    """
    taken: dict[str, float] = {}
    beginnings: set[str] = set()       # every beginning of a taken entry
    for entry, weight in sorted(rows, key=lambda r: (-round(r[1], 1), r[0].endswith("$"), -len(r[0]), r[0])):
        stem = entry.rstrip("$")
        if any(stem[:k] in taken for k in range(4, len(stem) + 1)) or (entry == stem and stem in beginnings):
            continue
        taken[entry] = weight
        beginnings.update(stem[:k] for k in range(1, len(stem) + 1))
    return taken


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon and curve from the labelled rows; without both labels it matches nothing."""
    rows = stored(training_rows(docs, labels), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Lexicon()
    counted = stored(rows.mapInPandas(_count_entries, "entry string, bad long, good long")
                     .groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-entries")
    seen = (F.col("bad") + F.col("good")).alias("seen")
    rivals = counted.groupBy(seen).agg(F.count("*").alias("rivals"))     # no more rows than documents in the sample
    weighed = (counted.where("bad >= 2").select("*", seen).join(rivals, "seen")
               .where(_by_chance(n_bad / (n_bad + n_good)) <= F.lit(BY_CHANCE))
               .select("entry", _bound(F.col("bad"), F.col("good"), n_bad, n_good).alias("w")).where("w > 1.2"))
    best = weighed.orderBy(F.desc(F.round("w", 1)), F.desc(F.length("entry")), "entry").limit(MAX_ENTRIES + 1).collect()
    if len(best) > MAX_ENTRIES:
        warnings.warn(f"more than {MAX_ENTRIES} lexicon entries; those of the least weight are left out", stacklevel=2)
        best = best[:MAX_ENTRIES]
    lexicon = Lexicon(_chosen([(r["entry"], float(r["w"])) for r in best]))
    lexicon.exceptions = tuple(_exceptions(rows, lexicon))
    lexicon.slope, lexicon.intercept = _curve(rows, lexicon)
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Word pairs around a match in at least three clean documents and no toxic one."""
    def pairs(frames):
        automaton = Lexicon(lexicon.weights, ()).automaton()
        for frame in frames:
            out = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = folded_words(text)
                known = {w: len(w) > 0 and density([w], automaton) > 0 for w in set(words)}
                hit = [known[w] for w in words]
                words = list(map(_first, words))
                near = {(a, b) for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}
                out += [(f"{a} {b}", int(toxic), 1 - int(toxic)) for a, b in near]
            yield pd.DataFrame(out, columns=["phrase", "bad", "good"])

    counted = (rows.mapInPandas(pairs, "phrase string, bad long, good long").groupBy("phrase")
               .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad = 0 and good >= 3"))
    return [r["phrase"] for r in counted.orderBy(F.desc("good"), "phrase").limit(MAX_ENTRIES).collect()]


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps on a histogram of densities."""
    x = F.round(_density_column(lexicon)(F.col("text")), 2)
    table = rows.select(F.least(x, F.lit(20.0)).alias("x"), "toxic").groupBy("x").agg(
        F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
    xs = np.array([r["x"] for r in table])
    bad = np.array([r["bad"] for r in table], dtype=float)
    n = np.array([r["n"] for r in table], dtype=float)
    beta = np.zeros(2)
    design = np.stack([np.ones_like(xs), xs])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        # a weak pull to zero keeps separable samples finite
        gradient = design @ (bad - n * p) - 1e-3 * beta
        hessian = (design * (n * p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[1], 0.0)), float(beta[0])


def _density_column(lexicon: Lexicon):
    @F.pandas_udf(DoubleType())
    def measure(texts: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        return pd.Series([density(folded_words(t), automaton) if t else 0.0 for t in texts], dtype="float64")

    return measure


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score between 0 and 1 of each text."""
    x = _density_column(lexicon)(text)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * x)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    lexicon = learn(docs, labels)
    return (docs.select("doc_id", held_out().alias("held_out"), score(text_of(), lexicon).alias("score"))
            .withColumn("predicted", (F.col("score") >= F.lit(THRESHOLD)).cast("int")))
