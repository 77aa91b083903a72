"""Ranked lexical search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import ROWS, docs

from ticklens.llm import bitsliced
from ticklens.llm.queries import queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_scores(rows, items):
    """Per item all (score, doc_id) above 0, by the definition."""
    texts = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n_docs, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in texts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if t in c)
            if score > 0:
                found.append((score, i))
        out.append((item, sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))))
    return out


def expected(rows, items, top=50):
    return [(item, k + 1, i, score) for item, found in brute_scores(rows, items) for k, (score, i) in enumerate(found[:top])]


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    vocabulary = [f"wörd{k}" if k % 7 == 0 else f"w{k}" for k in range(900)]
    weights = [1 / (k + 1) for k in range(900)]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 30, 200, 900])))) for i in range(700)]
    rows += [(700 + k, rows[k][1].upper() + "!") for k in range(40)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30)))) for k in range(25)]
    items += [(25, "w0"), (26, "nowhere at all"), (27, "w1 w1 w2"), (28, rows[5][1])]
    return rows, items


def test_ranks_against_all_scores(spark, corpus):
    rows, items = corpus
    assert order(got(bitsliced.search(docs(spark, rows), item_table(spark, items)))) == order(expected(rows, items))


@pytest.mark.parametrize("change", [("BLOCK_ROWS", 8), ("BITS_PER_KEY", 1), ("WIDEST", 512), ("PROBES", 1)])
def test_false_marks_and_block_sizes_change_nothing(spark, corpus, monkeypatch, change):
    rows, items = corpus
    monkeypatch.setattr(bitsliced, *change)
    assert order(got(bitsliced.search(docs(spark, rows), item_table(spark, items), top=10))) == order(expected(rows, items, 10))


def test_items_in_several_passes(spark, corpus):
    rows, items = corpus
    assert order(got(bitsliced.search(docs(spark, rows), item_table(spark, items), per_pass=7))) == order(expected(rows, items))


def test_bounds_are_bounds_and_close(spark, corpus):
    rows, items = corpus
    known = bitsliced.Items(items)
    batch = docs(spark, rows).select("doc_id", "text").toArrow().to_batches()
    df = Counter()
    for found in bitsliced._frequencies(known)(batch):
        df.update(dict(zip(found["term"].to_pylist(), found["df"].to_pylist())))
    counts = [len(words(t)) for _, t in rows]
    known.weighed(len(rows), sum(counts), df)
    text = dict(rows)
    loose = []
    for ids, lengths, most, width, slices in bitsliced._blocks_of(bitsliced._indexed(batch)):
        bounds = known.bounds(lengths, most, width, slices)
        exact = np.array([known.scores(text[i].encode(), list(range(len(items)))) for i in ids.to_pylist()]).T
        assert (bounds >= exact).all()
        loose += (bounds[exact > 0] / exact[exact > 0]).tolist()
    assert np.median(loose) < 1.05


def test_many_equal_scores_are_ordered_by_id(spark):
    rows = [(i, "same words here") for i in range(300)] + [(300 + i, "other") for i in range(300)]
    want = [(1, k + 1, k, None) for k in range(50)]
    found = order(got(bitsliced.search(docs(spark, rows).repartition(5), item_table(spark, [(1, "words")]))))
    assert [f[:3] for f in found] == [w[:3] for w in want]


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    items = [(1, "one two word"), (1, "identifier"), (None, "short text"), (2, None), (3, ""), (4, "x" * 50_000), (5, "!!"),
             (6, "日本語 café 😀"), (7, "text " * 20_000)]
    table = docs(spark, ROWS, extra)
    assert order(got(bitsliced.search(table, item_table(spark, items)))) == order(expected(ROWS, items))


def test_nothing_to_rank(spark):
    items = item_table(spark, [(1, "one")])
    assert got(bitsliced.search(docs(spark, []), items)) == []
    assert got(bitsliced.search(docs(spark, [(1, None), (2, "?!")]), items)) == []
    assert got(bitsliced.search(docs(spark), item_table(spark, []))) == []
    assert got(bitsliced.search(docs(spark), item_table(spark, [(1, None), (2, "--")]))) == []


def test_query_against_all_scores(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert order(got(queries()["op13_lexical_search"](spark, sf))) == order(expected(rows, items))
