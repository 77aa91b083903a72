"""Embedding near-duplicates and whitening."""

import math

import numpy as np
import pytest

from ticklens.llm import rpforest, whitening
from ticklens.llm.bidiagonal import bidiagonal, dqds, right_singular
from ticklens.llm.queries import queries

SCHEMA = "vec_id long, embedding array<double>, label int"
#: extra columns whose names the operators use for themselves
CLASHING = ", digest string, w int, core string, links int, component int, x string, dim string, n int, rep int"


def table(spark, rows, extra=False):
    rows = [(i, v, None) + ((None,) * 9 if extra else ()) for i, v in rows]
    return spark.createDataFrame(rows, SCHEMA + (CLASHING if extra else ""))


def brute_links(rows):
    """(vec_id, n_links, component_id) per row, all pairs compared."""
    unit = []
    for _, v in rows:
        fine = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=float) if fine else None
        unit.append(x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() if fine else None)
    a, b = [], []
    for i, x in enumerate(unit):
        for j in range(i):
            if x is not None and unit[j] is not None and len(x) == len(unit[j]) and x @ unit[j] >= 0.9:
                a.append(j)
                b.append(i)
    root = rpforest.local_roots(len(rows), np.array(a, int), np.array(b, int))
    links = np.bincount(np.array(a + b, int), minlength=len(rows))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return [(i, int(links[k]), least.get(root[k]) if unit[k] is not None else i) for k, (i, _) in enumerate(rows)]


def clustered(n_groups, size, lone, dim=24, noise=(0.05, 0.28), seed=3):
    """Vectors in groups from very close to the threshold, and vectors on their own."""
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        centre = rnd.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        spread = noise[0] + (noise[1] - noise[0]) * g / max(n_groups - 1, 1)
        for _ in range(size):
            step = rnd.standard_normal(dim)
            rows.append((centre + spread * step / np.linalg.norm(step)) * rnd.uniform(0.5, 2))
    rows += list(rnd.standard_normal((lone, dim)))
    order = rnd.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[at]]) for k, at in enumerate(order)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=key)


# ------------------------------------------------------------------ near-duplicates (11)

def test_links_against_all_pairs(spark):
    rows = clustered(30, 12, 400)
    want = brute_links(rows)
    found = got(rpforest.near_vectors(table(spark, rows), leaf=64))
    total = sum(w[1] for w in want)
    assert total > 2000
    assert all(f[1] <= w[1] for f, w in zip(found, want))           # none below the threshold
    assert sum(f[1] for f in found) >= 0.99 * total
    assert sum(f == w for f, w in zip(found, want)) >= 0.95 * len(rows)


def test_recall_at_the_threshold_over_deep_trees(spark):
    """Pairs with cosines 0.9 to 0.92 only, leaves so small that trees are deep."""
    rnd = np.random.default_rng(5)
    rows = []
    for k in range(1500):
        x, y = rnd.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cosine = rnd.uniform(0.9, 0.92)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (cosine * x + math.sqrt(1 - cosine ** 2) * y).tolist())]
    found = rpforest.near_vectors(table(spark, rows), leaf=64).collect()
    linked = sum(r.n_links for r in found)
    assert 0.95 * 3000 <= linked <= 3000


def test_a_dense_group_is_counted_without_comparing_it(spark, monkeypatch):
    """A third of all rows in one group, with rows around it at many distances, in small blocks."""
    monkeypatch.setattr(rpforest, "BLOCK", 50)
    rnd = np.random.default_rng(8)
    centre = rnd.standard_normal(32)
    centre /= np.linalg.norm(centre)
    rows = []
    for spread, count in ((0.05, 300), (0.3, 60), (0.45, 60), (0.7, 40)):
        for _ in range(count):
            step = rnd.standard_normal(32)
            rows.append(centre + spread * step / np.linalg.norm(step))
    rows += list(rnd.standard_normal((500, 32)))
    rows = [(int(k), [float(x) for x in rows[at]]) for k, at in enumerate(rnd.permutation(len(rows)))]
    assert len(rpforest.cores([(32, np.arange(len(rows)), rpforest.unit(np.array([v for _, v in rows])))])) >= 1
    want = brute_links(rows)
    found = got(rpforest.near_vectors(table(spark, rows)))
    assert found == sorted(want, key=key)


def test_blocks_of_a_large_leaf_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "BLOCK", 40)
    rows = clustered(8, 20, 100, dim=16, noise=(0.1, 0.3))
    assert got(rpforest.near_vectors(table(spark, rows), leaf=10_000)) == sorted(brute_links(rows), key=key)


ODD = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
    (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.1]),
    (12, [-1.0, 0.0, 0.0]), (12, [0.0, 1.0, 0.0]), (None, [1.0, 0.05, 0.0]), (None, [0.0, 0.0, 1.0]), (13, [1e-200, 0.0, 0.0]),
    (14, [1e200, 1e199, 0.0]), (15, [0.9, math.sqrt(1 - 0.9 ** 2), 0.0]), (16, [-0.0, 0.0, 3.0]),
]


@pytest.mark.parametrize("extra", [False, True])
def test_odd_vectors(spark, extra):
    assert got(rpforest.near_vectors(table(spark, ODD, extra))) == sorted(brute_links(ODD), key=key)


def test_long_vectors_and_equal_rows(spark):
    rows = [(k, [1.0] * 20_000) for k in range(30)] + [(99, [-1.0] * 20_000)]
    assert got(rpforest.near_vectors(table(spark, rows))) == sorted(brute_links(rows), key=key)


def test_no_vectors(spark):
    assert rpforest.near_vectors(table(spark, [])).collect() == []
    assert got(rpforest.near_vectors(table(spark, [(1, None)]))) == [(1, 0, 1)]


# ------------------------------------------------------------------ whitening (12)

def brute_whitening(rows, components=8):
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in fine]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    fine = [(i, v) for i, v in fine if len(v) == dim]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in fine]
    n = len(x)
    total = [sum(r[k] for r in x) for k in range(dim)]
    deviation = [sum((n * r[k] - total[k]) ** 2 for k in range(dim)) for r in x]
    centred = np.array([[(n * r[k] - total[k]) / n for k in range(dim)] for r in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in fine], n, deviation, centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / max(np.trace(cov), 1e-300)


def check_whitening(spark, rows, extra=False, tolerance=1e-9):
    ids, n, deviation, white, explained = brute_whitening(rows)
    k = white.shape[1]
    found = whitening.whitened(table(spark, rows, extra)).collect()
    assert len(found) == n * k and {r.n for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    order = [by[(i, d)] for i, d in zip(ids, deviation)]
    w = np.array([[row[c + 1].whitened for c in range(k)] for row in order])
    sign = np.sign((w * white).sum(axis=0))
    assert np.abs(w * sign - white).max() < tolerance
    assert np.abs(np.array([order[0][c + 1].explained for c in range(k)]) / explained - 1).max() < max(tolerance / 100, 1e-9)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-8


def test_whitening_against_eigenvectors(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((500, 20)) * np.linspace(2, 0.01, 20) @ np.linalg.qr(rnd.standard_normal((20, 20)))[0]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [None] * 20), (1002, [float("nan")] * 20), (1003, [1.0] * 7), (1004, [])]
    check_whitening(spark, rows, extra=True)


def test_whitening_of_few_dimensions_and_far_means(spark):
    rnd = np.random.default_rng(4)
    check_whitening(spark, [(k, [1e6 + float(a), float(b) / 50, float(a) - float(b)])
                            for k, (a, b) in enumerate(rnd.standard_normal((60, 2)) * 5) if abs(b) < 9][:50] , tolerance=1e-4)


def test_directions_without_variance(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(10)]
    found = whitening.whitened(table(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in found) and found[0].identity_error < 1e-10
    same = whitening.whitened(table(spark, [(k, [1.0, 2.0]) for k in range(3)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None
                                  and r.deviation == 0 for r in same)


def test_whitening_of_huge_entries_and_no_rows(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).collect() == []
    found = whitening.whitened(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])).collect()
    assert len(found) == 6 and {r.deviation for r in found if r.vec_id != 3} == {None}


def test_factor_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "ROWS", 8)
    rnd = np.random.default_rng(6)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rnd.standard_normal((200, 6)))]
    ids, n, deviation, white, _ = brute_whitening(rows)
    found = whitening.whitened(table(spark, rows).repartition(7)).collect()
    w = {(r.vec_id, r.component): r.whitened for r in found}
    got_w = np.array([[w[(i, c + 1)] for c in range(6)] for i in ids])
    assert np.abs(np.abs(got_w) - np.abs(white)).max() < 1e-9


@pytest.mark.parametrize("name", ["random", "graded", "equal", "split", "close", "deficient", "zero"])
def test_qd_solver(name):
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.standard_normal((20, 20)))[0]
    a = {"random": rnd.standard_normal((50, 20)), "graded": rnd.standard_normal((50, 20)) * np.logspace(0, -7, 20),
         "equal": np.diag([5.0] * 4 + [3] * 4 + [1] * 12) @ turn, "split": np.diag([3.0, 3, 3, 2, 2, 1, 1, 1, 1]),
         "close": np.diag(1 + 1e-9 * np.arange(20)) @ turn, "deficient": np.vstack([rnd.standard_normal((3, 9)), np.zeros((6, 9))]),
         "zero": np.zeros((5, 5))}[name]
    r = np.linalg.qr(a, mode="r")
    values, vectors = right_singular(r, 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - want).max() <= 1e-13 * max(want[0], 1e-300)
    m = vectors.shape[1]
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-11
    assert np.abs(r.T @ (r @ vectors) - vectors * values[:m]).max() <= 1e-12 * max(want[0], 1e-300)


def test_qd_keeps_small_values_accurate():
    """Squared singular values over sixty orders of magnitude, each to nearly full precision."""
    q, e = np.logspace(0, -60, 12), np.logspace(-1, -59, 11)
    from fractions import Fraction
    values = dqds(q, e)
    assert abs(np.log(values).sum() - np.log(q).sum()) < 1e-10          # their product is that of q, exactly
    n = len(q)
    exact = [[Fraction(0)] * n for _ in range(n)]
    for i in range(n):
        exact[i][i] = Fraction(q[i]) + (Fraction(e[i - 1]) if i else 0)
    for value in values[[0, 5, 11]]:                                    # Sturm counts just below and above, in fractions
        counts = []
        for s in (Fraction(value) * Fraction(999999999, 10 ** 9), Fraction(value) * Fraction(1000000001, 10 ** 9)):
            d, below = None, 0
            for i in range(n):
                d = exact[i][i] - s - (Fraction(q[i - 1]) * Fraction(e[i - 1]) / d if i else 0)
                below += d < 0
            counts.append(below)
        assert counts[1] == counts[0] + 1


def test_bidiagonal_form():
    a = np.random.default_rng(3).standard_normal((7, 7))
    d, s, v = bidiagonal(a)
    b = np.diag(d) + np.diag(s, 1)
    assert np.allclose(b.T @ b, v.T @ a.T @ a @ v) and np.allclose(v.T @ v, np.eye(7))


def test_queries_return_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert queries()["op11_embedding_near_dedup"](spark, sf).count() == n
    assert queries()["op12_embedding_whitening"](spark, sf).count() == 8 * n
