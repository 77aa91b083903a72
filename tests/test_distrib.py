"""Distribution operators against brute-force numpy on a small fixture."""

import math

import numpy as np
import pytest

from ticklens.operators import distrib


def _data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for grp, n in (("a", 40), ("b", 9)):
        x = np.sort(rng.uniform(1, 5, n))
        y = np.sin(x) + 0.1 * rng.normal(size=n)
        rows += [(grp, float(a), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "grp string, x double, y double"), rows


def _loess_ref(x, y, g):
    r = max(g - x.min(), x.max() - g)
    u = (x - g) / r
    w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
    X = np.column_stack([np.ones_like(u), u, u * u])
    beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y))
    return beta[0]


def test_loess_matches_weighted_least_squares(spark):
    df, rows = _data(spark)
    out = distrib.loess_curve(df, ["grp"], "x", "y", n_grid=15).collect()
    for r in out:
        pts = np.array([(a, b) for g, a, b in rows if g == r.grp])
        ref = _loess_ref(pts[:, 0], pts[:, 1], r.g)
        assert r.fitted == pytest.approx(ref, rel=1e-9, abs=1e-9)


def test_kde_matches_definition(spark):
    df, rows = _data(spark)
    out = distrib.kde(df, ["grp"], "x", n_grid=20).collect()
    for r in out:
        x = np.array([a for g, a, _ in rows if g == r.grp])
        h = x.std(ddof=1) * (4 / (3 * len(x))) ** 0.2
        dens = np.mean(np.exp(-0.5 * ((r.g - x) / h) ** 2)) / (h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(dens, rel=1e-10)
        var = x.var(ddof=1) + h * h
        assert r.normal == pytest.approx(math.exp(-0.5 * (r.g - x.mean()) ** 2 / var) / math.sqrt(2 * math.pi * var),
                                         rel=1e-10)


def test_qq_points(spark):
    df, rows = _data(spark)
    out = sorted(distrib.qq_points(df, ["grp"], "x").filter("grp = 'b'").collect(), key=lambda r: r.i)
    from statistics import NormalDist
    xs = sorted(a for g, a, _ in rows if g == "b")
    n = len(xs)
    for r in out:
        assert r.sample == xs[r.i - 1]
        assert r.theoretical == pytest.approx(NormalDist().inv_cdf((r.i - 0.375) / (n + 0.25)), rel=1e-12)


def _reml_ref(x, y, g):
    """Brute force: -2 REML log-likelihood over a fine lambda grid with full matrices."""
    X = np.column_stack([np.ones_like(x), x])
    N, p = X.shape
    best = None
    for lam in np.concatenate([[0.0], 10 ** np.linspace(-6, 6, 4001)]):
        Vi = np.zeros((N, N))
        logdet = 0.0
        for grp in np.unique(g):
            idx = np.where(g == grp)[0]
            n = len(idx)
            Vi[np.ix_(idx, idx)] = np.eye(n) - lam / (1 + n * lam) * np.ones((n, n))
            logdet += math.log1p(n * lam)
        A = X.T @ Vi @ X
        beta = np.linalg.solve(A, X.T @ Vi @ y)
        r = y - X @ beta
        rss = r @ Vi @ r
        crit = (N - p) * math.log(rss / (N - p)) + logdet + math.log(np.linalg.det(A))
        if best is None or crit < best[0]:
            best = (crit, lam, beta)
    return best


def test_random_intercept_reml(spark):
    from ticklens.operators.mixed import random_intercept
    rng = np.random.default_rng(3)
    rows, xs, ys, gs = [], [], [], []
    for t in range(6):
        u = rng.normal(scale=0.7)
        for _ in range(rng.integers(5, 12)):
            x = rng.normal()
            y = 1.0 + 0.5 * x + u + rng.normal(scale=0.4)
            rows.append(("s", f"T{t}", x, y))
            xs.append(x), ys.append(y), gs.append(t)
    df = spark.createDataFrame(rows, "sample string, ticker string, x double, y double")
    got = random_intercept(df, ["sample"]).collect()[0]
    crit, lam, beta = _reml_ref(np.array(xs), np.array(ys), np.array(gs))
    assert got.a == pytest.approx(beta[1], rel=1e-4)
    assert got.mu == pytest.approx(beta[0], rel=1e-4)
    assert got.variance_ratio == pytest.approx(lam, rel=1e-2)
    assert got.reml_deviance <= crit + 1e-6


def test_random_intercept_of_one_ticker_and_counts(spark):
    from ticklens.operators.mixed import random_intercept
    rng = np.random.default_rng(8)
    rows = [("one", "T", float(x), float(1 + x + rng.normal())) for x in rng.normal(size=20)]
    rows += [(f"s{k}", f"T{t}", float(x), float(x + k * t + rng.normal(scale=0.1 + k)))
             for k in range(6) for t in range(4) for x in rng.normal(size=8)]
    df = spark.createDataFrame(rows, "sample string, ticker string, x double, y double")
    got = {r["sample"]: r for r in random_intercept(df, ["sample"]).collect()}
    assert got["one"].variance_ratio == 0 and got["one"].n == 20 and got["one"].groups == 1
    for k in range(6):
        assert (got[f"s{k}"].n, got[f"s{k}"].groups) == (32, 4)


def test_random_effects_panel_matches_formula(spark):
    from ticklens.operators.models import panel_random
    rng = np.random.default_rng(11)
    rows, data = [], []
    for t in range(7):
        u = rng.normal(scale=0.5)
        for d in range(int(rng.integers(6, 15))):
            lw = rng.normal(10, 1)
            ln_n = 2 + 0.6 * lw + u + rng.normal(scale=0.3)
            rows.append((f"T{t}", d, "DE", "DAX", float(np.exp(lw)), float(np.exp(ln_n))))
            data.append((t, lw, ln_n))
    c = spark.createDataFrame(rows, "ticker string, day int, venue string, index string, W double, nt double") \
        .selectExpr("ticker", "venue", "index", "W", "W AS W_star", "nt AS n_trades", "nt AS n_quotes",
                    "1.0 AS X", "1.0 AS V", "1.0 AS P", "1.0 AS bid_size", "1.0 AS ask_size",
                    "2.0 AS ask_price", "1.0 AS bid_price", "1.0 AS rel_spread")
    got = [r for r in panel_random(c).collect() if r.model == "trade_freq"][0]
    g = np.array([d[0] for d in data])
    x = np.array([d[1] for d in data])
    y = np.array([d[2] for d in data])
    ids = np.unique(g)
    n, G = len(x), len(ids)
    xb = np.array([x[g == i].mean() for i in ids])
    yb = np.array([y[g == i].mean() for i in ids])
    T = np.array([(g == i).sum() for i in ids])
    xw = x - xb[g]
    yw = y - yb[g]
    s2e = max((yw @ yw) - (xw @ yw) ** 2 / (xw @ xw), 0) / (n - G - 1)
    bx, by = xb - xb.mean(), yb - yb.mean()
    s21 = max((by @ by) - (bx @ by) ** 2 / (bx @ bx), 0) / (G - 2) * (n / G)
    s2u = max(s21 - s2e, 0) / (n / G)
    theta = 1 - np.sqrt(s2e / (T * s2u + s2e))
    Z = np.column_stack([1 - theta[g], x - theta[g] * xb[g]])
    ys = y - theta[g] * yb[g]
    beta, *_ = np.linalg.lstsq(Z, ys, rcond=None)
    res = ys - Z @ beta
    se = math.sqrt((res @ res) / (n - 2) * np.linalg.inv(Z.T @ Z)[1, 1])
    assert got.a == pytest.approx(beta[1], rel=1e-10)
    assert got.mu == pytest.approx(beta[0], rel=1e-10)
    assert got.a_se == pytest.approx(se, rel=1e-9)


def test_shapiro_matches_numpy_at_every_size(spark):
    """Sizes of each branch (3, 4-5, 6-11, 12 and more), ties, no spread, too few, too many, nulls."""
    from shapiro_numpy import shapiro_wilk
    rng = np.random.default_rng(5)
    samples = {f"n{n}": rng.normal(size=n) for n in (3, 4, 5, 6, 11, 12, 13, 50, 400)}
    samples |= {"skewed": rng.exponential(size=300), "ties": rng.integers(0, 4, 40).astype(float),
                "large mean": 1e6 + rng.normal(size=60), "flat": np.ones(8), "two": np.array([1.0, 2.0]),
                "most": rng.normal(size=5000), "many": rng.normal(size=5001), "three tied": np.array([1.0, 1.0, 2.0]),
                "seven far": np.array([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0])}
    rows = [(k, float(v)) for k, x in samples.items() for v in x]
    rows += [("n50", None), ("nulls", None), (None, 1.0), (None, 2.0), (None, 4.0)]
    out = distrib.shapiro_by_group(spark.createDataFrame(rows, "grp string, x double"), ["grp"], "x").collect()
    got = {r.grp: r for r in out}
    assert len(out) == len(got) == len(samples) + 2
    for k, x in (samples | {None: np.array([1.0, 2.0, 4.0])}).items():
        w, p = shapiro_wilk(x)
        assert got[k].n == len(x)
        if math.isnan(w):
            assert got[k].w is None and got[k].p is None and got[k].reason
        else:
            assert got[k].w == pytest.approx(w, rel=1e-9) and got[k].reason is None
            assert got[k].p == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert got["nulls"].n == 0 and got["nulls"].reason
    empty = spark.createDataFrame([], "grp string, x double")
    assert distrib.shapiro_by_group(empty, ["grp"], "x").count() == 0
