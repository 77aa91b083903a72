"""M9: random intercept and slope with covariates, against dense REML."""

import numpy as np
import pytest

from ticklens.operators.mixed_slope import COVARIATES, random_slope


def dense(point, x, y, ticker):
    """(-2 log REML likelihood, b, standard errors, s, cov of u) with explicit covariance matrices."""
    low = np.array([[point[0], 0], [point[1], point[2]]])
    n, p = x.shape
    v = np.eye(n)
    for t in set(ticker):
        at = np.flatnonzero(ticker == t)
        z = x[at][:, :2]
        v[np.ix_(at, at)] += z @ low @ low.T @ z.T
    inv = np.linalg.inv(v)
    a = x.T @ inv @ x
    b = np.linalg.solve(a, x.T @ inv @ y)
    r = y - x @ b
    s2 = r @ inv @ r / (n - p)
    value = (n - p) * (1 + np.log(2 * np.pi * s2)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return value, b, np.sqrt(np.diagonal(np.linalg.inv(a)) * s2), np.sqrt(s2), low @ low.T * s2


def dense_fit(x, y, ticker):
    """Least -2 log REML likelihood by Nelder-Mead from many starts, polished by Newton steps."""
    f = lambda p: dense(p, x, y, ticker)[0]
    best = min(((f(np.array(s)), s) for s in np.ndindex(4, 3, 4)), key=lambda t: t[0])[1]
    best = np.array(best, dtype=float)
    simplex = [best] + [best + 0.3 * e for e in np.eye(3)]
    for _ in range(600):
        simplex.sort(key=f)
        mid = np.mean(simplex[:3], axis=0)
        for t in (2.0, 1.0, 0.5, -0.5):
            new = mid + t * (mid - simplex[3])
            if f(new) < f(simplex[3 if t < 2 else 0]):
                simplex[3] = new
                break
        else:
            simplex = [simplex[0]] + [(s + simplex[0]) / 2 for s in simplex[1:]]
    return min(simplex, key=f)


def sample(seed, tickers, rows, sd=(0.8, 0.5), extra=2, far=False):
    rnd = np.random.default_rng(seed)
    out = []
    for t in range(tickers):
        u, w = rnd.normal(scale=sd[0]), rnd.normal(scale=sd[1])
        flag = float(t % 2)
        for _ in range(rnd.integers(rows // 2, rows + 1)):
            x = rnd.normal() + (9 if far else 0)
            more = rnd.normal(size=extra) * 10.0 ** np.arange(extra)
            y = 1.5 + 0.7 * x + 0.3 * flag + 0.1 * more.sum() + u + w * x + rnd.normal(scale=0.4)
            out.append((f"T{t}", float(y), float(x), flag, *(float(m) for m in more)))
    return out


def fitted(spark, samples, extra=2):
    names = ["x", "flag", *(f"m{k}" for k in range(extra))]
    rows = [(s, *r) for s, data in samples.items() for r in data]
    df = spark.createDataFrame(rows, "sample string, ticker string, y double, " + ", ".join(f"{n} double" for n in names))
    return random_slope(df, ["sample"], names, names).collect()


def arrays(data):
    m = np.array([r[1:] for r in data])
    return np.column_stack((np.ones(len(m)), m[:, 1:])), m[:, 0], np.array([r[0] for r in data])


def test_against_dense_reml(spark):
    samples = {"plain": sample(1, 9, 14), "far": sample(2, 6, 20, far=True), "no slope": sample(3, 8, 12, sd=(0.9, 0.0)),
               "no effect": sample(4, 6, 10, sd=(0.0, 0.0))}
    got = fitted(spark, samples)
    for name, data in samples.items():
        x, y, ticker = arrays(data)
        point = dense_fit(x, y, ticker)
        value, b, se, sigma, cov = dense(point, x, y, ticker)
        rows = {r.term: r for r in got if r.sample == name}
        first = rows["x"]
        assert first.converged and first.n == len(y) and first.groups == len(set(ticker))
        assert first.reml_deviance <= value + 1e-7                      # no worse than the dense search
        assert first.reml_deviance == pytest.approx(value, abs=1e-4)
        # at the point that was found, every figure equals the dense one
        own = np.array([[first.sd_intercept ** 2, (first.corr or 0) * first.sd_intercept * first.sd_slope],
                        [(first.corr or 0) * first.sd_intercept * first.sd_slope, first.sd_slope ** 2]]) / first.sigma_e ** 2
        low = [np.sqrt(own[0, 0]), 0.0, 0.0]
        if low[0] > 1e-9:
            low[1] = own[1, 0] / low[0]
        low[2] = np.sqrt(max(own[1, 1] - low[1] ** 2, 0))
        value, b, se, sigma, _ = dense(low, x, y, ticker)
        assert first.reml_deviance == pytest.approx(value, abs=1e-6)
        assert [rows[t].estimate for t in ("(Intercept)", "x", "flag", "m0", "m1")] == pytest.approx(list(b), rel=1e-6)
        assert [rows[t].se for t in ("(Intercept)", "x", "flag", "m0", "m1")] == pytest.approx(list(se), rel=1e-6)
        assert first.sigma_e == pytest.approx(sigma, rel=1e-6)
        assert rows["x"].df == len(y) - first.groups - 3 and rows["flag"].df == first.groups - 2


def test_optimum_is_stationary(spark):
    """At the estimates the dense criterion has no slope in any of the three parameters."""
    data = sample(7, 10, 16)
    r = next(r for r in fitted(spark, {"s": data}) if r.term == "x")
    x, y, ticker = arrays(data)
    cov = np.array([[r.sd_intercept ** 2, r.corr * r.sd_intercept * r.sd_slope], [0, r.sd_slope ** 2]]).T
    low = np.linalg.cholesky((cov + np.tril(cov, -1).T) / r.sigma_e ** 2)
    point = np.array([low[0, 0], low[1, 0], low[1, 1]])
    for e in np.eye(3) * 1e-4:
        up, down = dense(point + e, x, y, ticker)[0], dense(point - e, x, y, ticker)[0]
        curve = (up + down - 2 * dense(point, x, y, ticker)[0]) / 1e-8
        assert abs((up - down) / 2e-4) < 1e-6 * max(curve, 1)


def test_samples_that_identify_less(spark):
    one = [r for r in sample(5, 1, 20)]
    few = sample(6, 3, 2)[:4]
    twice = [(*r[:3], r[3], r[4], r[4]) for r in sample(8, 5, 12)]
    same = [(r[0], r[1], 2.0, *r[3:]) for r in sample(9, 4, 10)]
    got = fitted(spark, {"one": one, "few": few, "twice": twice, "same": same})
    by = lambda s: {r.term: r for r in got if r.sample == s}
    x, y, _ = arrays(one)
    used = [0, 1, 3, 4]                                     # one ticker: the flag is constant
    b = np.linalg.lstsq(x[:, used], y, rcond=None)[0]
    o = by("one")
    assert [o[t].estimate for t in ("(Intercept)", "x", "m0", "m1")] == pytest.approx(list(b), rel=1e-8)
    assert o["flag"].estimate is None and o["x"].sd_slope is None and o["x"].groups == 1
    assert all(r.estimate is None and r.n == len(few) for r in by("few").values())
    t = by("twice")
    assert t["m1"].estimate is None and t["m0"].estimate is not None and t["m0"].converged
    s = by("same")
    assert s["x"].estimate is None and s["flag"].estimate is not None


def test_no_rows(spark):
    assert fitted(spark, {}) == []


def test_query_covers_every_sample(spark):
    from conftest import SF01
    from ticklens.plans.catalog import queries
    rows = queries()["mixed_random_slope"](spark, SF01).collect()
    samples = {(r["venue"], r["index"]) for r in rows}
    assert samples == {(r["venue"], r["index"]) for r in queries()["mixed_random_intercept"](spark, SF01).collect()}
    assert len(rows) == len(samples) * (2 + len(COVARIATES))
    assert all(r.se is None or r.se >= 0 for r in rows) and any(r.estimate is not None for r in rows)
