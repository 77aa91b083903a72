"""Linear mixed model with a random intercept and slope per ticker and many covariates (M9).

y = X b + Z u + e per ticker, X = [1, ln W, covariates], Z = [1, ln W], u ~ N(0, s² L L') with a
lower triangular 2 x 2 factor L, e ~ N(0, s²), fitted by REML over the three entries of L.

Only cross products of [X, y] are needed, and only per ticker. One group-by packs them: the upper
triangle of a (p + 1) x (p + 1) matrix as an array, columns centred and scaled per sample so that
no large squares are subtracted. For a factor L and with C = Z'Z, B = Z'[X, y] of a ticker,

    K = L (I + L' C L)^-1 L'
    [X, y]' V^-1 [X, y] = [X, y]'[X, y] - B' K B        ln |V| = ln |I + L' C L|
    Z' V^-1 [X, y] = W = B - C K B                      Z' V^-1 Z = C - C K C

are closed forms, and their sums over tickers give the criterion and, from the sums of W W', its
exact gradient. An iteration is one pass over the tickers' matrices: it sums these forms for some
candidate factors of every sample at once, each with the neighbours that give second derivatives
from gradients. Newton steps then choose the next candidates; the driver holds the sums of a few
candidates per sample and nothing of the tickers. The criterion is even in the columns of L, so a
singular fit (no variance left for a direction) is an interior point for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import with_t_pvalue
from .container import materialize
from .models import PANEL_VENUES, _panel_sample

#: covariates of the original model beside ln W (``n_quotes`` is its N.y), in its order
COVARIATES = ("large_cap", "rel_spread", "sigma_m_log", "sigma_s", "n_quotes", "P", "V", "X", "sigma_r", "sigma_p")
MAX_STEPS = 60
#: shares of a Newton step that are tried together
SHARES = (1.0, 0.4, 0.1, 0.01)
STARTS = tuple((a, 0.0, b) for a in (0.1, 0.6, 3.0) for b in (0.1, 0.6, 3.0))
NEAR = 1e-5
#: a column counts as a combination of earlier ones below this share of its variance
ALIASED = 1e-10


def design(c: DataFrame, keys: Sequence[str], covariates: Sequence[str] = COVARIATES) -> DataFrame:
    """Complete observations: keys, ticker, y = ln N, and x0 = ln W, x1, ... the covariates."""
    cols = [F.when(F.col("W") > 0, F.log("W")), *(F.col(v).cast("double") for v in covariates)]
    y = F.when(F.col("n_trades") > 0, F.log(F.col("n_trades").cast("double")))
    rows = c.select(*keys, "ticker", y.alias("y"), *(x.alias(f"x{k}") for k, x in enumerate(cols)))
    complete = F.lit(True)
    for name in ("y", *(f"x{k}" for k in range(len(cols)))):
        complete = complete & F.col(name).isNotNull() & ~F.isnan(name)
    return rows.where(complete)


def ticker_matrices(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per sample and ticker the packed cross products of [1, columns..., y], and the samples' scales.

    Two tables: (keys, ticker, n, packed, varies) and (keys, n, groups, mean, sd, varies). ``varies``
    says of each column whether it changes within a ticker (in any, for a sample).
    """
    keys, names = list(keys), [*columns, "y"]
    scale = rows.groupBy(*keys).agg(
        F.array(*(F.avg(c) for c in names)).alias("mean"), F.array(*(F.stddev_pop(c) for c in names)).alias("sd"))
    joined = rows.join(scale, keys)
    std = [F.lit(1.0), *(F.when(F.col("sd")[k] > 0, (F.col(c) - F.col("mean")[k]) / F.col("sd")[k]).otherwise(F.lit(0.0))
                         for k, c in enumerate(names))]
    z = joined.select(*keys, "ticker", *names, *(s.alias(f"_z{k}") for k, s in enumerate(std)))
    size = len(std)
    packed = F.array(*(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(size) for j in range(i, size)))
    own = z.groupBy(*keys, "ticker").agg(F.count(F.lit(1)).alias("n"), packed.alias("packed"),
                                         F.array(*(F.max(c) > F.min(c) for c in columns)).alias("varies"))
    own = materialize(own)
    some = F.array(*(F.max(F.col("varies")[k]) for k in range(len(columns))))
    total = own.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), some.alias("varies"))
    return own, total.join(scale, keys)


def unpacked(packed: np.ndarray, size: int) -> np.ndarray:
    """(..., size, size) symmetric matrices from their upper triangles (..., size (size + 1) / 2)."""
    i, j = np.triu_indices(size)
    out = np.zeros((*packed.shape[:-1], size, size))
    out[..., i, j] = packed
    out[..., j, i] = packed
    return out


def _lower(point: Sequence[float]) -> np.ndarray:
    return np.array([[point[0], 0.0], [point[1], point[2]]])


def point_sums(m: np.ndarray, point: Sequence[float]) -> np.ndarray:
    """Sums over tickers for one factor: [X y]'V^-1[X y], ln |V|, Z'V^-1 Z, sum of W W' (flattened)."""
    low = _lower(point)
    c, b = m[:, :2, :2], m[:, :2, :]
    inner = np.eye(2) + low.T @ c @ low
    k = low @ np.linalg.inv(inner) @ low.T
    kb = k @ b
    s = (m - b.transpose(0, 2, 1) @ kb).sum(axis=0)
    w = (b - c @ kb).reshape(len(m), -1)
    q = (c - c @ k @ c).sum(axis=0)
    return np.concatenate((s.ravel(), [np.log(np.linalg.det(inner)).sum()], q.ravel(), (w.T @ w).ravel()))


def _summed(own: DataFrame, keys: list[str], size: int, points: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """The sums of ``point_sums`` for every sample's candidate points, by one pass over the tickers."""
    order = list(points)
    place = {key: k for k, key in enumerate(order)}

    def partial(batches):
        for batch in batches:
            sample = [place.get(tuple(r)) for r in batch[keys].itertuples(index=False, name=None)]
            matrices = unpacked(np.array(batch["packed"].tolist()), size) if len(batch) else np.zeros((0, size, size))
            sample = np.array([-1 if s is None else s for s in sample], dtype=int)
            for s in np.unique(sample[sample >= 0]):
                m = matrices[sample == s]
                yield pd.DataFrame({"sample": int(s), "point": range(len(points[order[s]])),
                                    "sums": [point_sums(m, p).tolist() for p in points[order[s]]]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": [rows["sample"].iloc[0]], "point": [rows["point"].iloc[0]],
                             "sums": [np.sum(rows["sums"].tolist(), axis=0).tolist()]})

    schema = "sample int, point int, sums array<double>"
    parts = own.select(*keys, "packed").mapInPandas(partial, schema)
    out = {key: np.zeros((len(p), 0)) for key, p in points.items()}
    found: dict[int, dict[int, list[float]]] = {}
    for r in parts.groupBy("sample", "point").applyInPandas(total, schema).collect():
        found.setdefault(r["sample"], {})[r["point"]] = r["sums"]
    for key, k in place.items():
        out[key] = np.array([found[k][j] for j in range(len(points[key]))])
    return out


class Sample:
    """The fit of one sample: criterion, gradient and Newton steps from the summed forms."""

    def __init__(self, n: int, groups: int, total: np.ndarray):
        self.n, self.groups, self.size = n, groups, len(total)
        self.used = self._independent(total)
        self.rank = len(self.used)
        self.point = np.zeros(3)
        self.value = self.gradient = self.hessian = None
        self.done = groups < 2 or n <= self.rank or self.rank < 2
        self.converged = self.done

    @staticmethod
    def _independent(total: np.ndarray) -> list[int]:
        """Columns that are no combination of earlier ones, by sequential elimination."""
        left, used = total[:-1, :-1].copy(), []
        size = np.diagonal(left).copy()
        for k in range(len(left)):
            if size[k] > 0 and left[k, k] > ALIASED * size[k]:
                used.append(k)
                left = left - np.outer(left[:, k], left[k]) / left[k, k]
        return used

    def forms(self, point: np.ndarray, sums: np.ndarray):
        """(criterion, gradient, b, inverse of X'V^-1 X, residual sum of squares) at a point."""
        size, used = self.size, self.used
        s = sums[:size * size].reshape(size, size)
        log_v, q = sums[size * size], sums[size * size + 1:size * size + 5].reshape(2, 2)
        u = sums[size * size + 5:].reshape(2, size, 2, size)
        a, b = s[np.ix_(used, used)], s[used, -1]
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        rss = s[-1, -1] - b @ beta
        free = self.n - self.rank
        value = free * np.log(rss) + log_v + np.linalg.slogdet(a)[1]
        low = _lower(point)
        residual = np.append(-beta, 1.0)
        at = [*used, size - 1]
        gradient = np.zeros(3)
        for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1))):
            d_low = np.zeros((2, 2))
            d_low[i, j] = 1
            d = d_low @ low.T + low @ d_low.T
            d_s = -np.einsum("pq,paqb->ab", d, u)
            gradient[k] = (free * (residual @ d_s[np.ix_(at, at)] @ residual) / rss + (q * d).sum()
                           + (inverse * d_s[np.ix_(used, used)]).sum())
        return value, gradient, beta, inverse, rss

    def candidates(self) -> np.ndarray:
        """Points to sum next: each candidate followed by its neighbours along the three axes."""
        if self.value is None:
            points = [np.array(p) for p in STARTS]
        else:
            w, v = np.linalg.eigh(self.hessian)
            step = -v @ ((v.T @ self.gradient) / np.maximum(np.abs(w), 1e-8 * max(np.abs(w).max(), 1e-300)))
            longest = max(2.0, 2 * np.abs(self.point).max())
            step *= min(1.0, longest / max(np.abs(step).max(), 1e-300))
            points = [self.point + t * step for t in SHARES]
        return np.array([p + d for p in points for d in np.concatenate((np.zeros((1, 3)), np.eye(3) * NEAR, -np.eye(3) * NEAR))])

    def take(self, points: np.ndarray, sums: np.ndarray) -> None:
        """Go to the best candidate, if it is better; else the fit has ended."""
        firsts = [(self.forms(points[k], sums[k])[0], k) for k in range(0, len(points), 7)]
        value, k = min((v, k) for v, k in firsts if not np.isnan(v))
        if self.value is not None and not value < self.value - 1e-13 * max(1.0, abs(self.value)):
            self.done = True
            w = np.linalg.eigvalsh(self.hessian)
            size = np.abs(self.gradient).max()
            self.converged = bool(size <= 1e-5 * max(1.0, np.abs(w).max()))
            if value > self.value:
                return
        gradients = [self.forms(points[k + j], sums[k + j])[1] for j in range(7)]
        h = np.array([(gradients[1 + j] - gradients[4 + j]) / (2 * NEAR) for j in range(3)])
        self.point, self.value, self.gradient, self.hessian = points[k].copy(), value, gradients[0], (h + h.T) / 2


def random_slope(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """M9: REML fit per sample ``keys`` of y ~ 1 + columns + (1 + columns[0] | ticker).

    ``rows`` has the keys, ticker, y and the columns, no nulls; ``names`` are the terms' names in
    the result, one row per sample and term (the intercept first): estimate, se, df, t, p, and the
    sample's sigma_e, sd_intercept, sd_slope, corr, reml_deviance, n, groups, converged. A column
    that is a combination of earlier ones has null figures. With one ticker the variances are not
    identified (null) and the fit is least squares; with no more observations than columns all
    figures are null. df: observations less tickers less columns that change within a ticker, or
    tickers less 1 less columns that don't (the intercept counts as changing).
    """
    keys, columns = list(keys), list(columns)
    own, samples = ticker_matrices(rows, keys, columns)
    size = len(columns) + 2
    info = {tuple(r[k] for k in keys): r for r in samples.collect()}
    zero = {key: np.zeros((1, 3)) for key in info}
    start = _summed(own, keys, size, zero) if info else {}
    fits = {key: Sample(r["n"], r["groups"], start[key][0][:size * size].reshape(size, size)) for key, r in info.items()}
    for _ in range(MAX_STEPS):
        points = {key: fit.candidates() for key, fit in fits.items() if not fit.done}
        if not points:
            break
        for key, sums in _summed(own, keys, size, points).items():
            fits[key].take(points[key], sums)
    last = _summed(own, keys, size, {key: fit.point[None] for key, fit in fits.items()}) if fits else {}
    out = [row for key, fit in fits.items() for row in _terms(key, info[key], fit, last[key][0], names)]
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "term string, estimate double, se double, df_resid long, sigma_e double, sd_intercept double, "
                        "sd_slope double, corr double, reml_deviance double, n long, groups long, converged boolean"])
    table = rows.sparkSession.createDataFrame(out, schema)
    table = table.withColumn("t_stat", F.expr("try_divide(estimate, se)"))
    return with_t_pvalue(table, "t_stat", "df_resid", "p").select(
        *keys, "term", "estimate", "se", F.col("df_resid").alias("df"), F.col("t_stat").alias("t"), "p", "sigma_e",
        "sd_intercept", "sd_slope", "corr", "reml_deviance", "n", "groups", "converged")


def _terms(key: tuple, info, fit: Sample, sums: np.ndarray, names: Sequence[str]) -> list[tuple]:
    """The result rows of a sample, on the scale of the data."""
    terms = ["(Intercept)", *names]
    if fit.n <= fit.rank:
        return [(*key, t, None, None, None, None, None, None, None, None, info["n"], info["groups"], False) for t in terms]
    _, _, beta, inverse, rss = fit.forms(fit.point, sums)
    mean, sd = np.array(info["mean"]), np.array(info["sd"])
    free = fit.n - fit.rank
    sigma = np.sqrt(rss / free) * sd[-1]
    # back to the columns as they were: x = mean + sd z, y = mean + sd y*
    turn = np.zeros((len(terms), fit.rank))
    for at, k in enumerate(fit.used):
        turn[k, at] = sd[-1] / (sd[k - 1] if k else 1.0)
        if k:
            turn[0, at] = -mean[k - 1] * turn[k, at]
    estimate = turn @ beta
    estimate[0] += mean[-1]
    variance = np.einsum("ia,ab,ib->i", turn, inverse, turn) * rss / free
    scale = np.array([[1.0, -mean[0] / sd[0]], [0.0, 1 / sd[0]]]) if sd[0] > 0 else np.eye(2)
    cov = scale @ _lower(fit.point) @ _lower(fit.point).T @ scale.T * sigma ** 2
    sds = np.sqrt(np.diagonal(cov))
    known = fit.groups >= 2 and fit.rank >= 2
    corr = float(cov[0, 1] / sds.prod()) if known and sds.prod() > 0 else None
    size = fit.size
    a = sums[:size * size].reshape(size, size)[np.ix_(fit.used, fit.used)]
    log_a = np.linalg.slogdet(a)[1] + 2 * sum(np.log(sd[k - 1]) for k in fit.used if k)
    deviance = float(free * (1 + np.log(2 * np.pi * sigma ** 2)) + sums[size * size] + log_a) if sigma > 0 else None
    inner = sum(1 for k in fit.used if k and info["varies"][k - 1])
    outer = sum(1 for k in fit.used if k and not info["varies"][k - 1])
    out = []
    for k, term in enumerate(terms):
        within = k == 0 or info["varies"][k - 1]
        df = fit.n - fit.groups - inner if within else fit.groups - 1 - outer
        shown = (float(estimate[k]), float(np.sqrt(variance[k])), int(df)) if k in fit.used else (None, None, None)
        out.append((*key, term, *shown, float(sigma), *((float(s) for s in sds) if known else (None, None)), corr, deviance,
                    int(info["n"]), int(info["groups"]), bool(fit.converged)))
    return out


def panel_random_slope(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES),
                       covariates: Sequence[str] = COVARIATES) -> DataFrame:
    """M9 for every venue x index sample: ln N on ln W and the covariates, (1 + ln W | ticker)."""
    rows = design(_panel_sample(c, venues), ["venue", "index"], covariates)
    names = ["log_W", *covariates]
    return random_slope(rows, ["venue", "index"], [f"x{k}" for k in range(len(names))], names)
