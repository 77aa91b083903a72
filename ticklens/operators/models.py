"""Regressions of market variables on trading activity.

All fits are aggregations: one ``groupBy`` over the long model table computes the moments of
every regression at once (map-side partial aggregation, one small shuffle), and the
statistics follow from closed forms (``functions.ols``). No loop over tickers or models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ols
from ..functions.special import with_t_pvalue
from ..schema import COEFFICIENT_COLUMNS
from .container import materialize, model_long

FIT_COLS = ["mu", "a", "p", "r_squared", "r_adjusted", "a_se", "f_test_p"]
PANEL_VENUES = ["DE", "PA", "BS", "CHI", "TQ"]


def pooled(c: DataFrame, keys: Sequence[str] = (), relative: bool = True) -> DataFrame:
    """M1: one OLS per model (and per ``keys``) of y on ln(W/W*) over all rows."""
    long = model_long(c, list(keys), relative)
    m = long.groupBy(*keys, "model").agg(*ols.moments())
    return ols.fit(m).select(*keys, "model", "n", *FIT_COLS)


def per_ticker(c: DataFrame, by_period: bool = False) -> DataFrame:
    """M2: one OLS per ticker and model; schema ``coefficient`` (+ ``period`` if requested)."""
    dims = ["ticker_rm", "index", "venue", "market"]
    keys = ["ticker", *dims] + (["period"] if by_period else [])
    src = c.filter(F.col("period").isNotNull()) if by_period else c
    long = model_long(src, keys)
    group = ["ticker", "model"] + (["period"] if by_period else [])
    m = long.groupBy(*group).agg(*ols.moments(), *[F.max(d).alias(d) for d in dims])
    out = ols.fit(m).withColumnsRenamed({"ticker": "symbol", "ticker_rm": "symbol_rm"})
    return out.select(*(["period"] if by_period else []), *COEFFICIENT_COLUMNS)


def _panel_sample(c: DataFrame, venues: Sequence[str]) -> DataFrame:
    """venue x index samples, skipping DAX x PA and CAC x DE."""
    skip = ((F.col("index") == "DAX") & (F.col("venue") == "PA")) | \
           ((F.col("index") == "CAC") & (F.col("venue") == "DE"))
    return c.filter(F.col("venue").isin(*venues) & F.col("index").isNotNull() & ~skip)


def panel_within(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES), by_period: bool = False) -> DataFrame:
    """M4: fixed-effects (within) slope per venue, index and model; df = n - G - 1.

    Within moments are sums of per-ticker centred moments: a two-level aggregation, both
    levels partial-aggregated. No intercept (``mu`` NULL); the slope is ``a``.
    """
    keys = ["venue", "index"] + (["period"] if by_period else [])
    src = _panel_sample(c, venues)
    if by_period:
        src = src.filter(F.col("period").isNotNull())
    long = model_long(src, [*keys, "ticker"], relative=False)
    per = long.groupBy(*keys, "model", "ticker").agg(
        F.regr_count("y", "x").alias("n_i"), F.regr_sxx("y", "x").alias("sxx_i"),
        F.regr_sxy("y", "x").alias("sxy_i"), F.regr_syy("y", "x").alias("syy_i"))
    tot = per.groupBy(*keys, "model").agg(
        F.sum("n_i").alias("n"), F.sum("sxx_i").alias("sxx"), F.sum("sxy_i").alias("sxy"),
        F.sum("syy_i").alias("syy"), F.count_if(F.col("n_i") > 0).alias("groups"),
        F.lit(0.0).alias("avgx"), F.lit(0.0).alias("avgy"))
    fit = ols.fit(tot, df_resid="n - groups - 1", intercept=False)
    return fit.select("model", *FIT_COLS, "index", "venue", *(["period"] if by_period else []),
                      F.lit("within").alias("panel"))


def panel_pooling(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES)) -> DataFrame:
    """M5: pooled OLS with intercept per venue, index and model (x = ln W)."""
    long = model_long(_panel_sample(c, venues), ["venue", "index"], relative=False)
    m = long.groupBy("venue", "index", "model").agg(*ols.moments())
    return ols.fit(m).select("model", *FIT_COLS, "index", "venue", F.lit("pooling").alias("panel"))


def panel_between(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES)) -> DataFrame:
    """M6: OLS of ticker means of y on ticker means of x (complete rows), per venue/index/model."""
    long = model_long(_panel_sample(c, venues), ["venue", "index", "ticker"], relative=False) \
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    means = long.groupBy("venue", "index", "model", "ticker").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"))
    m = means.groupBy("venue", "index", "model").agg(*ols.moments())
    return ols.fit(m).select("model", *FIT_COLS, "index", "venue", F.lit("between").alias("panel"))


def panel_random(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES)) -> DataFrame:
    """M7: random-effects GLS with Swamy-Arora variance components (per venue/index/model).

    sigma_e² = within RSS / (n - G - 1); sigma_1² = between RSS / (G - 2) (on ticker means,
    scaled by the mean group size T̄ = n / G), sigma_u² = max(sigma_1² - sigma_e², 0)
    / T̄; theta_i = 1 - sqrt(sigma_e² / (T_i sigma_u² + sigma_e²)); then OLS of
    y - theta_i ȳ_i on [1 - theta_i, x - theta_i x̄_i].

    One pass over the rows gives (T, means, centred sums) per ticker; the rest works on that small
    table. With q_i = 1 - theta_i a demeaned row is its deviation from the ticker mean plus q_i times
    that mean, so every sum is a within part plus a part over ticker means with weight T_i q_i².
    Both are sums of squares about the fit: nothing large is subtracted.
    """
    keys = ["venue", "index", "model"]
    long = model_long(_panel_sample(c, venues), ["venue", "index", "ticker"], relative=False)
    per = materialize(long.groupBy(*keys, "ticker").agg(
        F.regr_count("y", "x").alias("t_i"), F.regr_avgx("y", "x").alias("xb"), F.regr_avgy("y", "x").alias("yb"),
        F.regr_sxx("y", "x").alias("sxx_i"), F.regr_sxy("y", "x").alias("sxy_i"),
        F.regr_syy("y", "x").alias("syy_i")).where("t_i > 0"))
    comp = per.groupBy(*keys).agg(
        F.sum("t_i").alias("n"), F.count(F.lit(1)).alias("g"),
        F.sum("sxx_i").alias("wxx"), F.sum("sxy_i").alias("wxy"), F.sum("syy_i").alias("wyy"),
        F.regr_sxx("yb", "xb").alias("bxx"), F.regr_sxy("yb", "xb").alias("bxy"),
        F.regr_syy("yb", "xb").alias("byy"))
    comp = comp.withColumns({
        "s2e": F.expr("try_divide(greatest(wyy - try_divide(wxy * wxy, wxx), 0), n - g - 1)"),
        "s21": F.expr("try_divide(greatest(byy - try_divide(bxy * bxy, bxx), 0), g - 2) * try_divide(n, g)"),
    }).withColumn("s2u", F.expr("try_divide(greatest(s21 - s2e, 0), try_divide(n, g))")) \
        .select(*keys, "n", "s2e", "s2u")
    per = per.join(comp, keys).withColumn("q", F.expr("sqrt(try_divide(s2e, t_i * s2u + s2e))")) \
        .withColumn("w", F.expr("t_i * q * q"))
    centre = per.groupBy(*keys).agg(
        F.expr("try_divide(sum(w * xb), sum(w))").alias("mx"), F.expr("try_divide(sum(w * yb), sum(w))").alias("my"),
        F.expr("try_divide(sum(t_i * q * yb), sum(t_i))").alias("ys_mean"))
    per = per.join(centre, keys)
    slope = per.groupBy(*keys).agg(
        F.expr("sum(sxx_i + w * (xb - mx) * (xb - mx))").alias("sxx"),
        F.expr("sum(sxy_i + w * (xb - mx) * (yb - my))").alias("sxy")) \
        .withColumn("a", F.expr("try_divide(sxy, sxx)")).select(*keys, "sxx", "a")
    # per ticker: rows about the ticker's own line, its slope against a, its mean against the line
    own = "coalesce(try_divide(sxy_i, sxx_i), 0)"
    s = per.join(slope, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("a").alias("a"), F.max("sxx").alias("sxx"),
        F.max(F.expr("my - a * mx")).alias("mu"),
        F.sum(F.expr(f"greatest(syy_i - {own} * sxy_i, 0) + sxx_i * pow(a - {own}, 2) "
                     "+ w * pow((yb - my) - a * (xb - mx), 2)")).alias("rss"),
        F.sum(F.expr("syy_i + t_i * pow(q * yb - ys_mean, 2)")).alias("tss"))
    s = s.withColumn("df_resid", F.expr("n - 2"))
    s = s.withColumns({
        "a_se": F.expr("sqrt(try_divide(try_divide(rss, df_resid), sxx))"),
        "r_squared": F.expr("1 - try_divide(rss, tss)"),
    })
    s = s.withColumns({"r_adjusted": F.expr("1 - (1 - r_squared) * try_divide(n - 1, df_resid)"),
                       "t_stat": F.expr("try_divide(a, a_se)")})
    s = with_t_pvalue(s, "t_stat", "df_resid", "p").withColumn("f_test_p", F.col("p"))
    return s.select("model", *FIT_COLS, "index", "venue", F.lit("random").alias("panel"))


def fitted_line(c: DataFrame, ticker: str | None = None, log: bool = True) -> DataFrame:
    """Straight fit N ~ W (or ln N ~ ln W) per ticker with fitted values for the line."""
    s = c.filter(F.col("ticker") == ticker) if ticker else c
    if log:
        s = s.withColumns({"x": F.when(F.col("W") > 0, F.log("W")),
                           "y": F.when(F.col("n_trades") > 0, F.log(F.col("n_trades").cast("double")))})
    else:
        s = s.withColumns({"x": F.col("W"), "y": F.col("n_trades").cast("double")})
    m = ols.fit(s.groupBy("ticker").agg(*ols.moments())).select("ticker", "mu", "a")
    return s.join(m, "ticker").select("ticker", "date", "x", "y",
                                      (F.col("mu") + F.col("a") * F.col("x")).alias("fitted"))


def two_sample_t(c: DataFrame, value: str, group: str = "large_cap") -> DataFrame:
    """Two-sample t-test with equal variances between group 1 and group 0 of ``group``."""
    g = c.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).agg(
        *[F.count_if(F.col(group) == k).alias(f"n{k}") for k in (1, 0)],
        *[F.avg(F.when(F.col(group) == k, F.col(value))).alias(f"m{k}") for k in (1, 0)],
        *[F.var_samp(F.when(F.col(group) == k, F.col(value))).alias(f"v{k}") for k in (1, 0)])
    g = g.withColumns({
        "df_resid": F.expr("n1 + n0 - 2"),
        "sp2": F.expr("try_divide((n1 - 1) * v1 + (n0 - 1) * v0, n1 + n0 - 2)"),
    }).withColumn("t_stat", F.expr("try_divide(m1 - m0, sqrt(sp2 * (try_divide(1, n1) + try_divide(1, n0))))"))
    return with_t_pvalue(g, "t_stat", "df_resid", "p") \
        .select(F.lit(value).alias("variable"), "n1", "n0", F.col("m1").alias("mean_1"),
                F.col("m0").alias("mean_0"), F.col("t_stat").alias("t"), "df_resid", "p")
