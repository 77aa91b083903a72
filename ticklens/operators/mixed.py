"""Linear mixed model with a random intercept per ticker, fitted by REML (M8).

y_ij = b0 + b1 x_ij + u_i + e_ij with u_i ~ N(0, s_u²), e_ij ~ N(0, s_e²). With the variance
ratio l = s_u² / s_e², every quantity of the restricted likelihood is a sum over tickers of
closed forms in the per-ticker sums (n, Sx, Sy, Sxx, Sxy, Syy), with c_i = 1 / (1 + n_i l):

    A   = sum [[n c, Sx c], [Sx c, Sxx - l/(1+n l) Sx²]]      (X' V^-1 X, times s_e²)
    b   = sum [Sy c, Sxy - l/(1+n l) Sx Sy]                   (X' V^-1 y, times s_e²)
    RSS = sum (Syy - l/(1+n l) Sy²) - b' A^-1 b
    -2 logL_R(l) = (N - 2) ln(RSS / (N - 2)) + sum ln(1 + n l) + ln det A  (+ const)

The per-ticker sums are one group-by; the criterion is evaluated for a grid of l per sample
(a bounded explode: grid size x tickers), refined twice around the best value, all as
aggregations. s_e² = RSS / (N - 2), s_u² = l s_e², Var(b) = s_e² A^-1, slope tested with
N - G - 1 degrees of freedom (a within-ticker covariate). With one ticker the criterion does not
depend on l (the fixed intercept takes the random one up), so l = 0 is reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import with_t_pvalue
from .container import materialize, model_long
from .models import PANEL_VENUES, _panel_sample

LOG10_LO, LOG10_HI, COARSE = -8.0, 8.0, 400
FINE = 100


def ticker_sums(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sample key and ticker: n, Sx, Sy, Sxx, Sxy, Syy of x and y about the sample's means.

    Moments are taken about each ticker's own mean (``regr_*``) and moved to the sample's, so no
    large squares are subtracted. ``mx`` and ``my`` are the sample's means.
    """
    own = long.groupBy(*keys, "ticker").agg(
        F.regr_count("y", "x").cast("double").alias("n"), F.regr_avgx("y", "x").alias("ax"),
        F.regr_avgy("y", "x").alias("ay"), F.regr_sxx("y", "x").alias("cxx"), F.regr_sxy("y", "x").alias("cxy"),
        F.regr_syy("y", "x").alias("cyy")).where("n > 0")
    means = own.groupBy(*keys).agg((F.sum(F.col("n") * F.col("ax")) / F.sum("n")).alias("mx"),
                                   (F.sum(F.col("n") * F.col("ay")) / F.sum("n")).alias("my"))
    n, dx, dy = F.col("n"), F.col("ax") - F.col("mx"), F.col("ay") - F.col("my")
    return own.join(means, list(keys)).select(
        *keys, "ticker", "n", "mx", "my", (n * dx).alias("sx"), (n * dy).alias("sy"),
        (F.col("cxx") + n * dx * dx).alias("sxx"), (F.col("cxy") + n * dx * dy).alias("sxy"),
        (F.col("cyy") + n * dy * dy).alias("syy"))


def _criterion(sums: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """-2 REML log-likelihood (up to a constant) and the fit for every (key, lambda)."""
    j = sums.join(grid, keys)
    lam, n = F.col("lam"), F.col("n")
    c = 1 / (1 + n * lam)
    wl = lam * c                                  # l / (1 + n l)
    agg = j.groupBy(*keys, "lam").agg(
        F.sum(n * c).alias("a11"), F.sum(F.col("sx") * c).alias("a12"),
        F.sum(F.col("sxx") - wl * F.col("sx") * F.col("sx")).alias("a22"),
        F.sum(F.col("sy") * c).alias("b1"), F.sum(F.col("sxy") - wl * F.col("sx") * F.col("sy")).alias("b2"),
        F.sum(F.col("syy") - wl * F.col("sy") * F.col("sy")).alias("yvy"),
        F.sum(F.log1p(n * lam)).alias("logdet_v"), F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("groups"),
        F.max("mx").alias("mx"), F.max("my").alias("my"))
    agg = agg.withColumn("det", F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12"))
    agg = agg.withColumns({
        "beta0": F.try_divide(F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2"), F.col("det")),
        "beta1": F.try_divide(F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1"), F.col("det")),
    })
    agg = agg.withColumn("rss", F.col("yvy") - F.col("beta0") * F.col("b1") - F.col("beta1") * F.col("b2"))
    crit = (F.col("n_obs") - 2) * F.log(F.try_divide(F.col("rss"), F.col("n_obs") - 2)) \
        + F.col("logdet_v") + F.log(F.col("det"))
    identified = (F.col("groups") > 1) | (F.col("lam") == 0)
    return agg.withColumn("crit", crit).filter(identified & F.col("crit").isNotNull() & ~F.isnan("crit"))


def _grid(keys_df: DataFrame, keys: list[str], lo: F.Column, step: F.Column, count: int, with_zero: bool) -> DataFrame:
    g = keys_df.select(*keys, lo.alias("_lo"), step.alias("_st"),
                       F.explode(F.sequence(F.lit(0), F.lit(count))).alias("_k"))
    g = g.select(*keys, F.pow(F.lit(10.0), F.col("_lo") + F.col("_k") * F.col("_st")).alias("lam"))
    if with_zero:
        g = g.unionByName(keys_df.select(*keys, F.lit(0.0).alias("lam")))
    return g


def random_intercept(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M8: REML fit per sample ``keys`` (e.g. venue, index, model) of y ~ x + (1 | ticker)."""
    keys = list(keys)
    sums = materialize(ticker_sums(long, keys))          # small: one row per sample and ticker
    key_df = sums.select(*keys).distinct()
    step0 = (LOG10_HI - LOG10_LO) / COARSE
    best = None
    grid = _grid(key_df, keys, F.lit(LOG10_LO), F.lit(step0), COARSE, with_zero=True)
    width = step0
    for _ in range(3):
        crit = _criterion(sums, grid, keys)
        fields = [c for c in crit.columns if c not in keys]
        best = materialize(crit.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.col("crit")).alias("b"))
                           .select(*keys, "b.*"))          # one row per sample; each level runs once
        centre = F.when(F.col("lam") > 0, F.log10("lam")).otherwise(F.lit(LOG10_LO))
        grid = _grid(best, keys, centre - width, F.lit(2 * width / FINE), FINE, with_zero=False) \
            .unionByName(best.select(*keys, "lam")).distinct()      # a ratio that is there twice would count twice
        width = 2 * width / FINE
    out = best.withColumns({
        "sigma_e2": F.try_divide(F.col("rss"), F.col("n_obs") - 2),
    }).withColumns({
        "sigma_u2": F.col("lam") * F.col("sigma_e2"),
        "a_se": F.sqrt(F.try_divide(F.col("sigma_e2") * F.col("a11"), F.col("det"))),
        "df_resid": (F.col("n_obs") - F.col("groups") - 1).cast("long"),
    }).withColumn("t_stat", F.try_divide(F.col("beta1"), F.col("a_se")))
    out = with_t_pvalue(out, "t_stat", "df_resid", "p")
    return out.select(*keys, (F.col("beta0") + F.col("my") - F.col("beta1") * F.col("mx")).alias("mu"),
                      F.col("beta1").alias("a"), "a_se", "p",
                      F.sqrt("sigma_e2").alias("sigma_e"), F.sqrt("sigma_u2").alias("sigma_u"),
                      F.col("lam").alias("variance_ratio"),
                      # the search ends at a bound: the ratio is a limit, not an estimate
                      ((F.col("lam") > 0) & ((F.col("lam") <= 10.0 ** LOG10_LO * 1.01)
                                             | (F.col("lam") >= 10.0 ** LOG10_HI * 0.99))).alias("at_bound"), F.col("n_obs").cast("long").alias("n"),
                      "groups", F.col("crit").alias("reml_deviance"))


def panel_random_intercept(c: DataFrame, venues: Sequence[str] = tuple(PANEL_VENUES)) -> DataFrame:
    """M8 for every venue x index sample and model, x = ln W (as the panel models)."""
    long = model_long(_panel_sample(c, venues), ["venue", "index", "ticker"], relative=False)
    return random_intercept(long, ["venue", "index", "model"])


