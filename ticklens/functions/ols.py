"""Simple least squares from aggregated moments.

A regression is a group-by: ``regr_count/regr_sxx/regr_sxy/regr_syy/regr_avgx/regr_avgy`` are
algebraic aggregates with map-side partial aggregation, so any number of regressions (one per
model and ticker) is one shuffle of partial states. The formulas below turn those moments
into the fit statistics; they are SQL text so the DuckDB oracle uses the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import SPARK, Dialect, apply_stages, apply_stages_sql, t_pvalue_stages

MOMENTS = ["n", "sxx", "sxy", "syy", "avgx", "avgy"]


def moments(y: str = "y", x: str = "x") -> list[Column]:
    """Aggregate expressions of the fit moments (rows with a NULL y or x are left out)."""
    return [F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"),
            F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("avgx"), F.regr_avgy(y, x).alias("avgy")]


def moments_sql(y: str = "y", x: str = "x") -> str:
    return (f"regr_count({y}, {x}) AS n, regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, "
            f"regr_syy({y}, {x}) AS syy, regr_avgx({y}, {x}) AS avgx, regr_avgy({y}, {x}) AS avgy")


def fit_stages(d: Dialect, df_resid: str = "n - 2", intercept: bool = True) -> list[dict[str, str]]:
    """Column definitions, stage by stage, from the moments to mu, a, a_se, p, r², adj. r².

    ``df_resid`` is the residual degrees of freedom (n - 2 for a line, n - G - 1 within).
    One regressor, so the F statistic is t² and its p-value equals the slope's p-value.
    """
    return [
        {"a": d.div("sxy", "sxx"), "df_resid": df_resid},
        {"mu": "avgy - a * avgx" if intercept else "CAST(NULL AS DOUBLE)",
         "rss": f"greatest(syy - {d.div('sxy * sxy', 'sxx')}, 0)",
         "r_squared": d.div("sxy * sxy", "sxx * syy")},
        {"a_se": f"CASE WHEN df_resid > 0 THEN sqrt({d.div(d.div('rss', 'df_resid'), 'sxx')}) END",
         "r_adjusted": f"1 - (1 - r_squared) * {d.div('n - 1', 'df_resid')}"},
        {"t_stat": d.div("a", "a_se")},
        *t_pvalue_stages("t_stat", "df_resid", "p", d),
        {"f_test_p": "p"},
    ]


def fit(df: DataFrame, df_resid: str = "n - 2", intercept: bool = True) -> DataFrame:
    """Add the fit statistics to a DataFrame of moments (one row per regression)."""
    return apply_stages(df, fit_stages(SPARK, df_resid, intercept))


def fit_sql(inner: str, d: Dialect, df_resid: str = "n - 2", intercept: bool = True) -> str:
    """The same stages as nested SELECTs over ``inner`` (a query producing the moments)."""
    return apply_stages_sql(inner, fit_stages(d, df_resid, intercept))
