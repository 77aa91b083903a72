"""Special functions: closed forms and reference values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapiro_numpy import shapiro_wilk
from ticklens.functions import special
from ticklens.functions.normal import norm_ppf, norm_sf_sql


def test_t_pvalues_closed_forms(spark):
    rows = [(tv, df) for tv in [0.2, 1.0, 2.5, 7.0] for df in [1, 2]]
    out = special.with_t_pvalue(spark.createDataFrame(rows, "t double, df long"), "t", "df").collect()
    for r in out:
        ref = 1 - 2 * math.atan(r.t) / math.pi if r.df == 1 else 1 - r.t / math.sqrt(2 + r.t ** 2)
        assert r.p == pytest.approx(ref, abs=1e-13)


def test_known_t_quantile(spark):
    # two-sided 5 % point of t(30) is 2.042272456
    r = special.with_t_pvalue(spark.createDataFrame([(2.042272456301238, 30)], "t double, df long"),
                              "t", "df").collect()[0]
    assert r.p == pytest.approx(0.05, abs=1e-10)


def test_f_equals_t_squared(spark):
    d = spark.createDataFrame([(1.7, 25)], "t double, df long").withColumn("f", F.expr("t * t"))
    r = special.with_f_pvalue(special.with_t_pvalue(d, "t", "df", "pt"), "f", "1", "df", "pf").collect()[0]
    assert r.pt == pytest.approx(r.pf, rel=1e-12)


def test_lgamma(spark):
    xs = [0.5, 1.0, 1.5, 7.25, 40.0, 170.5]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.lgamma("x").alias("g")).collect()
    for r in out:
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-13)


def test_norm_ppf(spark):
    ps = [1e-12, 0.001, 0.2, 0.5, 0.8, 0.999]
    out = spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf("p").alias("z")).collect()
    for r in out:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-14, abs=1e-15)


def test_shapiro_reference_values():
    w, p = shapiro_wilk(np.arange(1, 11, dtype=float))
    assert w == pytest.approx(0.97016, abs=5e-6)
    assert p == pytest.approx(0.8924, abs=5e-5)
    rng = np.random.default_rng(1)
    _, p_norm = shapiro_wilk(rng.normal(size=400))
    _, p_unif = shapiro_wilk(rng.uniform(size=400))
    assert p_norm > 0.01 and p_unif < 1e-4


def test_t_tail_against_finite_sums(spark):
    """Incomplete beta and Hill's point against the trigonometric sums for whole degrees of freedom."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(tv, df) for tv in (0.0, 0.01, 0.5, 1.0, 2.0, 6.0) for df in (1, 2, 3, 4, 9, 10, 29, 30, 31, 999, 10_000, 10_001)]
    got = {(r.t, r.df): r.p for r in special.with_t_pvalue(
        spark.createDataFrame(rows, "t double, df long"), "t", "df").collect()}
    values = ", ".join(f"(CAST({t!r} AS DOUBLE), CAST({d} AS BIGINT))" for t, d in rows)
    sql = special.apply_stages_sql(f"SELECT * FROM (VALUES {values}) v(t, df)",
                                   special.t_pvalue_stages("t", "df", "p", special.DUCKDB))
    for t, df, p in duckdb.sql(f"SELECT t, df, p FROM ({sql})").fetchall():
        assert got[t, df] == pytest.approx(p, abs=5e-13)


def test_t_tail_at_large_df(spark):
    # normal tail and its first term in 1/df; the next one is below 1e-15 here
    rows = [(tv, 10 ** 9) for tv in (0.3, 1.0, 2.0, 5.0)]
    for r in special.with_t_pvalue(spark.createDataFrame(rows, "t double, df long"), "t", "df").collect():
        density = math.exp(-r.t ** 2 / 2) / math.sqrt(2 * math.pi)
        ref = math.erfc(r.t / math.sqrt(2)) + density * (r.t ** 3 + r.t) / (2 * r.df)
        assert r.p == pytest.approx(ref, rel=1e-12)


def test_t_tail_without_degrees_or_statistic(spark):
    rows = [(1.0, 0), (1.0, -3), (None, 5), (1.0, None)]
    for dialect_rows in special.with_t_pvalue(spark.createDataFrame(rows, "t double, df long"), "t", "df").collect():
        assert dialect_rows.p is None


def test_norm_sf(spark):
    zs = [None, -8.0, -1.0, 0.0, 0.2, 2.49, 2.51, 8.0, 20.0]
    out = spark.createDataFrame([(z,) for z in zs], "z double").select("z", F.expr(norm_sf_sql("z")).alias("p"))
    for r in out.collect():
        assert r.p is None if r.z is None else r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-12)
