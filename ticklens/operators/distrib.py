"""Distribution checks (M15-M17, M19): Shapiro-Wilk, normal Q-Q points, kernel density with a
normal reference band, local regression curve.

Q-Q, density and loess are JVM-side aggregations: each data row is exploded over a fixed grid
(``n_grid`` points, broadcast-free: the grid is an index sequence, its locations come from a
per-group statistics row joined on the group key) and summed with map-side partial
aggregation. Shapiro-Wilk ranks the rows of the groups it applies to (3 to 5,000 values, counted
first) and takes sums over the ranked rows, all as SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_ppf, norm_ppf_sql, norm_sf_sql

BLOM = 0.375


# --- M16 ----------------------------------------------------------------------------------------

def qq_points(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Normal Q-Q points (Blom positions (i - 3/8)/(n + 1/4)) and the quartile line."""
    keys = list(keys)
    wa = Window.partitionBy(*keys)
    s = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("sample"))
    s = s.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy("sample")),
                       "n": F.count(F.lit(1)).over(wa),
                       "q1": F.percentile("sample", 0.25).over(wa),
                       "q3": F.percentile("sample", 0.75).over(wa)})
    s = s.withColumn("theoretical", norm_ppf(f"(i - {BLOM}e0) / (n + 0.25e0)"))
    z1, z3 = F.expr(norm_ppf_sql("0.25e0")), F.expr(norm_ppf_sql("0.75e0"))
    slope = F.try_divide(F.col("q3") - F.col("q1"), z3 - z1)
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("q1") - F.col("slope") * z1)
    return s.select(*keys, "i", "sample", "theoretical",
                    (F.col("intercept") + F.col("slope") * F.col("theoretical")).alias("line"))


# --- M17 ----------------------------------------------------------------------------------------

def _group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample sd (two-pass: centred squares, well conditioned for large means), min, max."""
    first = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.min(value).alias("lo"), F.max(value).alias("hi"))
    dev = df.join(first.select(*keys, "mean"), keys) \
        .groupBy(*keys).agg(F.sum((F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean"))).alias("ss"))
    return first.join(dev, keys).withColumn("sd", F.sqrt(F.try_divide(F.col("ss"), F.col("n") - 1))).drop("ss")


def kde(df: DataFrame, keys: Sequence[str], value: str, n_grid: int = 100, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density on ``n_grid`` points over [min - reach*h, max + reach*h],
    h = sd * (4 / (3 n))^(1/5), with the normal reference curve N(mean, sd² + h²) and its
    ±2 standard-error band."""
    keys = list(keys)
    x = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"))
    st = _group_stats(x, keys, "x").withColumn("h", F.col("sd") * F.pow(F.lit(4.0) / (3 * F.col("n")), 0.2)) \
        .filter((F.col("n") >= 2) & (F.col("h") > 0))
    st = st.withColumns({"g0": F.col("lo") - reach * F.col("h"),
                         "dg": (F.col("hi") - F.col("lo") + 2 * reach * F.col("h")) / (n_grid - 1)})
    pts = x.join(st.select(*keys, "g0", "dg", "h"), keys) \
        .select(*keys, "x", "g0", "dg", "h", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("j"))
    u = (F.col("g0") + F.col("j") * F.col("dg") - F.col("x")) / F.col("h")
    sums = pts.groupBy(*keys, "j").agg(F.sum(F.exp(-0.5 * u * u)).alias("k"))
    out = sums.join(st, keys).withColumn("g", F.col("g0") + F.col("j") * F.col("dg"))
    inv_sqrt_2pi = 1.0 / math.sqrt(2 * math.pi)

    def phi(z, var):
        return F.exp(-0.5 * z * z / var) * inv_sqrt_2pi / F.sqrt(var)

    var_ref = F.col("sd") * F.col("sd") + F.col("h") * F.col("h")
    ref = phi(F.col("g") - F.col("mean"), var_ref)
    var_half = F.col("sd") * F.col("sd") + F.col("h") * F.col("h") / 2
    band_var = (phi(F.lit(0.0), 2 * F.col("h") * F.col("h")) * phi(F.col("g") - F.col("mean"), var_half)
                - ref * ref) / F.col("n")
    se = F.sqrt(F.greatest(band_var, F.lit(0.0)))
    return out.select(*keys, "j", "g",
                      (F.col("k") * inv_sqrt_2pi / (F.col("n") * F.col("h"))).alias("density"),
                      ref.alias("normal"), (ref - 2 * se).alias("normal_lo"), (ref + 2 * se).alias("normal_hi"))


# --- M19 ----------------------------------------------------------------------------------------

def loess_curve(df: DataFrame, keys: Sequence[str], x: str, y: str, n_grid: int = 80) -> DataFrame:
    """Local quadratic regression, tricube weights, span 1, evaluated directly on
    ``n_grid`` points over [min x, max x]. With span 1 the neighbourhood radius at g is the
    largest distance to a point, max(g - min, max - g).

    The weighted fit at g uses v = u - (weighted mean of u) so the 3x3 moment system is well
    conditioned (near the ends all points lie on one side of g); the fitted value at g is
    b0 - b1 m + b2 m². A grid point needs three weighted points and a non-degenerate system.
    """
    keys = list(keys)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")) \
        .filter((F.col("n") >= 3) & (F.col("hi") > F.col("lo")))
    st = st.withColumn("dg", (F.col("hi") - F.col("lo")) / (n_grid - 1))
    g = F.col("lo") + F.col("j") * F.col("dg")
    radius = F.greatest(g - F.col("lo"), F.col("hi") - g)
    au = F.abs(F.col("u"))

    def weighted(points):
        points = points.withColumn("u", (F.col("x") - g) / radius)
        return points.withColumn("w", F.when(au < 1, F.pow(1 - au * au * au, 3)).otherwise(0.0))

    # weighted means first, one array of n_grid numbers per group, so that the rows are exploded in
    # two map-side aggregates and never shuffled n_grid-fold
    grid = F.sequence(F.lit(0), F.lit(n_grid - 1))
    first = weighted(d.join(st.select(*keys, "lo", "hi", "dg"), keys).select("*", F.explode(grid).alias("j")))
    means = first.groupBy(*keys, "j").agg(
        F.try_divide(F.sum(F.col("w") * F.col("u")), F.sum("w")).alias("m"))
    means = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("ms"))
    st = st.join(means, keys)
    pts = d.join(st.select(*keys, "lo", "hi", "dg", "ms"), keys) \
        .select(*keys, "x", "y", "lo", "hi", "dg", F.inline("ms"))
    pts = weighted(pts).withColumn("v", F.col("u") - F.col("m"))
    vv, ww, yy = F.col("v"), F.col("w"), F.col("y")
    s = pts.groupBy(*keys, "j").agg(
        F.max("m").alias("m"),
        *[F.sum(ww * F.pow(vv, k)).alias(f"s{k}") for k in range(5)],
        *[F.sum(ww * F.pow(vv, k) * yy).alias(f"t{k}") for k in range(3)],
        F.count_if(ww > 0).alias("n_w"))
    s = s.withColumns({"det": F.expr(LOESS_DET), "b0": F.expr(LOESS_B0), "b1": F.expr(LOESS_B1),
                       "b2": F.expr(LOESS_B2)})
    ok = (F.col("n_w") >= 3) & (F.abs(F.col("det")) > LOESS_MIN_REL_DET * F.col("s0") * F.col("s2") * F.col("s4"))
    fitted = F.try_divide(F.col("b0") - F.col("b1") * F.col("m") + F.col("b2") * F.col("m") * F.col("m"), F.col("det"))
    out = s.join(st.select(*keys, "lo", "dg"), keys)
    return out.select(*keys, "j", (F.col("lo") + F.col("j") * F.col("dg")).alias("g"),
                      F.when(ok, fitted).alias("fitted"))


# Cramer's rule for the 3x3 weighted normal equations in centred coordinates.
LOESS_DET = "s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)"
LOESS_B0 = "t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)"
LOESS_B1 = "s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)"
LOESS_B2 = "s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)"
LOESS_MIN_REL_DET = 1e-6


# --- M15 ----------------------------------------------------------------------------------------

# FIXED VALUES: Royston (1995) polynomial coefficients of the Shapiro-Wilk approximation.
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


SW_LEAST, SW_MOST = 3, 5000


def _poly(coef: Sequence[float], x: str) -> str:
    """The polynomial in ``x`` as SQL (Horner)."""
    expr = f"{coef[-1]:.17e}"
    for c in reversed(coef[:-1]):
        expr = f"({expr} * {x} + {c:.17e})"
    return expr


def shapiro_by_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shapiro-Wilk W and p per group by Royston's approximation, JVM only.

    The approximation is stated for 3 to 5,000 values; outside that range and without spread W and p
    are NULL and ``reason`` says why. Such groups are counted but never ranked, so a window holds at
    most 5,000 rows. NULL values are left out; a group of NULLs only has n = 0.

    With m_i the normal quantiles of (i - 3/8) / (n + 1/4), the weights are m_i / fac but for the one
    (n = 4, 5) or two outermost values on each side, whose weights are polynomials in 1/sqrt(n).
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias("x"))
    st = d.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"),
                              F.min("x").alias("lo"), F.max("x").alias("hi"))
    st = st.withColumn("reason", F.when(F.col("n") < SW_LEAST, f"fewer than {SW_LEAST} values")
                       .when(F.col("n") > SW_MOST, f"more than {SW_MOST} values")
                       .when(~(F.col("hi") > F.col("lo")), "no spread"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"st.{k}")) for k in keys]
    ranked = d.where("x IS NOT NULL").alias("d").join(st.where("reason IS NULL").alias("st"), same) \
        .select(*(F.col(f"d.{k}") for k in keys), "x", "n", "mean")
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("x"))) \
        .withColumns({"m": norm_ppf(f"(i - {BLOM}e0) / (n + 0.25e0)"), "c": F.col("x") - F.col("mean")})
    sums = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.expr("sum(m * m)").alias("mm"), F.expr("sum(m * c)").alias("mc"),
        F.expr("sum(c * c)").alias("cc"), F.max("c").alias("top1"), F.min("c").alias("low1"),
        F.max(F.expr("CASE WHEN i = n - 1 THEN c END")).alias("top2"),
        F.max(F.expr("CASE WHEN i = 2 THEN c END")).alias("low2"),
        F.max("m").alias("m1"), F.max(F.expr("CASE WHEN i = n - 1 THEN m END")).alias("m2"))
    sums = sums.withColumn("r", F.expr("1 / sqrt(n)"))
    sums = sums.withColumns({
        "a1": F.expr(f"CASE WHEN n = 3 THEN sqrt(0.5e0) ELSE {_poly(SW_C1, 'r')} + m1 / sqrt(mm) END"),
        "a2": F.expr(f"CASE WHEN n > 5 THEN {_poly(SW_C2, 'r')} + m2 / sqrt(mm) ELSE 0e0 END"),
        # what the outermost values take away from the sums over m
        "out_mm": F.expr("2 * m1 * m1 + CASE WHEN n > 5 THEN 2 * m2 * m2 ELSE 0e0 END"),
        "out_mc": F.expr("m1 * (top1 - low1) + CASE WHEN n > 5 THEN m2 * (top2 - low2) ELSE 0e0 END")})
    sums = sums.withColumn("fac", F.expr(
        "CASE WHEN n > 3 THEN sqrt((mm - out_mm) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END"))
    sums = sums.withColumn("ac", F.expr(
        "a1 * (top1 - low1) + CASE WHEN n > 5 THEN a2 * (top2 - low2) ELSE 0e0 END "
        "+ coalesce((mc - out_mc) / fac, 0e0)"))
    # the weights have length one by construction
    sums = sums.withColumn("w", F.expr("least(ac * ac / cc, 1e0)"))
    sums = sums.withColumns({"y": F.expr("ln(1 - w)"), "ln_n": F.expr("ln(n)"),
                             "gamma": F.expr(_poly(SW_G, "n"))})
    sums = sums.withColumn("z", F.expr(
        f"CASE WHEN n <= 11 THEN (-ln(gamma - y) - {_poly(SW_C3, 'n')}) / exp({_poly(SW_C4, 'n')}) "
        f"ELSE (y - {_poly(SW_C5, 'ln_n')}) / exp({_poly(SW_C6, 'ln_n')}) END"))
    p = (f"CASE WHEN n = 3 THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75e0))), 0e0) "
         f"WHEN w = 1 THEN 1e0 WHEN n <= 11 AND y >= gamma THEN 1e-99 ELSE {norm_sf_sql('z')} END")
    tested = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), "w", F.expr(p).alias("p"))
    joined = st.join(tested, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.select(*keys, "n", "w", "p", "reason")
