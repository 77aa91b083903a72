"""Normal quantile function as a SQL expression (Wichura's algorithm AS 241, PPND16).

Spark has no inverse normal CDF. The rational approximations below (relative accuracy about
1e-16) are plain SQL arithmetic, valid in Spark SQL and DuckDB, so Q-Q points stay in the JVM
and the oracle states the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: coefficients of AS 241 (central region a/b, tails c/d and e/f).
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3,
           1.3731693765509461125e+4, 4.5921953931549871457e+4, 6.7265770927008700853e+4,
           3.3430575583588128105e+4, 2.5090809287301226727e+3]
AS241_B = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
           2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4,
           5.2264952788528545610e+3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15]


def _lit(v: float) -> str:
    return f"{v:.20e}"


def _horner(coef: list[float], r: str) -> str:
    expr = _lit(coef[-1])
    for c in reversed(coef[:-1]):
        expr = f"({expr} * {r} + {_lit(c)})"
    return expr


def norm_ppf_sql(p: str) -> str:
    """Quantile of the standard normal at probability ``p`` (NULL outside (0, 1))."""
    q = f"(({p}) - 0.5e0)"
    rc = f"(0.180625e0 - {q} * {q})"
    central = f"({q} * {_horner(AS241_A, rc)} / {_horner(AS241_B, rc)})"
    rt = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END))"
    near = f"({rt} - 1.6e0)"
    far = f"({rt} - 5e0)"
    tail = (f"(CASE WHEN {rt} <= 5e0 THEN {_horner(AS241_C, near)} / {_horner(AS241_D, near)} "
            f"ELSE {_horner(AS241_E, far)} / {_horner(AS241_F, far)} END)")
    return (f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 0.425e0 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


#: the power series of the normal tail serves below this point, the continued fraction above
SERIES_BELOW = 2.5
TAIL_TERMS = 60


def norm_sf_sql(z: str) -> str:
    """P(Z > z) of the standard normal in Spark SQL, relative accuracy about 1e-15 (NULL for NULL).

    1/2 - phi(z) (z + z^3/3 + z^5/(3 5) + ...) near 0, phi(z) / (z + 1/(z + 2/(z + ...))) in the tail.
    """
    a, phi = f"abs({z})", f"(exp(-0.5e0 * ({z}) * ({z})) * 0.39894228040143267794e0)"
    series = (f"(0.5e0 - {phi} * aggregate(sequence(1, {TAIL_TERMS}), named_struct('f', {a}, 's', {a}), "
              f"(acc, j) -> named_struct('f', acc.f * ({z}) * ({z}) / (2 * j + 1), "
              f"'s', acc.s + acc.f * ({z}) * ({z}) / (2 * j + 1))).s)")
    fraction = f"({phi} / aggregate(sequence(1, {TAIL_TERMS}), {a}, (acc, j) -> {a} + ({TAIL_TERMS + 1} - j) / acc))"
    tail = f"(CASE WHEN {a} < {SERIES_BELOW:e} THEN {series} ELSE {fraction} END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) < 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf(p: str) -> Column:
    return F.expr(norm_ppf_sql(p))
