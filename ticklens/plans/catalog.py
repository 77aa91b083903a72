"""Catalogue of named queries: a Spark plan and, where SQL can state it, a DuckDB twin.

Every query reads the driver tables of a scale-factor folder (``sf_dir``) and runs over the
whole tables. ``queries`` gives the plain results. Comparing two engines bit for bit needs a
common rounding of doubles, because sums in another order differ in the last bits:
``compared_queries`` applies it, and the SQL of ``oracle_sql`` states the same rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import oracle as O



@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


#: powers of two from 2^-POWERS to 2^POWERS serve the rounding
POWERS = 62

REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column like ``oracle.sig_round_sql`` (comparison step).

    The binary exponent is a log2 estimate corrected against exact powers of two, which come
    from one literal array, so a column adds little generated code.
    """
    names = [f.name for f in df.schema.fields]
    dbl = {f.name: k for k, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.DoubleType)}
    if not dbl:
        return df
    powers = F.array(*(F.lit(2.0 ** k) for k in range(-POWERS, POWERS + 1)))

    def pow2(k):
        return F.get(powers, (k + F.lit(POWERS)).cast("int"))

    def size(c):
        return F.least(F.greatest(F.abs(F.col(f"`{c}`")), F.lit(O.ZERO_BELOW)), F.lit(1e15))

    est = df.select("*", *(F.floor(F.log2(size(c))).cast("int").alias(f"_e{k}") for c, k in dbl.items()))
    steps = est.select(*(F.col(f"`{c}`") for c in names), *(
        (F.col(f"_e{k}") - (pow2(F.col(f"_e{k}")) > size(c)).cast("int")
         + (pow2(F.col(f"_e{k}") + 1) <= size(c)).cast("int")).alias(f"_e{k}") for c, k in dbl.items()))

    def final(c, k):
        x, p = F.col(f"`{c}`"), pow2(F.least(F.lit(O.SIG_BITS - 1) - F.col(f"_e{k}"), F.lit(O.ABS_BITS)))
        return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= 1e15), x)
                .when(F.abs(x) < O.ZERO_BELOW, F.lit(0.0))
                .otherwise(F.round(x * p, 0) / p)).alias(c)

    return steps.select(*(final(c, dbl[c]) if c in dbl else F.col(f"`{c}`") for c in names))


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries as _q  # noqa: F401  (registers)
    return {k: v.build for k, v in REGISTRY.items()}


def compared_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The named queries with their doubles rounded as ``oracle_sql`` rounds them."""
    def rounding(build):
        return lambda spark, sf_dir: rounded(build(spark, sf_dir))
    return {k: rounding(f) for k, f in queries().items()}


def oracle_sql() -> dict[str, str]:
    from . import queries as _q  # noqa: F401
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}
