"""Comparisons of slopes.

Inputs are coefficient tables: one row per (symbol, model) or per (venue, index, model).
The pairwise z-tests pair rows only inside an equality key - the venue for stocks, (index, stock)
for venues. The pairs are the result; a key's pairs are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MODELS, PRIMARY_VENUES, SIGNIFICANCE_1, SIGNIFICANCE_5

Z_COLS = [f"z{i}" for i in range(1, len(MODELS) + 1)]


def significant(coef: DataFrame, level: float = SIGNIFICANCE_5) -> DataFrame:
    """slopes with p <= level."""
    return coef.filter(F.col("p") <= level)


def slope_summary(coef: DataFrame) -> DataFrame:
    """Per index, model and venue: mean/min/max/median of all and of significant
    slopes, significance counts and mean r²; groups without a significant slope are dropped."""
    sig = F.col("p") <= SIGNIFICANCE_5
    a_sig = F.when(sig, F.col("a"))
    out = coef.filter(F.col("index").isNotNull()).groupBy("index", "model", "venue").agg(
        F.avg("a").alias("mean_all"), F.min("a").alias("min_all"), F.max("a").alias("max_all"),
        F.median("a").alias("median_all"),
        F.avg(a_sig).alias("mean_significant"), F.min(a_sig).alias("min_significant"),
        F.max(a_sig).alias("max_significant"), F.median(a_sig).alias("median_significant"),
        F.count_if(sig).alias("p5"), F.count_if(F.col("p") <= SIGNIFICANCE_1).alias("p1"),
        F.count(F.lit(1)).alias("n"),
        F.avg("r_squared").alias("r_squared"), F.avg("r_adjusted").alias("r_adjusted"))
    return out.filter(F.col("p5") > 0)


def _z(a1, se1, a2, se2):
    return F.try_divide(a1 - a2, F.sqrt(se1 * se1 + se2 * se2))


def _pivot(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column z1..z6 per model (fixed model list, so no distinct-values pass)."""
    wide = pairs.groupBy(*keys).pivot("model", MODELS).agg(F.first("z"))
    return wide.withColumnsRenamed(dict(zip(MODELS, Z_COLS)))


def _wide(coef: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slope and standard error of every model as columns, one row per ``keys``."""
    slope = {m: F.max(F.when(F.col("model") == m, F.struct("a", "a_se"))) for m in MODELS}
    return coef.groupBy(*keys).agg(*(slope[m].alias(z) for m, z in zip(MODELS, Z_COLS)))


#: tasks over which the pairs of one key are spread
PAIR_SALTS = 16


def _pairs(coef: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """z1..z6 for pairs of ``member`` with equal ``key``, ordered member1 < member2.

    Models become columns before the join, so a pair is one row; the left side of a key is spread
    over ``PAIR_SALTS`` parts and the right side meets each of them, so one venue with many stocks
    does not end in one task.
    """
    wide = _wide(coef, [*key, member])
    salt = F.pmod(F.xxhash64(member), F.lit(PAIR_SALTS)).cast("int")
    left = wide.withColumn("_salt", salt).alias("l")
    right = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1)))).alias("r")
    pairs = left.join(right, [*key, "_salt"]).where(F.col(f"l.{member}") < F.col(f"r.{member}"))
    z = [_z(F.col(f"l.{z}.a"), F.col(f"l.{z}.a_se"), F.col(f"r.{z}.a"), F.col(f"r.{z}.a_se")).alias(z) for z in Z_COLS]
    return pairs.select(*key, F.col(f"l.{member}").alias(f"{member}1"), F.col(f"r.{member}").alias(f"{member}2"), *z)


def z_between_stocks(coef: DataFrame, venues: Sequence[str] = tuple(PRIMARY_VENUES)) -> DataFrame:
    """Z of equal slopes for every pair of stocks on the same primary venue."""
    c = coef.filter(F.col("venue").isin(*venues))
    return _pairs(c, ["venue"], "symbol").select("symbol1", "symbol2", "venue", *Z_COLS)


def z_between_venues(coef: DataFrame) -> DataFrame:
    """Z of equal slopes for every pair of venues of the same stock (per index)."""
    c = coef.filter(F.col("index").isNotNull() & F.col("symbol_rm").isNotNull()) \
        .drop("symbol").withColumnRenamed("symbol_rm", "symbol")
    return _pairs(c, ["index", "symbol"], "venue")


def z_between_periods(coef_periods: DataFrame, venues: Sequence[str] = tuple(PRIMARY_VENUES)) -> DataFrame:
    """Z of equal slopes of a stock between period 1 and period 2 on a primary venue."""
    c = coef_periods.filter(F.col("venue").isin(*venues))
    keys = ["venue", "symbol_rm", "model"]
    p1 = c.filter(F.col("period") == 1).select(*keys, F.col("a").alias("a1"), F.col("a_se").alias("se1"))
    p2 = c.filter(F.col("period") == 2).select(*keys, F.col("a").alias("a2"), F.col("a_se").alias("se2"))
    j = p1.join(p2, keys).withColumn("z", _z(F.col("a1"), F.col("se1"), F.col("a2"), F.col("se2")))
    return _pivot(j.withColumnRenamed("symbol_rm", "symbol"), ["symbol", "venue"])


def z_panel_between_venues(panel: DataFrame) -> DataFrame:
    """Z of equal panel slopes for every pair of venues within an index."""
    return _pairs(panel, ["index"], "venue")


def z_panel_between_periods(panel_periods: DataFrame, venues: Sequence[str] = tuple(PRIMARY_VENUES)) -> DataFrame:
    """Z of equal panel slopes between period 1 and period 2 (per index and venue)."""
    c = panel_periods.filter(F.col("venue").isin(*venues))
    keys = ["index", "venue", "model"]
    p1 = c.filter(F.col("period") == 1).select(*keys, F.col("a").alias("a1"), F.col("a_se").alias("se1"))
    p2 = c.filter(F.col("period") == 2).select(*keys, F.col("a").alias("a2"), F.col("a_se").alias("se2"))
    j = p1.join(p2, keys).withColumn("z", _z(F.col("a1"), F.col("se1"), F.col("a2"), F.col("se2")))
    return _pivot(j, ["index", "venue"])
