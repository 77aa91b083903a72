"""Events per fixed interval and the Poisson check.

Everything is computed from per-bucket counts: trades -> (ticker, date, bucket) counts with
map-side partial aggregation; the day's first and last bucket come from a window over that
bucket table, which holds at most one row per interval of the trading day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import lgamma
from ..schema import DISTRIBUTION_SECONDS, MICROS_PER_SECOND

DAY = ["ticker", "date"]


def bucket_counts(events: DataFrame, seconds: int = DISTRIBUTION_SECONDS, day: Sequence[str] = DAY) -> DataFrame:
    """T6 + T8: events per ``seconds`` bucket of the day, with the day's first/last bucket.

    ``bucket = floor(whole seconds of day / seconds)``; first/last follow file order (seq).
    """
    step = seconds * MICROS_PER_SECOND
    b = events.withColumn("bucket", F.floor(F.col("time_us") / F.lit(step)).cast("long"))
    bc = b.groupBy(*day, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s0"),
                                        F.max("seq").alias("s1"))
    w = Window.partitionBy(*day)
    return bc.withColumns({"k_first": F.min_by("bucket", "s0").over(w),
                           "k_last": F.max_by("bucket", "s1").over(w)}).drop("s0", "s1")


def daily_distribution(events: DataFrame, seconds: int = DISTRIBUTION_SECONDS, day: Sequence[str] = DAY) -> DataFrame:
    """A8 + A9 (T7): per day, how many interior intervals hold exactly ``category`` events.

    The first and last (partial) interval of a day are left out; category 0 counts the
    interior intervals without an event and is always present.
    """
    bc = bucket_counts(events, seconds, day)
    interior = (F.col("bucket") != F.col("k_first")) & (F.col("bucket") != F.col("k_last"))
    counts = bc.filter(interior).groupBy(*day, F.col("n").alias("category")) \
        .agg(F.count(F.lit(1)).alias("frequency"))
    zero = bc.groupBy(*day).agg(F.max("k_first").alias("k_first"), F.max("k_last").alias("k_last"),
                                F.count_if(interior).alias("busy"))
    zero = zero.select(*day, F.lit(0).cast("long").alias("category"), F.greatest(
        F.greatest(F.col("k_last") - F.col("k_first") - 1, F.lit(0)) - F.col("busy"), F.lit(0))
        .cast("long").alias("frequency"))
    return counts.unionByName(zero)


def distribution(events: DataFrame, seconds: int = DISTRIBUTION_SECONDS, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """A10: daily distributions added up (per ``keys``, default per ticker; or per marketplace)."""
    day = ["marketplace", *DAY] if "marketplace" in keys else DAY
    return daily_distribution(events, seconds, day).groupBy(*keys, "category") \
        .agg(F.sum("frequency").alias("frequency"))


def weighted_mean(dist: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Mean of the raw counts a frequency table stands for: sum(cat*freq) / sum(freq)."""
    return dist.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("category") * F.col("frequency")), F.sum("frequency")).alias("lambda"),
        F.sum("frequency").alias("total"))


def poisson_check(dist: DataFrame, k_max: int = 30, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Poisson pmf for k = 0..k_max with lambda = A15, beside the empirical share."""
    lam = weighted_mean(dist, keys)
    grid = lam.select(*keys, "lambda", "total", F.explode(F.sequence(F.lit(0), F.lit(k_max))).alias("k"))
    k = F.col("k").cast("double")
    pmf = F.when(F.col("lambda") == 0, F.when(F.col("k") == 0, 1.0).otherwise(0.0)).otherwise(
        F.exp(k * F.log("lambda") - F.col("lambda") - lgamma("CAST(k AS DOUBLE) + 1")))
    d = dist.select(*keys, F.col("category").cast("int").alias("k"), F.col("frequency"))
    out = grid.join(d, [*keys, "k"], "left")
    return out.select(*keys, "k", pmf.alias("pmf"),
                      F.try_divide(F.coalesce(F.col("frequency"), F.lit(0)).cast("double"), F.col("total")).alias("share"))


def density_histogram(dist: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Density histogram with breaks at the categories; bins (a, b], the first closed.

    density = count in bin / (total * width).
    """
    w = Window.partitionBy(*keys).orderBy("category")
    d = dist.withColumns({"lo": F.lag("category").over(w), "rank": F.row_number().over(w),
                          "first_freq": F.first("frequency").over(w)})
    total = F.sum("frequency").over(Window.partitionBy(*keys))
    d = d.withColumn("total", total)
    cnt = F.col("frequency") + F.when(F.col("rank") == 2, F.col("first_freq")).otherwise(0)
    return d.filter(F.col("lo").isNotNull()).select(
        *keys, F.col("lo").alias("bin_lo"), F.col("category").alias("bin_hi"),
        F.try_divide(cnt.cast("double"), (F.col("total") * (F.col("category") - F.col("lo"))).cast("double"))
        .alias("density"))
