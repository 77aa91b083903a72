"""Sampled log-midpoint series and realised volatility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GRID_STEP_SECONDS, MICROS_PER_SECOND
from .sequence import SLICE_COL, neighbors

DAY = ["ticker", "date"]


def last_per_timestamp(v: DataFrame, value: str = "log_mid", day: Sequence[str] = DAY) -> DataFrame:
    """Keep the last quote (by ``seq``) of each timestamp of a day."""
    d = neighbors(v.select(*day, SLICE_COL, "seq", "time_us", value), day,
                  next_cols=["time_us"], next_prefix="dup_")
    return d.filter(F.col("dup_time_us").isNull() | (F.col("dup_time_us") != F.col("time_us"))) \
        .drop("dup_time_us")


def log_midpoint_series(v: DataFrame, step_seconds: int = GRID_STEP_SECONDS, day: Sequence[str] = DAY) -> DataFrame:
    """The log midpoint at every multiple of ``step_seconds`` inside the day's quotes.

    Each deduplicated quote opens a segment ``[t0, t1)`` to the next one; the segment emits the
    grid points it covers, linearly interpolated in time (the last quote emits its own time if
    it lies on the grid). Per day at most one point per step inside the trading hours, so the
    explode is bounded by the trading day, not by the number of quotes.
    Output: ticker, date, time_us (grid point), log_midpoint.
    """
    step = step_seconds * MICROS_PER_SECOND
    d = neighbors(last_per_timestamp(v, day=day), day, next_cols=["time_us", "log_mid"], next_prefix="n_")
    t0, t1 = F.col("time_us"), F.col("n_time_us")
    y0, y1 = F.col("log_mid"), F.col("n_log_mid")
    lo = F.floor((t0 + (step - 1)) / F.lit(step)).cast("long")
    hi = F.when(t1.isNull(), F.floor(t0 / F.lit(step)).cast("long")) \
        .otherwise(F.floor((t1 + (step - 1)) / F.lit(step)).cast("long") - 1)
    seg = d.select(*day, t0.alias("t0"), t1.alias("t1"), y0.alias("y0"), y1.alias("y1"),
                   lo.alias("lo"), hi.alias("hi")).filter(F.col("hi") >= F.col("lo"))
    g = F.col("k") * F.lit(step)
    slope = F.try_divide(F.col("y1") - F.col("y0"), (F.col("t1") - F.col("t0")).cast("double"))
    y = F.when(g == F.col("t0"), F.col("y0")).otherwise(slope * (g - F.col("t0")).cast("double") + F.col("y0"))
    return seg.select(*day, F.explode(F.sequence("lo", "hi")).alias("k"), "t0", "t1", "y0", "y1") \
        .select(*day, g.alias("time_us"), y.alias("log_midpoint"))


def drop_repeats(series: DataFrame, value: str = "log_midpoint", day: Sequence[str] = DAY) -> DataFrame:
    """T5: drop a grid point equal to its predecessor (first point kept). Bounded per day."""
    w = Window.partitionBy(*day).orderBy("time_us")
    prev = F.lag(value, 1).over(w)
    return series.withColumn("_prev", prev) \
        .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")


def realised_volatility(series: DataFrame, value: str = "log_midpoint", day: Sequence[str] = DAY) -> DataFrame:
    """A5: population standard deviation of the de-repeated sampled levels per day."""
    return drop_repeats(series, value, day).groupBy(*day).agg(F.stddev_pop(value).alias("sigma_m_log"))
