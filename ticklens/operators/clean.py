"""Cleaning and per-row measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import time_of_day_us
from ..schema import (MICROS_PER_HOUR, PRIMARY_MARKETPLACES, TRADE_QUALIFIER_PREFIX,
                      TRADING_CLOSE, TRADING_OPEN)


def fill_offsets(ticks: DataFrame) -> DataFrame:
    """a missing GMT offset becomes the first known one of the ticker's day, else of the ticker.

    The known offsets are one row per (marketplace, ticker, date), aggregated before the join.
    Rows of a ticker without any offset keep NULL (see ``rejects``).
    """
    by_day = ticks.where("gmt_offset is not null").groupBy("marketplace", "ticker", "date").agg(
        F.min("seq").alias("_s"), F.min_by("gmt_offset", "seq").alias("_day_offset"))
    by_ticker = by_day.groupBy("marketplace", "ticker").agg(F.min_by("_day_offset", "_s").alias("_offset"))
    out = ticks.join(by_day.drop("_s"), ["marketplace", "ticker", "date"], "left") \
        .join(by_ticker, ["marketplace", "ticker"], "left")
    filled = F.coalesce("gmt_offset", "_day_offset", "_offset")
    return out.withColumn("gmt_offset", filled).select(*ticks.columns)


def rejects(ticks: DataFrame) -> DataFrame:
    """Rows per marketplace and ticker that the daily aggregates can't place: no date, time or offset."""
    return ticks.groupBy("marketplace", "ticker").agg(
        F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(F.col("time_us").isNull()).alias("no_time"),
        F.count_if(F.col("gmt_offset").isNull()).alias("no_offset")).where("no_date + no_time + no_offset > 0")


def local_time(ticks: DataFrame, primary_marketplaces: Sequence[str] = tuple(PRIMARY_MARKETPLACES)) -> DataFrame:
    """shift ``time_us`` by the row's GMT offset, plus one hour off the primary markets."""
    extra = F.when(F.col("marketplace").isin(*primary_marketplaces), 0).otherwise(1)
    shift = (F.col("gmt_offset") + extra).cast("long") * MICROS_PER_HOUR
    return ticks.withColumn("time_us", F.col("time_us") + shift)


#: local time as stored at staging, so that the hours filter reaches the scan
LOCAL_COLUMN = "local_us"


def with_local_time(ticks: DataFrame) -> DataFrame:
    """F1 as a stored column: ``local_us`` beside the unchanged ``time_us``."""
    shifted = local_time(ticks.withColumn("_raw_us", F.col("time_us")))
    return shifted.withColumnRenamed("time_us", LOCAL_COLUMN).withColumnRenamed("_raw_us", "time_us") \
        .select(*ticks.columns, LOCAL_COLUMN)


def trading_hours(ticks: DataFrame, open_time: str = TRADING_OPEN, close_time: str = TRADING_CLOSE) -> DataFrame:
    """F2: keep ticks with ``open <= time <= close`` (both inclusive, microsecond precision)."""
    lo = time_of_day_us(F.lit(open_time))
    hi = time_of_day_us(F.lit(close_time))
    return ticks.filter(F.col("time_us").between(lo, hi))


def clean(ticks: DataFrame, open_time: str = TRADING_OPEN, close_time: str = TRADING_CLOSE) -> DataFrame:
    """F1 then F2. Where staging stored the local time, the filter is on that column and is pushed to
    the scan, which skips row groups by its statistics."""
    if LOCAL_COLUMN in ticks.columns:
        within = F.col(LOCAL_COLUMN).between(time_of_day_us(F.lit(open_time)), time_of_day_us(F.lit(close_time)))
        return ticks.filter(within).withColumn("time_us", F.col(LOCAL_COLUMN)).drop(LOCAL_COLUMN)
    return trading_hours(local_time(ticks), open_time, close_time)


def trades(ticks: DataFrame, prefix: str = TRADE_QUALIFIER_PREFIX) -> DataFrame:
    """valid trades (type Trade, qualifiers starting with the flag)."""
    return ticks.filter((F.col("type") == "Trade") & F.col("qualifiers").startswith(prefix)) \
        .select("marketplace", "ticker", "date", "time_us", "price", "volume", "seq")


def quotes(ticks: DataFrame) -> DataFrame:
    """quotes."""
    return ticks.filter(F.col("type") == "Quote").select(
        "marketplace", "ticker", "date", "time_us", "bid_price", "bid_size", "ask_price",
        "ask_size", "seq")


def valid_quotes(q: DataFrame) -> DataFrame:
    """all of bid/ask price and size > 0 (NULL fails)."""
    cond = (F.col("bid_price") > 0) & (F.col("bid_size") > 0) & (F.col("ask_price") > 0) & (F.col("ask_size") > 0)
    return q.filter(cond)


def quote_measures(q: DataFrame) -> DataFrame:
    """absolute spread, midpoint, relative spread in bps, log bid/ask, log midpoint."""
    ask, bid = F.col("ask_price"), F.col("bid_price")
    return q.withColumns({
        "abs_spread": ask - bid,
        "mid": (ask + bid) / 2,
    }).withColumns({
        "rel_spread": F.try_divide(F.col("abs_spread"), F.col("mid")) * 10000,
        "log_mid": (F.log(bid) + F.log(ask)) / 2,
    })


def trade_measures(t: DataFrame) -> DataFrame:
    """traded value and gross return ``price / previous price`` (needs ``prev_price``)."""
    return t.withColumns({
        "value": F.col("price") * F.col("volume"),
        "gross_return": F.try_divide(F.col("price"), F.col("prev_price")),
    })


def exclude_tickers(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """drop the excluded tickers (a short literal list)."""
    return df.filter(~F.col("ticker").isin(*excluded)) if excluded else df
