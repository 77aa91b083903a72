"""Daily aggregates per (ticker, date): trades (A1-A4) and quotes.

Plan shape: ticks -> F1/F2 filter (pushed to the scan where stored as Parquet) -> one hash
shuffle on (ticker, date, slice) -> slice windows + small boundary summaries -> partial
aggregate -> shuffle of one partial row per (ticker, date) and map task -> final aggregate.
The quotes' later passes read a stage table bucketed by the same keys: no tick is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DAILY_QUOTES_COLUMNS, DAILY_TRADES_COLUMNS, GRID_STEP_SECONDS
from . import clean
from .sequence import DEFAULT_SLICE_ROWS, SLICE_COL, partition_by_slice, sequence_pass, with_slice
from .series import log_midpoint_series, realised_volatility
from .stage import partitions, staged

DAY = ["ticker", "date"]
QUOTE_FIELDS = ["bid_price", "bid_size", "ask_price", "ask_size"]


def _ms_to_next(next_col: str = "next_time_us") -> F.Column:
    """Whole milliseconds to the next tick of the day (NULL for the last one)."""
    return F.floor((F.col(next_col) - F.col("time_us")) / 1000).cast("double")


def trade_rows(ticks: DataFrame, slice_rows: int = DEFAULT_SLICE_ROWS, day: Sequence[str] = DAY) -> DataFrame:
    """Cleaned trades with T1 (previous price, next time), T2 and F12 per row."""
    t = clean.trades(clean.clean(ticks))
    t = t if "marketplace" in day else t.drop("marketplace")
    t = partition_by_slice(with_slice(t, slice_rows=slice_rows), day)
    t = sequence_pass(t, day, next_cols=["time_us"], prev_cols=["price"])
    return clean.trade_measures(t.withColumn("dt_ms", _ms_to_next()))


def daily_trades(ticks: DataFrame, slice_rows: int = DEFAULT_SLICE_ROWS, by_marketplace: bool = False) -> DataFrame:
    """A1-A4: V, sigma_r, sigma_p, time-weighted P, N, X, Open, Close, High, Low per day.

    ``by_marketplace`` keeps the marketplace as a group key, so a ticker that two folders
    deliver has a row, and an order of ticks, for each.
    """
    day = ["marketplace", *DAY] if by_marketplace else DAY
    t = trade_rows(ticks, slice_rows, day)
    out = t.groupBy(*day).agg(
        F.sum("value").alias("V"),
        F.stddev_samp("gross_return").alias("sigma_r"),
        F.stddev_samp("price").alias("sigma_p"),
        F.try_divide(F.sum(F.col("dt_ms") * F.col("price")), F.sum("dt_ms")).alias("P"),
        F.count(F.lit(1)).alias("N"),
        F.sum("volume").alias("X"),
        F.min_by("price", "seq").alias("Open"),
        F.max_by("price", "seq").alias("Close"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
    )
    return out.select(*day[:-2], *DAILY_TRADES_COLUMNS)


def last_quotes(ticks: DataFrame, day: Sequence[str] = DAY) -> DataFrame:
    """The last known value of each quote field per ticker (and marketplace, if ``day`` has it): what
    T3 would carry into the next day."""
    q = clean.quotes(clean.clean(ticks))
    order = F.struct("date", "seq")
    return q.groupBy(*day[:-1]).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in QUOTE_FIELDS))


def quote_rows(ticks: DataFrame, fill_scope: str = "ticker", slice_rows: int = DEFAULT_SLICE_ROWS,
               day: Sequence[str] = DAY, known: DataFrame | None = None) -> DataFrame:
    """Valid quotes with T2 (ms to next quote, taken before F6), T3 fill, F6 and F11.

    ``fill_scope="ticker"`` carries the last known bid/ask across days of a ticker;
    ``"day"`` restarts the fill every day. ``known`` (see ``last_quotes``) gives what was known
    before the first of these ticks; only the scope "ticker" takes it.
    """
    q = clean.quotes(clean.clean(ticks))
    q = q if "marketplace" in day else q.drop("marketplace")
    q = q.select(*day, "seq", "time_us", *QUOTE_FIELDS)
    q = partition_by_slice(with_slice(q, slice_rows=slice_rows), day, partitions(q))
    fill_group, segments = (list(day[:-1]), ["date"]) if fill_scope == "ticker" else (list(day), [])
    q = sequence_pass(q, day, next_cols=["time_us"], fill_cols=QUOTE_FIELDS, fill_group=fill_group, fill_segments=segments)
    if known is not None and fill_scope == "ticker":
        # one row per ticker, broadcast only if the planner finds it small enough
        before = known.select(*fill_group, *(F.col(c).alias(f"_known_{c}") for c in QUOTE_FIELDS))
        q = q.join(before, fill_group, "left").withColumns(
            {c: F.coalesce(c, f"_known_{c}") for c in QUOTE_FIELDS}).drop(*(f"_known_{c}" for c in QUOTE_FIELDS))
    return clean.quote_measures(clean.valid_quotes(q.withColumn("dt_ms", _ms_to_next())))


def daily_quotes(ticks: DataFrame, fill_scope: str = "ticker", step_seconds: int = GRID_STEP_SECONDS,
                 slice_rows: int = DEFAULT_SLICE_ROWS, cut_lineage: bool = True,
                 by_marketplace: bool = False, known: DataFrame | None = None) -> DataFrame:
    """N, sigma_s, sigma_m, sigma_m_log and time-weighted bid/ask/rel. spread per day.

    With ``cut_lineage`` the valid quote rows become a stage table bucketed by (ticker, date,
    slice): the aggregate, the deduplication and the interpolation passes read the columns they
    need from it, without another shuffle of ticks, instead of re-running the tick windows.
    """
    day = ["marketplace", *DAY] if by_marketplace else DAY
    v = quote_rows(ticks, fill_scope, slice_rows, day, known)
    if cut_lineage:
        v = staged(v, [*day, SLICE_COL], "quotes", ["seq"])
    dt = F.col("dt_ms")

    def tw(c):
        return F.try_divide(F.sum(dt * F.col(c)), F.sum(dt))

    agg = v.groupBy(*day).agg(
        F.count(F.lit(1)).alias("N"),
        F.stddev_samp("abs_spread").alias("sigma_s"),
        F.stddev_samp("mid").alias("sigma_m"),
        tw("bid_price").alias("bid_price"),
        tw("bid_size").alias("bid_size"),
        tw("ask_price").alias("ask_price"),
        tw("ask_size").alias("ask_size"),
        tw("rel_spread").alias("rel_spread"),
    )
    vol = realised_volatility(log_midpoint_series(v, step_seconds, day), day=day)
    return agg.join(vol, list(day), "left").select(*day[:-2], *DAILY_QUOTES_COLUMNS)


def sampled_series(ticks: DataFrame, fill_scope: str = "ticker", step_seconds: int = GRID_STEP_SECONDS,
                   slice_rows: int = DEFAULT_SLICE_ROWS, cut_lineage: bool = True) -> DataFrame:
    """The sampled log-midpoint series of every ticker-day as a table."""
    v = quote_rows(ticks, fill_scope, slice_rows)
    if cut_lineage:
        v = staged(v.select(*DAY, SLICE_COL, "seq", "time_us", "log_mid"), [*DAY, SLICE_COL], "midpoints", ["seq"])
    return log_midpoint_series(v, step_seconds)
