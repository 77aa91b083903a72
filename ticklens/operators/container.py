"""The container: daily trades joined with daily quotes and enriched (J1-J4, F5, F7, F8,
F13-F16, A11, A14).

The container has one row per ticker and day, so it is small next to the ticks; scalars over
it (W*, the market-cap median) are uncorrelated scalar subqueries, evaluated once and inlined
as literals - no join, no collect. Dimension tables (index lists, market caps) are bounded by
the number of listed stocks; their joins are left to the planner, which broadcasts them only
under ``spark.sql.autoBroadcastJoinThreshold`` (checked on runtime statistics under AQE).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CAC_PERIOD2_START, DAX_PERIOD1_END, EXCLUDED_TICKERS, MODELS, PARIS_ALIASES
from ..session import checkpoint_dir
from .clean import exclude_tickers

DAY = ["ticker", "date"]


def join_daily(trades: DataFrame, quotes: DataFrame, marketplace: str | None = None) -> DataFrame:
    """Inner join of daily trades and quotes per day; N -> n_trades / n_quotes.

    Tables that carry their marketplace are joined on it too; ``marketplace`` takes one of them.
    """
    keys = [c for c in ("marketplace", *DAY) if c in trades.columns and c in quotes.columns]
    if marketplace is not None:
        trades = trades.where(F.col("marketplace") == marketplace)
    return trades.withColumnRenamed("N", "n_trades").join(
        quotes.withColumnRenamed("N", "n_quotes"), keys, "inner")


def with_activity(c: DataFrame) -> DataFrame:
    """trading activity W = sigma_m_log * V and W* = mean(W) over the whole input."""
    c = c.withColumn("W", F.col("sigma_m_log") * F.col("V"))
    w_star = c.agg(F.avg("W")).scalar()
    return c.withColumn("W_star", w_star)


def with_dimensions(c: DataFrame) -> DataFrame:
    """stock, upper-case stock, venue (AS/BR -> PA) and market from the ticker."""
    parts = F.split(F.col("ticker"), r"\.")
    raw_venue = F.element_at(parts, 2)
    venue = F.when(raw_venue.isin(*PARIS_ALIASES), F.lit("PA")).otherwise(raw_venue)
    return c.withColumns({
        "stock": F.element_at(parts, 1),
        "stock_upper": F.upper(F.element_at(parts, 1)),
        "venue": venue,
    }).withColumn("market", F.when(F.col("venue").isin("DE", "PA"), "Primary").otherwise("MTF"))


def with_index(c: DataFrame, members: DataFrame) -> DataFrame:
    """Index DAX if stock or its upper case is in the DAX list, else CAC likewise, else NULL."""
    m = members.groupBy("stock").agg(
        F.max(F.col("index") == "DAX").alias("in_dax"), F.max(F.col("index") == "CAC").alias("in_cac"))
    m1 = m.select(F.col("stock").alias("_m1"), F.col("in_dax").alias("_d1"), F.col("in_cac").alias("_c1"))
    m2 = m.select(F.col("stock").alias("_m2"), F.col("in_dax").alias("_d2"), F.col("in_cac").alias("_c2"))
    out = c.join(m1, F.col("stock") == F.col("_m1"), "left")
    out = out.join(m2, F.col("stock_upper") == F.col("_m2"), "left")
    dax = F.coalesce(F.col("_d1"), F.lit(False)) | F.coalesce(F.col("_d2"), F.lit(False))
    cac = F.coalesce(F.col("_c1"), F.lit(False)) | F.coalesce(F.col("_c2"), F.lit(False))
    return out.withColumn("index", F.when(dax, "DAX").when(cac, "CAC")) \
        .drop("_m1", "_d1", "_c1", "_m2", "_d2", "_c2")


def market_cap_long(caps: DataFrame) -> DataFrame:
    """A14 + X2: large_cap = cap > median(cap); unpivot the four ticker columns for lookup.

    An unknown capitalisation stays unknown. Returns (lookup, lookup_ticker, ticker_rm, large_cap) with the first matching row kept.
    """
    median = caps.agg(F.median("market_capitalization")).scalar()
    c = caps.withColumn("large_cap", (F.col("market_capitalization") > median).cast("int"))
    if "row_no" not in c.columns:
        c = c.withColumn("row_no", F.monotonically_increasing_id())
    long = c.select("ticker_rm", "large_cap", "row_no", F.expr(
        "stack(4, 'rm', ticker_rm, 'bs', ticker_bs, 'chi', ticker_chi, 'tq', ticker_tq) "
        "AS (lookup, lookup_ticker)"))
    first = long.groupBy("lookup", "lookup_ticker").agg(
        F.min_by(F.struct("ticker_rm", "large_cap"), F.col("row_no")).alias("_hit"))
    return first.select("lookup", "lookup_ticker", F.col("_hit.ticker_rm").alias("ticker_rm"),
                        F.col("_hit.large_cap").alias("large_cap"))


def with_market_cap(c: DataFrame, caps: DataFrame) -> DataFrame:
    """large_cap and primary ticker by the venue's lookup column (first match, else NULL)."""
    lookup = F.when(F.col("market") == "Primary", "rm").when(F.col("venue") == "BS", "bs") \
        .when(F.col("venue") == "CHI", "chi").otherwise("tq")
    lk = market_cap_long(caps).withColumnsRenamed({"lookup": "_lk", "lookup_ticker": "_lk_ticker"})
    out = c.withColumn("_lookup", lookup)
    out = out.join(lk, (F.col("_lookup") == F.col("_lk")) & (F.col("ticker") == F.col("_lk_ticker")), "left")
    return out.drop("_lookup", "_lk", "_lk_ticker")


def with_period(c: DataFrame, cac_period2_start=CAC_PERIOD2_START, dax_period1_end=DAX_PERIOD1_END) -> DataFrame:
    """F8: period 1 / 2 by an index-specific boundary; NULL without an index."""
    cac = F.lit(_dt.date.fromisoformat(str(cac_period2_start)))
    dax = F.lit(_dt.date.fromisoformat(str(dax_period1_end)))
    idx, d = F.col("index"), F.col("date")
    p1 = ((idx == "CAC") & (d < cac)) | ((idx == "DAX") & (d <= dax))
    p2 = ((idx == "CAC") & (d >= cac)) | ((idx == "DAX") & (d > dax))
    return c.withColumn("period", F.when(p1, 1).when(p2, 2))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the session's checkpoint folder and read it back.

    ``spark.checkpoint.dir`` names a shared, durable folder on a cluster; a local session
    gets one when it is unset. Used where several outputs read the same intermediate rows.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def build_container(daily: DataFrame, members: DataFrame, caps: DataFrame,
                    excluded: Sequence[str] = tuple(EXCLUDED_TICKERS),
                    cac_period2_start=CAC_PERIOD2_START, dax_period1_end=DAX_PERIOD1_END,
                    drop_crossed: bool = True, cut_lineage: bool = True) -> DataFrame:
    """F5, F7, F13, F14, J2, A14, J3, J4, F8 over a joined daily table (see ``join_daily``).

    With ``cut_lineage`` the filtered daily table is materialised first (one row per
    ticker-day), so the W* scalar and every later output read it instead of recomputing.
    """
    c = exclude_tickers(daily, list(excluded))
    if drop_crossed:
        c = c.filter(F.col("bid_price") < F.col("ask_price"))      # F7
    if cut_lineage:
        c = materialize(c)
    c = with_activity(c)
    c = with_dimensions(c)
    c = with_index(c, members)
    c = with_market_cap(c, caps)
    return with_period(c, cac_period2_start, dax_period1_end)


def _ln(c) -> F.Column:
    """Natural log with NULL for non-positive input (R gives -Inf/NaN, which lm rejects)."""
    return F.when(c > 0, F.log(c))


def model_responses() -> list[tuple[str, F.Column]]:
    """the six dependent variables, in model order."""
    return [
        ("trade_freq", _ln(F.col("n_trades").cast("double"))),
        ("quote_freq", _ln(F.col("n_quotes").cast("double"))),
        ("trade_vol", _ln(F.try_divide(F.col("X"), F.try_divide(F.col("V"), F.col("P"))))),
        ("quote_vol", _ln(F.col("bid_size") + F.col("ask_size"))),
        ("abs_spread", _ln(F.col("ask_price") - F.col("bid_price"))),
        ("rel_spread", _ln(F.col("rel_spread"))),
    ]


def model_long(c: DataFrame, keys: Sequence[str], relative: bool = True) -> DataFrame:
    """F15 wide -> long: one row per (observation, model) with x = ln(W/W*) or ln(W), y.

    Every observation appears under every model (NULL y included) so a model's group always
    exists; the fit moments skip incomplete rows as lm does.
    """
    x = _ln(F.try_divide(F.col("W"), F.col("W_star"))) if relative else _ln(F.col("W"))
    resp = F.array(*[F.struct(F.lit(m).alias("model"), y.alias("y")) for m, y in model_responses()])
    assert [m for m, _ in model_responses()] == MODELS
    return c.select(*keys, x.alias("x"), F.explode(resp).alias("_r")) \
        .select(*keys, "_r.model", "x", "_r.y")


def means_over_time(daily: DataFrame, excluded: Sequence[str] = tuple(EXCLUDED_TICKERS)) -> DataFrame:
    """Per-date cross-sectional means (after F5, without F7)."""
    c = exclude_tickers(daily, list(excluded)).withColumn("W", F.col("sigma_m_log") * F.col("V"))
    return c.groupBy("date").agg(
        F.avg("n_trades").alias("mean_n_trades"),
        F.avg("n_quotes").alias("mean_n_quotes"),
        F.avg("W").alias("mean_w"),
        F.avg(_ln(F.col("W"))).alias("mean_ln_w"),
        F.avg(F.try_divide(F.col("X"), F.col("V"))).alias("mean_x_over_v"),
        F.avg(F.col("ask_size") + F.col("bid_size")).alias("mean_depth"),
        F.avg(F.col("ask_price") - F.col("bid_price")).alias("mean_abs_spread"),
        F.avg("rel_spread").alias("mean_rel_spread"),
    )


def plot_variables(c: DataFrame, ticker: str | None = None) -> DataFrame:
    """F16: plot variables per ticker-day: midpoint, ln(W)/W* (as in the source, not ln(W/W*)),
    ln N; W* is the mean W of that ticker. ``ticker`` restricts to one instrument."""
    s = c.filter(F.col("ticker") == ticker) if ticker else c
    s = s.withColumn("W", F.col("sigma_m_log") * F.col("V"))
    w_star = s.groupBy("ticker").agg(F.avg("W").alias("_w_star"))
    return s.join(w_star, "ticker").select(
        "ticker", "date", "W", F.col("n_trades").alias("N"),
        ((F.col("ask_price") + F.col("bid_price")) / 2).alias("midpoint"),
        F.try_divide(_ln(F.col("W")), F.col("_w_star")).alias("log_w_over_w_star_plot"),
        _ln(F.col("n_trades").cast("double")).alias("log_n"))
