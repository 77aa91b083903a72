"""End-to-end jobs: daily aggregation (E1), regressions (E2), comparisons.

Each stage writes its result as a table under ``out_dir`` (a shared folder on a cluster) and
the next stage reads that table: lineage is cut at every stage boundary, a lost executor
recomputes at most one stage, and the small tables (container, coefficients) are read by
many outputs without recomputing the ticks.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, compare, container, daily, intervals, mixed, mixed_slope, models
from ..schema import (CAC_PERIOD2_START, DAX_PERIOD1_END, DISTRIBUTION_SECONDS, EXCLUDED_TICKERS,
                      GRID_STEP_SECONDS)
from ..sources import aggregates_io as io
from ..sources import batches
from ..sources import day_index as di
from ..sources import ticks_csv


def _p(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)


def stage_ticks(spark: SparkSession, venues: Iterable[tuple[str, str]], out_dir: str,
                excluded: Sequence[str] = tuple(EXCLUDED_TICKERS)) -> DataFrame:
    """Raw gzip CSV of all venues -> typed Parquet partitioned by date (read back), and the counts
    of rows that no day can take (no date, time or offset) as the table ``rejects``. The local time (F1)
    is stored with the rows."""
    rows = clean.fill_offsets(ticks_csv.read_venues(spark, venues, excluded))
    ticks_csv.write_ticks_parquet(clean.with_local_time(rows), _p(out_dir, "ticks"))
    ticks = ticks_csv.read_ticks_parquet(spark, _p(out_dir, "ticks"))
    io.write_result(clean.rejects(ticks), _p(out_dir, "rejects"), "parquet")
    di.save_file_index(di.file_index(spark, _p(out_dir, "ticks")), _p(out_dir, "tick_files"))
    return ticks


def daily_aggregation_job(spark: SparkSession, ticks: DataFrame, out_dir: str, fmt: str = "parquet",
                          fill_scope: str = "ticker", step_seconds: int = GRID_STEP_SECONDS,
                          distribution_seconds: int | None = DISTRIBUTION_SECONDS) -> None:
    """Daily trades and quotes per marketplace (S7), the day index (S4/S5) and the
    trades-per-interval distribution (A10) of every ticker."""
    io.save_daily(daily.daily_trades(ticks, by_marketplace=True), _p(out_dir, "trades"), fmt)
    io.save_daily(daily.daily_quotes(ticks, fill_scope, step_seconds, by_marketplace=True),
                  _p(out_dir, "quotes"), fmt)
    di.save_index(di.day_index(ticks), _p(out_dir, "day_index"))
    if distribution_seconds:
        tr = clean.trades(clean.clean(ticks))
        # counted once per marketplace and ticker; the sums per ticker and per marketplace follow
        io.write_result(intervals.distribution(tr, distribution_seconds, ("marketplace", "ticker")),
                        _p(out_dir, "distribution_detail"), "parquet")
        detail = spark.read.parquet(_p(out_dir, "distribution_detail"))
        for key, name in (("ticker", "distribution"), ("marketplace", "distribution_marketplace")):
            total = detail.groupBy(key, "category").agg(F.sum("frequency").alias("frequency"))
            io.write_result(total.orderBy(key, "category"), _p(out_dir, name), "parquet")


CONTINUED_TABLES = ["trades", "quotes", "day_index", "state"]
STATE_KEYS = ["marketplace", "ticker"]


def next_state(ticks: DataFrame, before: DataFrame | None) -> DataFrame:
    """What the next run has to know per marketplace and ticker: the last known quote fields
    (``daily.last_quotes``) and the number of rows so far, the earlier state where these ticks say nothing."""
    rows = ticks.groupBy(*STATE_KEYS).agg(F.count(F.lit(1)).alias("rows"))
    now = rows.join(daily.last_quotes(ticks, ["marketplace", *daily.DAY]), STATE_KEYS, "left")
    if before is None:
        return now
    old = before.select(*STATE_KEYS, *(F.col(c).alias(f"_old_{c}") for c in ("rows", *daily.QUOTE_FIELDS)))
    both = now.join(old, STATE_KEYS, "full")
    return both.select(*STATE_KEYS, (F.coalesce("rows", F.lit(0)) + F.coalesce("_old_rows", F.lit(0))).alias("rows"),
                       *(F.coalesce(c, f"_old_{c}").alias(c) for c in daily.QUOTE_FIELDS))


def continued_aggregation_job(spark: SparkSession, ticks: DataFrame, out_dir: str,
                              step_seconds: int = GRID_STEP_SECONDS) -> bool:
    """Daily trades, quotes and day index of the days after the last stored one; False if there are none.

    The days are computed as if the stored ones came in the same run: quotes are filled from the
    last known values of earlier days and row numbers go on, both from the state table that the last
    run left. The result is that of one run, bit for bit where a ticker-day fits one slice (more slices'
    sums may be added in another order). Tables and the new state are one batch (``sources.batches``): all of it counts or none.
    """
    stored = batches.manifest(spark, out_dir)
    fresh = ticks if not stored else ticks.where(F.col("date") > F.lit(stored[-1]["last_date"]))
    span = fresh.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if span["lo"] is None:
        return False
    state = batches.read_table(spark, out_dir, "state", last_only=True)
    batch = batches.begin(out_dir)
    batch.write(daily.daily_trades(fresh, by_marketplace=True), "trades", "marketplace")
    batch.write(daily.daily_quotes(fresh, "ticker", step_seconds, by_marketplace=True, known=state), "quotes", "marketplace")
    index = di.day_index(fresh, STATE_KEYS)
    if state is not None:
        index = index.join(state.select(*STATE_KEYS, F.col("rows").alias("_rows")), STATE_KEYS, "left").withColumn(
            "first_row", F.col("first_row") + F.coalesce("_rows", F.lit(0))).drop("_rows")
    batch.write(index, "day_index")
    batch.write(next_state(fresh, state), "state")
    batches.publish(spark, batch, span["lo"], span["hi"], CONTINUED_TABLES)
    return True


def regression_job(spark: SparkSession, out_dir: str, members: DataFrame, caps: DataFrame,
                   excluded: Sequence[str] = tuple(EXCLUDED_TICKERS), cac_period2_start=CAC_PERIOD2_START,
                   dax_period1_end=DAX_PERIOD1_END, fmt: str = "parquet") -> DataFrame:
    """Container (J1-J4, F5-F8, F13-F14) -> coefficients (M1, M2, per period) -> summaries."""
    trades = io.read_daily(spark, _p(out_dir, "trades"), fmt)
    quotes = io.read_daily(spark, _p(out_dir, "quotes"), fmt)
    c = container.build_container(container.join_daily(trades, quotes), members, caps, excluded,
                                  cac_period2_start, dax_period1_end)
    io.write_result(c, _p(out_dir, "container"), "parquet")
    c = spark.read.parquet(_p(out_dir, "container"))
    io.write_result(models.pooled(c), _p(out_dir, "coefficient_pooled"), "parquet")
    io.write_result(models.per_ticker(c), _p(out_dir, "coefficient"), "parquet")
    io.write_result(models.per_ticker(c, by_period=True), _p(out_dir, "coefficient_period"), "parquet")
    coef = spark.read.parquet(_p(out_dir, "coefficient"))
    io.write_result(compare.slope_summary(coef).orderBy("index", "venue", "model"), _p(out_dir, "summary"), "csv")
    daily_all = container.join_daily(trades, quotes)
    io.write_result(container.means_over_time(daily_all, excluded), _p(out_dir, "means_over_time"), "parquet")
    return c


def comparison_job(spark: SparkSession, out_dir: str) -> None:
    """Z-tests between stocks, venues and periods; panel estimators and their z-tests."""
    coef = spark.read.parquet(_p(out_dir, "coefficient"))
    coef_p = spark.read.parquet(_p(out_dir, "coefficient_period"))
    c = spark.read.parquet(_p(out_dir, "container"))
    io.write_result(compare.z_between_stocks(coef), _p(out_dir, "z_stocks"), "csv")
    io.write_result(compare.z_between_venues(coef), _p(out_dir, "z_venues"), "csv")
    io.write_result(compare.z_between_periods(coef_p), _p(out_dir, "z_periods"), "csv")
    panel = models.panel_within(c).orderBy("index", "venue", "model")
    io.write_result(panel, _p(out_dir, "coefficient_panel"), "parquet")
    for name, fit in (("pooling", models.panel_pooling), ("between", models.panel_between),
                      ("random", models.panel_random)):
        io.write_result(fit(c).orderBy("index", "venue", "model"), _p(out_dir, f"coefficient_panel_{name}"), "parquet")
    io.write_result(mixed.panel_random_intercept(c).orderBy("index", "venue", "model"),
                    _p(out_dir, "mixed_random_intercept"), "parquet")
    io.write_result(mixed_slope.panel_random_slope(c).orderBy("index", "venue", "term"),
                    _p(out_dir, "mixed_random_slope"), "parquet")
    t_tests = models.two_sample_t(c, "sigma_m_log").unionByName(models.two_sample_t(c, "V"))
    io.write_result(t_tests, _p(out_dir, "t_test_large_cap"), "csv")
    io.write_result(models.panel_within(c, by_period=True), _p(out_dir, "coefficient_panel_period"), "parquet")
    panel = spark.read.parquet(_p(out_dir, "coefficient_panel"))
    panel_p = spark.read.parquet(_p(out_dir, "coefficient_panel_period"))
    io.write_result(compare.z_panel_between_venues(panel), _p(out_dir, "z_panel_venues"), "csv")
    io.write_result(compare.z_panel_between_periods(panel_p), _p(out_dir, "z_panel_periods"), "csv")
