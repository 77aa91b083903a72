"""End-to-end jobs E1 -> E2 -> E3 from gzip CSV tick files."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from test_sources import VENUES, write_tick_files
from ticklens.operators import container, daily, models
from ticklens.plans import jobs
from ticklens.plans.catalog import rounded
from ticklens.sources import fixtures as fx


def _rows(df):
    return sorted(rounded(df).collect(), key=str)


def test_jobs_end_to_end(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    write_tick_files(fx.load_ticks(spark, SF001).collect(), raw)
    out = os.path.join(tmp_dir, "out")
    ticks = jobs.stage_ticks(spark, [(os.path.join(raw, f), flt) for f, flt in VENUES], out,
                             excluded=fx.FIXTURE_EXCLUDED)
    jobs.daily_aggregation_job(spark, ticks, out)
    c = jobs.regression_job(spark, out, fx.index_members(spark), fx.market_cap(spark),
                            excluded=fx.FIXTURE_EXCLUDED, cac_period2_start=fx.FIXTURE_PERIOD_SPLIT,
                            dax_period1_end=fx.FIXTURE_PERIOD_SPLIT)
    jobs.comparison_job(spark, out)
    for name in ["trades", "quotes", "day_index", "distribution", "container", "coefficient",
                 "coefficient_period", "summary", "z_stocks", "z_venues", "z_periods",
                 "coefficient_panel", "coefficient_panel_pooling", "coefficient_panel_between",
                 "coefficient_panel_random", "mixed_random_intercept", "t_test_large_cap", "rejects",
                 "distribution_marketplace", "z_panel_venues", "z_panel_periods", "means_over_time"]:
        assert os.path.isdir(os.path.join(out, name)), name
    # the staged path gives the same daily trades and coefficients as the direct plan
    direct_ticks = fx.load_ticks(spark, SF001).filter(~F.col("ticker").isin(*fx.FIXTURE_EXCLUDED))
    stored = spark.read.parquet(os.path.join(out, "trades")).drop("marketplace")
    assert _rows(stored.select(*daily.daily_trades(direct_ticks).columns)) == _rows(daily.daily_trades(direct_ticks))
    direct_c = container.build_container(
        container.join_daily(daily.daily_trades(direct_ticks), daily.daily_quotes(direct_ticks)),
        fx.index_members(spark), fx.market_cap(spark), fx.FIXTURE_EXCLUDED,
        fx.FIXTURE_PERIOD_SPLIT, fx.FIXTURE_PERIOD_SPLIT)
    assert c.count() == direct_c.count()
    coef = spark.read.parquet(os.path.join(out, "coefficient"))
    assert _rows(coef) == _rows(models.per_ticker(direct_c))
