"""Runs that continue from a stored one, batches that count whole or not at all, reading by the file index."""

import datetime as dt

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from ticklens.plans import jobs
from ticklens.sources import batches, ticks_csv
from ticklens.sources import day_index as di
from ticklens.sources import fixtures as fx

TABLES = ("trades", "quotes", "day_index", "state")


@pytest.fixture(scope="module")
def ticks(spark):
    """Five days of two tickers, the first quotes of most days without a bid."""
    t = fx.load_ticks(spark, SF01).where("date < date'2024-01-06' and ticker in ('ADSGn.DE', 'TOTF.PA')")
    return t.withColumn("bid_price", F.when((F.col("seq") % 3 > 0) | (F.col("date") == F.lit(dt.date(2024, 1, 1))), F.col("bid_price")))


def rows(spark, out, table):
    df = batches.read_table(spark, out, table, last_only=table == "state")
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_daily_runs_equal_one_run(spark, ticks, tmp_dir):
    once, each = f"{tmp_dir}/once", f"{tmp_dir}/each"
    assert jobs.continued_aggregation_job(spark, ticks, once)
    days = [r[0] for r in ticks.select("date").distinct().orderBy("date").collect()]
    assert len(days) == 5
    for last in (days[0], days[2], days[4]):          # a run of one day and two of two days
        assert jobs.continued_aggregation_job(spark, ticks.where(F.col("date") <= F.lit(last)), each)
    assert not jobs.continued_aggregation_job(spark, ticks, each)        # nothing new
    assert [r["number"] for r in batches.manifest(spark, each)] == [1, 2, 3]
    for table in TABLES:
        assert rows(spark, each, table) == rows(spark, once, table)      # bit for bit
    # the carried values matter: without them some days lose their first quotes
    alone = f"{tmp_dir}/alone"
    for day in days:
        jobs.continued_aggregation_job(spark, ticks.where(F.col("date") == F.lit(day)), f"{alone}/{day}")
    lone = sorted((r for day in days for r in rows(spark, f"{alone}/{day}", "quotes")), key=str)
    assert lone != rows(spark, once, "quotes")


def test_a_run_that_fails_before_publishing_changes_no_read(spark, ticks, tmp_dir, monkeypatch):
    day = ticks.where("date = date'2024-01-01'")
    assert batches.read_table(spark, tmp_dir, "trades") is None
    jobs.continued_aggregation_job(spark, day, tmp_dir)
    before = {t: rows(spark, tmp_dir, t) for t in TABLES}

    def killed(*_):
        raise KeyboardInterrupt

    two = ticks.where("date <= date'2024-01-02'")
    with monkeypatch.context() as m:
        m.setattr(batches, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            jobs.continued_aggregation_job(spark, two, tmp_dir)
    assert {t: rows(spark, tmp_dir, t) for t in TABLES} == before
    assert jobs.continued_aggregation_job(spark, two, tmp_dir)             # the repeated run is whole
    assert len(rows(spark, tmp_dir, "trades")) > len(before["trades"])
    assert len(batches.manifest(spark, tmp_dir)) == 2


def test_a_day_range_opens_its_files_only(spark, tmp_dir):
    path = f"{tmp_dir}/ticks"
    ticks_csv.write_ticks_parquet(fx.load_ticks(spark, SF01).where("date < date'2024-01-09'"), path, slice_rows=1 << 10)
    di.save_file_index(di.file_index(spark, path), f"{tmp_dir}/tick_files")
    index = di.load_file_index(spark, f"{tmp_dir}/tick_files")
    whole = spark.read.parquet(path)
    files = len(whole.inputFiles())
    one = di.read_day_range(spark, path, index, "ADSGn.DE", "2024-01-03", "2024-01-04")
    named = index.where("ticker = 'ADSGn.DE' and date = date'2024-01-03'").select("file").distinct().count()
    assert files >= 8 and len(one.inputFiles()) == named == 1
    want = di.day_range(whole, "ADSGn.DE", "2024-01-03", "2024-01-04")
    assert one.count() > 0 and sorted(one.select("seq", "date").collect()) == sorted(want.select("seq", "date").collect())
    assert index.agg(F.sum("n_rows")).first()[0] == whole.count()
    assert di.read_day_range(spark, path, index, "nobody", "2024-01-01").count() == 0
