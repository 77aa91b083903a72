"""Stage tables: rows read back in the partitioning of the steps that follow."""

import os
import re

from conftest import SF01
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklens.operators import daily
from ticklens.operators.sequence import SLICE_COL
from ticklens.operators.stage import partitions, staged
from ticklens.session import checkpoint_dir
from ticklens.sources import fixtures as fx

KEYS = ["ticker", "date", SLICE_COL]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_rows_of_a_key_lie_in_one_file_and_need_no_exchange(spark):
    rows = daily.quote_rows(fx.load_ticks(spark, SF01), slice_rows=64)
    v = staged(rows, KEYS, "test")
    files = [f for f in v.inputFiles()]
    assert 1 <= len(files) <= partitions(v)
    where = v.select(*KEYS, F.input_file_name().alias("f")).groupBy(*KEYS).agg(F.count_distinct("f").alias("n"))
    assert where.where("n > 1").isEmpty()
    w = Window.partitionBy(*KEYS).orderBy("seq")
    assert "Exchange" not in plan(v.select(*KEYS, F.lead("time_us").over(w).alias("t")))
    assert "Exchange" not in plan(v.groupBy(*KEYS).agg(F.max("seq")))
    assert not spark.catalog.listTables(pattern="ticklens_test_*")       # no entry stays in the catalogue
    assert sorted(v.select("ticker", "seq", "mid").collect()) == sorted(rows.select("ticker", "seq", "mid").collect())


def test_daily_quotes_shuffle_summaries_and_grid_points_only(spark):
    text = plan(daily.daily_quotes(fx.load_ticks(spark, SF01)))
    assert "ticklens_quotes_" in text and "Scan ExistingRDD" not in text
    # every exchange is by day (sums, summaries, grid points); none is by the slices that hold the quotes
    for line in re.findall(r"Exchange hashpartitioning\(([^\n]*)", text):
        assert SLICE_COL not in line


def test_stage_files_lie_in_the_shared_folder(spark):
    v = staged(spark.range(100).withColumn("k", F.col("id") % 7), ["k"], "test")
    shared = re.sub("^file:/*", "/", checkpoint_dir(spark))
    assert all(os.path.commonpath([re.sub("^file:/*", "/", f), shared]) == shared.rstrip("/") for f in v.inputFiles())
    assert v.count() == 100


def test_empty_stage(spark):
    assert staged(spark.range(0).withColumn("k", F.col("id")), ["k"], "test").count() == 0


def test_trading_hours_are_pushed_to_the_scan(spark, tmp_dir):
    from ticklens.operators import clean
    from ticklens.sources import ticks_csv
    ticks = fx.load_ticks(spark, SF01)
    odd = ticks.limit(20).withColumn("gmt_offset", F.lit(None).cast("int"))       # no local time: outside any hours
    ticks = ticks.unionByName(odd.withColumn("seq", F.col("seq") + 10_000_000))
    path = os.path.join(tmp_dir, "ticks")
    ticks_csv.write_ticks_parquet(clean.with_local_time(ticks), path)
    stored = ticks_csv.read_ticks_parquet(spark, path)
    assert stored.columns == [*ticks.columns, clean.LOCAL_COLUMN]
    for kind in (clean.trades, clean.quotes):
        rows = kind(clean.clean(stored, "10:00:00.000", "11:30:00.000"))
        pushed = re.search(r"PushedFilters: \[(.*?)\]", rows._jdf.queryExecution().explainString(
            rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))).group(1)
        assert f"GreaterThanOrEqual(local_us,{36_000_000_000})" in pushed and f"LessThanOrEqual(local_us,{41_400_000_000})" in pushed
        plain = kind(clean.clean(ticks, "10:00:00.000", "11:30:00.000"))
        assert rows.count() == plain.count() > 0 and rows.exceptAll(plain).isEmpty()
