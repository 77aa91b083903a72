"""Row numbers of files that are read in pieces."""

import bz2
import gzip
import os

import pytest
from pyspark.sql import functions as F
from test_sources import write_tick_files

from conftest import SF01
from ticklens.operators import daily
from ticklens.sources import fixtures as fx
from ticklens.sources import ticks_csv

FOLDERS = [("DAX Xetra", ""), ("CAC Paris", ""), ("DAX MTF", ".BS_")]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The same ticks as gzip, bzip2 and plain files; plain files are large enough for many blocks."""
    root = tmp_path_factory.mktemp("split")
    ticks = fx.load_ticks(spark, SF01).where("date < date'2024-01-20'").collect()
    write_tick_files([t for t in ticks if t.ticker.split(".")[1] in ("DE", "PA", "BS")], str(root / "gz"))
    for kind, pack in (("bz2", bz2.compress), ("plain", bytes)):
        for folder, _, files in os.walk(root / "gz"):
            for name in files:
                to = folder.replace(f"{os.sep}gz", f"{os.sep}{kind}", 1)
                os.makedirs(to, exist_ok=True)
                with gzip.open(os.path.join(folder, name)) as src, \
                        open(os.path.join(to, name.replace(".gz", ".bz2" if kind == "bz2" else "").rstrip(".")), "wb") as dst:
                    dst.write(pack(src.read()))
    return str(root)


@pytest.fixture()
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def read(spark, root, kind):
    return ticks_csv.read_venues(spark, [(os.path.join(root, kind, f), flt) for f, flt in FOLDERS])


def daily_rows(t):
    return sorted(map(str, daily.daily_trades(t).select("ticker", "date", "Open", "Close", "N", "X").collect())), \
        sorted(map(str, daily.daily_quotes(t).select("ticker", "date", "N", "ask_size").collect()))


def test_split_files_give_the_rows_of_whole_files(spark, copies, small_blocks):
    whole = read(spark, copies, "gz")
    blocks = ticks_csv.read_raw(spark, os.path.join(copies, "plain", "DAX Xetra")).select("_file", "_block").distinct().count()
    assert blocks > 8
    keys = ["ticker", "date", "time_us", "type", "bid_price", "price", "seq"]
    want = sorted(map(str, whole.select(*keys).collect()))
    for kind in ("plain", "bz2"):
        assert sorted(map(str, read(spark, copies, kind).select(*keys).collect())) == want
    assert daily_rows(read(spark, copies, "plain")) == daily_rows(whole)


def test_numbers_are_dense_and_unique_over_folders(spark, copies, small_blocks):
    t = read(spark, copies, "plain")
    n = t.count()
    got = t.agg(F.count_distinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    assert (got["d"], got["lo"], got["hi"]) == (n, 0, n - 1)
    # along a file the rows stand as they were written: the fixture's ids grow with time within a ticker
    late = t.selectExpr("ticker", "date", "time_us", "seq").toPandas().sort_values("seq")
    for _, rows in late.groupby("ticker"):
        assert list(zip(rows.date, rows.time_us)) == sorted(zip(rows.date, rows.time_us))
