"""Trading-day index (S4-S6): where each day starts in a ticker's file, saved and reused.

``file_index`` is the same index for a stored table of ticks: which files hold a ticker's day.
``read_day_range`` takes the files of a day range from it and opens no others.

The index is the exact first row number of every (ticker, date) - the number of the ticker's
rows that come before the day - computed from per-day counts: a group-by to one row per
ticker-day, then a running sum over those few rows per ticker. No window ever spans a
ticker's ticks.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("first_row", T.LongType()),
    T.StructField("n_rows", T.LongType()),
])


def day_index(ticks: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """(keys, date, first_row, n_rows); first_row counts from 0 in file order (seq) of a ``keys`` group."""
    days = ticks.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("_s0"))
    w = Window.partitionBy(*keys).orderBy("_s0").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, "date", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).cast("long").alias("first_row"),
                       "n_rows")


def save_index(index: DataFrame, path: str) -> None:
    """Write the index as JSON lines."""
    index.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved index back with its schema."""
    return spark.read.schema(INDEX_SCHEMA).json(path)


def day_range(ticks: DataFrame, ticker: str, date: str | _dt.date, date_next: str | _dt.date | None = None) -> DataFrame:
    """One ticker's ticks from ``date`` up to (not including) ``date_next``.

    On Parquet partitioned by date this prunes partitions and pushes the ticker filter down.
    """
    d0 = _dt.date.fromisoformat(str(date))
    cond = (F.col("ticker") == ticker) & (F.col("date") >= F.lit(d0))
    if date_next is not None:
        cond &= F.col("date") < F.lit(_dt.date.fromisoformat(str(date_next)))
    return ticks.filter(cond)


FILE_INDEX_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()),
])


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """S4 over the tick table stored at ``path``: (file, ticker, date, n_rows, first_seq, last_seq).

    ``file`` is relative to ``path``. One scan of two columns, combined before the shuffle; the
    result has a row per file and ticker-day in it.
    """
    base = F.lit(path.rstrip("/") + "/")
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), "ticker", "date", "seq")
    inside = F.element_at(F.split(F.col("f"), F.concat(F.lit("\\Q"), base, F.lit("\\E"))), -1)
    found = rows.groupBy("f", "ticker", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return found.select(inside.alias("file"), "ticker", "date", "n_rows", "first_seq", "last_seq")


def save_file_index(index: DataFrame, path: str) -> None:
    """The file index as Parquet, sorted by ticker and date so that a lookup reads few row groups."""
    index.sort("ticker", "date").write.mode("overwrite").parquet(path)


def load_file_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved file index."""
    return spark.read.schema(FILE_INDEX_SCHEMA).parquet(path)


def read_day_range(spark: SparkSession, path: str, index: DataFrame, ticker: str, date: str | _dt.date,
                   date_next: str | _dt.date | None = None) -> DataFrame:
    """One ticker's ticks from ``date`` up to (not including) ``date_next``, from its files only.

    The index names the files; what reaches the driver is their names, those of one ticker's days.
    """
    files = sorted(r["file"] for r in day_range(index, ticker, date, date_next).select("file").distinct().collect())
    columns = spark.read.parquet(path).schema
    if not files:
        return spark.createDataFrame([], columns)
    found = spark.read.schema(columns).option("basePath", path).parquet(*(f"{path.rstrip('/')}/{f}" for f in files))
    return day_range(found, ticker, date, date_next).select(*columns.fieldNames())
