"""Sinks and small lookup readers.

* S7  ``save_daily``        daily trades / quotes (and a distribution) per marketplace
* S8  ``append_daily``      add only keys not stored yet: left-anti join on the keys, append
* S9  ``read_daily``        all stored ``*Trades`` / ``*Quotes`` tables as one DataFrame
* S10 ``write_result``      result tables (CSV with header, or Parquet)
* S11 ``read_ticker_list`` / ``read_market_cap`` / ``read_distribution``
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MARKET_CAP_HEADER, MARKET_CAP_SCHEMA

DAILY_KEYS = ["marketplace", "ticker", "date"]


def save_daily(daily: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One table per kind, partitioned by marketplace (CSV gets a header line)."""
    w = daily.write.mode(mode).partitionBy("marketplace")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_daily(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str] = tuple(DAILY_KEYS),
                 fmt: str = "parquet") -> DataFrame:
    """Append the rows of ``new`` whose keys are not stored at ``path`` yet.

    Only the key columns of the stored table are read (column pruning); the anti join makes a
    re-run of the same input a no-op, so a retried batch never duplicates rows. Only a path that
    does not exist means "nothing stored"; a store that can't be read is an error.
    """
    keys = list(keys)
    fresh = new
    try:
        stored = (spark.read.parquet(path) if fmt == "parquet"
                  else spark.read.option("header", True).csv(path)).select(*keys)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        fresh = new.join(stored, keys, "left_anti")
    save_daily(fresh, path, fmt, mode="append")
    return fresh


def read_daily(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Every stored daily table under ``path`` (all marketplaces) as one DataFrame."""
    if fmt == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a result table."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def read_ticker_list(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Headerless list of stock codes in any layout of lines and commas -> (stock, index)."""
    codes = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("stock"))
    plain = F.trim(F.regexp_replace("stock", '["\\r\ufeff]', ""))
    return codes.select(plain.alias("stock"), F.lit(index).alias("index")).where("stock <> ''")


def read_market_cap(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Market-cap file (header; primary, BS, CHI, TQ ticker first) + file row order.

    The capitalisation is the column named ``MARKET.CAPITALIZATION`` (any case, any separator),
    wherever it stands.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    cols = raw.columns
    named = [c for c in cols if re.sub("[^A-Z]+", ".", c.strip().upper()) == MARKET_CAP_HEADER]
    if len(named) != 1:
        raise ValueError(f"{path}: one column {MARKET_CAP_HEADER} expected, found {named} in {cols}")
    out = raw.select(*[F.trim(F.col(f"`{cols[i]}`")).alias(MARKET_CAP_SCHEMA.fields[i].name) for i in range(4)],
                     F.trim(F.col(f"`{named[0]}`")).try_cast("double").alias("market_capitalization"))
    return out.withColumn("row_no", F.monotonically_increasing_id())


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column frequency table (category, frequency)."""
    return spark.read.schema("category long, frequency long").csv(path)
