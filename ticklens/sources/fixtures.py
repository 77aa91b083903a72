"""Adapters from the driver tables to the engine's schemas (see FIXTURES.md).

* ``ticks_from_events``      - typed ticks (trades and quotes of 16 tickers on 8 marketplaces)
* ``daily_from_lineitem``    - a daily container input with ~45 source rows per ticker-month
* ``index_members`` / ``market_cap`` - the small dimension tables of the fixtures

All rules are integer arithmetic on the source columns so DuckDB can state them identically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MICROS_PER_HOUR, TICK_SCHEMA

# FIXED VALUES of the fixtures: stock codes by s = id % 4, primary venue by s, MTF venues by v.
FIXTURE_STOCKS = ["ADSGn", "BASFn", "TOTF", "BNPP"]
FIXTURE_PRIMARY = ["DE", "DE", "PA", "AS"]
FIXTURE_MTFS = ["BS", "CHI", "TQ"]
FIXTURE_DAX = ["ADSGn", "BASFN"]
FIXTURE_CAC = ["TOTF", "BNPP"]
FIXTURE_CAPS = [50.0, 80.0, 120.0, 60.0]
FIXTURE_EXCLUDED = ["BNPP.TQ"]
FIXTURE_PERIOD_SPLIT = "2024-01-15"
LINEITEM_PERIOD_SPLIT = "1998-07-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(t: Column) -> tuple[Column, Column, Column]:
    """(ticker, marketplace, is_primary) for an integer instrument id ``t``."""
    s = F.pmod(t, F.lit(4))
    v = F.pmod(F.floor(t / 4).cast("long"), F.lit(4))
    stock = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_STOCKS]), (s + 1).cast("int"))
    primary = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_PRIMARY]), (s + 1).cast("int"))
    mtf = F.element_at(F.array(*[F.lit(x) for x in FIXTURE_MTFS]), v.cast("int"))
    venue = F.when(v == 0, primary).otherwise(mtf)
    index = F.when(s < 2, F.lit("DAX")).otherwise(F.lit("CAC"))
    marketplace = F.when(v == 0, F.when(s < 2, F.lit("DAX Xetra")).otherwise(F.lit("CAC Paris"))) \
        .otherwise(F.concat(index, F.lit(" MTF "), venue))
    return F.concat(stock, F.lit("."), venue), marketplace, v == 0


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Typed ticks from ``events`` (FIXTURES.md section 2); raw GMT time, F1 not yet applied."""
    k = F.get_json_object("props", "$.k").cast("long")
    ticker, marketplace, is_primary = _names(F.col("user_id"))
    us_of_day = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)")
    is_trade = F.col("event_type").isin("purchase", "click")
    eid = F.col("event_id")
    out = events.select(
        marketplace.alias("marketplace"),
        ticker.alias("ticker"),
        F.to_date("ts").alias("date"),
        (F.lit(8 * MICROS_PER_HOUR) + F.floor(us_of_day / 3).cast("long")).alias("time_us"),
        F.when(is_primary, 1).otherwise(0).cast("int").alias("gmt_offset"),
        F.when(is_trade, "Trade").otherwise("Quote").alias("type"),
        F.lit(None).cast("string").alias("exchange_id"),
        F.when(is_trade, F.col("value")).alias("price"),
        F.when(is_trade, (k + 1).cast("double")).alias("volume"),
        F.when(~is_trade & (F.pmod(eid, F.lit(7)) != 0), F.col("value")).alias("bid_price"),
        F.when(~is_trade, F.when(F.pmod(eid, F.lit(11)) == 0, F.lit(0.0))
               .otherwise((k + 1).cast("double"))).alias("bid_size"),
        F.when(~is_trade, F.col("value") * (1 + (1 + F.pmod(k, F.lit(5))) / 1000)).alias("ask_price"),
        F.when(~is_trade, (k + 2).cast("double")).alias("ask_size"),
        F.when(F.pmod(eid, F.lit(10)) == 0, F.lit("[OTHER]"))
        .otherwise(F.lit(" [ACT_FLAG1] [X]")).alias("qualifiers"),
        eid.alias("seq"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in TICK_SCHEMA.fields])


def load_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the fixture scale factor ``sf_dir``."""
    return ticks_from_events(_table(spark, sf_dir, "events"))


def daily_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily container input from ``lineitem`` (FIXTURES.md section 3): ticker-month rows."""
    t = F.pmod(F.col("l_suppkey"), F.lit(16))
    ticker, _, _ = _names(t)
    p = F.col("l_extendedprice") / F.col("l_quantity")
    src = lineitem.select(
        ticker.alias("ticker"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("date"),
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        p.alias("p"))
    agg = src.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.count_distinct("l_orderkey") + 1).alias("n_quotes"),
        F.sum("l_extendedprice").alias("V"),
        F.sum("l_quantity").alias("X"),
        F.avg("p").alias("P"),
        F.stddev_pop(F.log(F.col("p"))).alias("sigma_m_log"),
        F.avg(F.col("p") * (1 - F.col("l_discount"))).alias("bid_price"),
        F.avg(F.col("p") * (1 + F.col("l_tax"))).alias("ask_price"),
        F.avg("l_quantity").alias("bid_size"),
        F.max("l_quantity").alias("ask_size"),
    )
    rel = (F.col("ask_price") - F.col("bid_price")) / ((F.col("ask_price") + F.col("bid_price")) / 2) * 10000
    return agg.withColumn("rel_spread", rel)


def load_daily_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_from_lineitem(_table(spark, sf_dir, "lineitem"))


def index_members(spark: SparkSession) -> DataFrame:
    """(stock, index) rows of the fixture's DAX and CAC lists (a local relation with known size)."""
    rows = [(s, "DAX") for s in FIXTURE_DAX] + [(s, "CAC") for s in FIXTURE_CAC]
    values = ", ".join(f"('{a}', '{b}')" for a, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(stock, index)")


def market_cap(spark: SparkSession) -> DataFrame:
    """Market-cap table: primary, BS, CHI, TQ ticker, capitalisation, and its file row number."""
    rows = []
    for i, (stock, primary, cap) in enumerate(zip(FIXTURE_STOCKS, FIXTURE_PRIMARY, FIXTURE_CAPS)):
        rows.append(f"('{stock}.{primary}', '{stock}.BS', '{stock}.CHI', '{stock}.TQ', "
                    f"CAST({cap} AS DOUBLE), CAST({i} AS BIGINT))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(ticker_rm, ticker_bs, ticker_chi, "
                     "ticker_tq, market_capitalization, row_no)")
