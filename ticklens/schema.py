"""Schemas and fixed values.

Values in the FIXED VALUES block must equal the original study's values for results to agree;
they are stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must match the original analysis)
# ---------------------------------------------------------------------------------------------

# Column names of a raw tick file, in file order.
RAW_TICK_COLUMNS = ["#RIC", "Date[G]", "Time[G]", "GMT Offset", "Type", "Ex/Cntrb.ID", "Price",
                    "Volume", "Bid Price", "Bid Size", "Ask Price", "Ask Size", "Qualifiers"]

# Tickers excluded from the sample.
EXCLUDED_TICKERS = ["FTIp.BS", "FTIp.CHI", "FTIp.TQ", "TECp.BS", "TECp.CHI", "TECp.TQ", "VLOF.PA",
                    "VNAd.BS", "VNAd.CHI", "VNAd.TQ", "VNAn.DE", "FRp.BS", "FRp.CHI", "FRp.TQ",
                    "FRTp.BS", "FTI.PA"]

# Marketplaces whose times need no extra hour (all others are MTFs on London time).
PRIMARY_MARKETPLACES = ["DAX Xetra", "CAC Paris"]

# Trading hours after the local-time shift, inclusive.
TRADING_OPEN = "09:00:00.000"
TRADING_CLOSE = "16:30:00.000"

# Trade qualifier prefix of a valid trade (note the leading space).
TRADE_QUALIFIER_PREFIX = " [ACT_FLAG1]"

# The six regression models, in their order z1..z6.
MODELS = ["trade_freq", "quote_freq", "trade_vol", "quote_vol", "abs_spread", "rel_spread"]

# Venue suffixes mapped to the Paris primary venue.
PARIS_ALIASES = ["AS", "BR"]
PRIMARY_VENUES = ["DE", "PA"]

# Period split dates of the original study.
CAC_PERIOD2_START = "2016-10-01"   # CAC: period 1 is date < this
DAX_PERIOD1_END = "2016-06-15"     # DAX: period 1 is date <= this

# Sampling step of the log midpoint series and interval length of the trade distribution.
GRID_STEP_SECONDS = 10
DISTRIBUTION_SECONDS = 60

# Significance levels of the slope summary.
SIGNIFICANCE_5 = 0.05
SIGNIFICANCE_1 = 0.01

# Name of the capitalisation column of a market-cap file (upper case, separators as dots).
MARKET_CAP_HEADER = "MARKET.CAPITALIZATION"

# Columns of the daily and coefficient tables.
DAILY_TRADES_COLUMNS = ["ticker", "date", "V", "sigma_r", "sigma_p", "P", "N", "X", "Open",
                        "Close", "High", "Low"]
DAILY_QUOTES_COLUMNS = ["ticker", "date", "N", "sigma_s", "sigma_m", "sigma_m_log", "bid_price",
                        "bid_size", "ask_price", "ask_size", "rel_spread"]
COEFFICIENT_COLUMNS = ["symbol", "model", "mu", "a", "p", "r_squared", "r_adjusted", "a_se",
                       "f_test_p", "symbol_rm", "index", "venue", "market"]

# ---------------------------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------------------------

RAW_TICK_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_TICK_COLUMNS])

TICK_SCHEMA = T.StructType([
    T.StructField("marketplace", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("time_us", T.LongType()),
    T.StructField("gmt_offset", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("exchange_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("bid_price", T.DoubleType()),
    T.StructField("bid_size", T.DoubleType()),
    T.StructField("ask_price", T.DoubleType()),
    T.StructField("ask_size", T.DoubleType()),
    T.StructField("qualifiers", T.StringType()),
    T.StructField("seq", T.LongType()),
])

MARKET_CAP_SCHEMA = T.StructType([
    T.StructField("ticker_rm", T.StringType()),
    T.StructField("ticker_bs", T.StringType()),
    T.StructField("ticker_chi", T.StringType()),
    T.StructField("ticker_tq", T.StringType()),
    T.StructField("market_capitalization", T.DoubleType()),
])

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600_000_000
