"""Hand-made micro ticks (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt

from ticklens.schema import TICK_SCHEMA

D1 = dt.date(2024, 1, 2)
D2 = dt.date(2024, 1, 3)
H = 3_600_000_000
S = 1_000_000


def t(h=0, m=0, s=0.0):
    """Local (already shifted) time of day in microseconds for a primary marketplace row."""
    return int(round(((h * 60 + m) * 60 + s) * S))


def raw_time(local_us: int, primary: bool = True, offset: int = 1) -> int:
    """Raw GMT time such that F1 maps it back to ``local_us``."""
    return local_us - (offset + (0 if primary else 1)) * H


def tick(seq, date, local_us, typ, price=None, volume=None, bid=None, bid_size=None, ask=None,
         ask_size=None, ticker="AAA.DE", marketplace="DAX Xetra", offset=1, qualifiers=" [ACT_FLAG1] [X]"):
    primary = marketplace in ("DAX Xetra", "CAC Paris")
    return (marketplace, ticker, date, raw_time(local_us, primary, offset), offset, typ, None,
            price, volume, bid, bid_size, ask, ask_size, qualifiers, seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, TICK_SCHEMA)
