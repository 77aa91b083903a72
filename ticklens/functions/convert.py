"""Conversions (C1-C5): numeric coercion, strict conversion, time-of-day parsing, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MICROS_PER_SECOND


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text to DOUBLE, bad or blank text to NULL; a parsed NaN also becomes NULL."""
    v = F.trim(_col(c).cast("string")).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def to_float_strict(c) -> Column:
    """C2 (float): blank to NULL, otherwise a cast that fails on bad text (ANSI mode)."""
    s = _col(c).cast("string")
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.cast("double"))


def to_int_strict(c) -> Column:
    """C2 (int): blank to NULL, otherwise a cast that fails on bad text (ANSI mode)."""
    s = _col(c).cast("string")
    return F.when(s == "", F.lit(None).cast("long")).otherwise(s.cast("long"))


_TIME_PATTERN = r"^(\d{1,2}):(\d{2}):(\d{2})\.(\d{1,9})$"


def time_of_day_us(c) -> Column:
    """``HH:MM:SS.f`` (1-9 fraction digits) to microseconds since midnight, else NULL."""
    s = F.trim(_col(c).cast("string"))
    ok = s.rlike(_TIME_PATTERN)

    def part(i):
        return F.regexp_extract(s, _TIME_PATTERN, i).try_cast("long")

    frac = F.substring(F.rpad(F.regexp_extract(s, _TIME_PATTERN, 4), 6, "0"), 1, 6).try_cast("long")
    us = ((part(1) * 60 + part(2)) * 60 + part(3)) * MICROS_PER_SECOND + frac
    return F.when(ok, us)


def round_seconds_up(c, seconds: int = 10, in_range: bool = False) -> Column:
    """C4: seconds rounded up to a multiple of ``seconds``; 60 wraps to 0 when ``in_range``."""
    x = _col(c)
    up = F.ceil(x / F.lit(float(seconds))).cast("long") * seconds
    return F.when(F.lit(in_range) & (up == 60), F.lit(0).cast("long")).otherwise(up)


def round_seconds_down(c, seconds: int = 10) -> Column:
    """Seconds rounded down to a multiple of ``seconds``."""
    x = _col(c)
    return x - F.pmod(x, F.lit(seconds))


def floor_time_us(c, seconds: int = 10) -> Column:
    """A time of day in microseconds floored to whole ``seconds`` (sub-seconds dropped)."""
    step = seconds * MICROS_PER_SECOND
    return _col(c) - F.pmod(_col(c), F.lit(step))
