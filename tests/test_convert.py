"""Conversions C1-C5."""

import pytest

from ticklens.functions import convert as C


def test_to_number_coerces(spark):
    df = spark.createDataFrame([("12.5",), ("",), ("abc",), (" 7 ",), ("NaN",), (None,)], "s string")
    got = [r.v for r in df.select(C.to_number("s").alias("v")).collect()]
    assert got == [12.5, None, None, 7.0, None, None]


def test_strict_conversion(spark):
    df = spark.createDataFrame([("1.5",), ("",)], "s string")
    assert [r.v for r in df.select(C.to_float_strict("s").alias("v")).collect()] == [1.5, None]
    bad = spark.createDataFrame([("x1",)], "s string")
    with pytest.raises(Exception):
        bad.select(C.to_float_strict("s")).collect()
    assert [r.v for r in spark.createDataFrame([("42",), ("",)], "s string")
            .select(C.to_int_strict("s").alias("v")).collect()] == [42, None]


def test_time_of_day(spark):
    rows = [("09:00:00.000",), ("16:30:00.5",), ("08:59:59.999999",), ("7:05:03.123456789",), ("9:00",), ("",)]
    got = [r.v for r in spark.createDataFrame(rows, "s string").select(C.time_of_day_us("s").alias("v")).collect()]
    assert got == [32_400_000_000, 59_400_500_000, 32_399_999_999, 25_503_123_456, None, None]


def test_rounding_of_seconds(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (51,), (55,), (59,)], "x long")
    up = [r.v for r in df.select(C.round_seconds_up("x").alias("v")).collect()]
    assert up == [0, 10, 10, 60, 60, 60]
    up_wrap = [r.v for r in df.select(C.round_seconds_up("x", 10, True).alias("v")).collect()]
    assert up_wrap == [0, 10, 10, 0, 0, 0]
    down = [r.v for r in df.select(C.round_seconds_down("x").alias("v")).collect()]
    assert down == [0, 0, 10, 50, 50, 50]
    t = spark.createDataFrame([(32_459_400_000,)], "t long").select(C.floor_time_us("t", 10).alias("v")).collect()
    assert t[0].v == 32_450_000_000
