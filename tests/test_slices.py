"""The slice-wise windows must give the same answer for any slice size (boundary fix-up)."""

import pytest

from conftest import SF001
from ticklens.operators import daily
from ticklens.plans.catalog import rounded
from ticklens.sources import fixtures as fx


def _rows(df):
    return sorted(rounded(df).collect(), key=str)


@pytest.mark.parametrize("slice_rows", [1, 7, 64])
def test_trades_any_slice(spark, slice_rows):
    ticks = fx.load_ticks(spark, SF001)
    assert _rows(daily.daily_trades(ticks, slice_rows=slice_rows)) == _rows(daily.daily_trades(ticks))


@pytest.mark.parametrize("slice_rows", [1, 5, 50])
def test_quotes_any_slice(spark, slice_rows):
    ticks = fx.load_ticks(spark, SF001)
    assert _rows(daily.daily_quotes(ticks, slice_rows=slice_rows)) == _rows(daily.daily_quotes(ticks))


def test_series_any_slice(spark):
    ticks = fx.load_ticks(spark, SF001)
    a = daily.sampled_series(ticks, slice_rows=3)
    b = daily.sampled_series(ticks)
    assert a.count() == b.count()
    assert _rows(a.exceptAll(b)) == []
