"""Daily aggregates on hand-made ticks with values worked out by hand."""

import math
import statistics as st

import pytest
from pyspark.sql import functions as F

from micro import D1, D2, frame, t, tick
from ticklens.operators import clean, daily, intervals


def _one(df, **keys):
    rows = df.filter(" AND ".join(f"{k} = '{v}'" for k, v in keys.items())).collect()
    assert len(rows) == 1, rows
    return rows[0]


@pytest.fixture(scope="module")
def trade_ticks(spark):
    rows = [
        tick(1, D1, t(8, 59, 59.999), "Trade", 9.0, 1.0),                    # before the open: dropped
        tick(2, D1, t(9, 0, 0.0), "Trade", 10.0, 1.0),                       # open boundary kept
        tick(3, D1, t(9, 0, 1.0), "Trade", 11.0, 2.0),
        tick(4, D1, t(9, 0, 2.0), "Trade", 50.0, 1.0, qualifiers="[OTHER]"),  # not a valid trade
        tick(5, D1, t(9, 0, 3.5), "Trade", 12.0, 1.0),
        tick(6, D1, t(16, 30, 0.0), "Trade", 12.0, 1.0),                     # close boundary kept
        tick(7, D1, t(16, 30, 0.001), "Trade", 99.0, 1.0),                   # after the close
        tick(8, D2, t(10, 0, 0.0), "Trade", 20.0, 3.0),                      # one-tick day
    ]
    return frame(spark, rows)


def test_trade_day(trade_ticks):
    out = daily.daily_trades(trade_ticks)
    r = _one(out, date="2024-01-02")
    assert r.N == 4
    assert r.V == pytest.approx(10 + 22 + 12 + 12)
    assert r.X == 5
    assert (r.Open, r.Close, r.High, r.Low) == (10.0, 12.0, 12.0, 10.0)
    dts = [1000, 2500, (16 * 3600 + 30 * 60 - (9 * 3600 + 3.5)) * 1000]
    assert r.P == pytest.approx((dts[0] * 10 + dts[1] * 11 + dts[2] * 12) / sum(dts))
    assert r.sigma_p == pytest.approx(st.stdev([10, 11, 12, 12]))
    assert r.sigma_r == pytest.approx(st.stdev([1.1, 12 / 11, 1.0]))


def test_one_trade_day(trade_ticks):
    r = _one(daily.daily_trades(trade_ticks), date="2024-01-03")
    assert r.N == 1 and r.Open == r.Close == 20.0
    assert r.sigma_r is None and r.sigma_p is None and r.P is None


def test_null_open(spark):
    rows = [tick(1, D1, t(9, 1, 0), "Trade", None, 1.0), tick(2, D1, t(9, 2, 0), "Trade", 5.0, 1.0)]
    r = daily.daily_trades(frame(spark, rows)).collect()[0]
    assert r.Open is None and r.Close == 5.0 and r.N == 2


def test_dst_offset_per_row(spark):
    rows = [tick(1, D1, t(9, 0, 0), "Trade", 1.0, 1.0, offset=1),
            tick(2, D1, t(9, 30, 0), "Trade", 2.0, 1.0, offset=2)]
    local = clean.local_time(frame(spark, rows)).orderBy("seq").collect()
    assert [r.time_us for r in local] == [t(9, 0, 0), t(9, 30, 0)]


@pytest.fixture(scope="module")
def quote_ticks(spark):
    rows = [
        tick(1, D1, t(9, 0, 55.4), "Quote", bid=10.0, bid_size=5.0, ask=10.2, ask_size=6.0),
        tick(2, D1, t(9, 1, 5.0), "Quote", bid=None, bid_size=0.0, ask=10.2, ask_size=6.0),   # filled, size 0
        tick(3, D1, t(9, 1, 20.0), "Quote", bid=10.1, bid_size=5.0, ask=10.3, ask_size=6.0),
        tick(4, D1, t(9, 1, 30.0), "Quote", bid=10.1, bid_size=5.0, ask=None, ask_size=6.0),  # flat mid
        tick(5, D2, t(9, 0, 0.0), "Quote", bid=None, bid_size=5.0, ask=10.4, ask_size=6.0),   # overnight fill
        tick(6, D2, t(9, 0, 0.0), "Quote", bid=10.2, bid_size=5.0, ask=10.4, ask_size=6.0),   # same time
        tick(7, D2, t(9, 0, 20.0), "Quote", bid=10.2, bid_size=5.0, ask=10.5, ask_size=6.0),
    ]
    return frame(spark, rows)


def _lm(b, a):
    return (math.log(b) + math.log(a)) / 2


def test_quote_day_one(quote_ticks):
    r = _one(daily.daily_quotes(quote_ticks), date="2024-01-02")
    assert r.N == 3
    w = [9600.0, 10000.0]   # q1 ends at the (invalid) q2; q3 -> q4; q4 has no successor
    assert r.bid_price == pytest.approx((w[0] * 10.0 + w[1] * 10.1) / sum(w))
    assert r.ask_price == pytest.approx((w[0] * 10.2 + w[1] * 10.3) / sum(w))
    rel = [(10.2 - 10.0) / 10.1 * 1e4, (10.3 - 10.1) / 10.2 * 1e4]
    assert r.rel_spread == pytest.approx((w[0] * rel[0] + w[1] * rel[1]) / sum(w))
    assert r.sigma_s == pytest.approx(st.stdev([0.2, 0.2, 0.2]), abs=1e-12)
    y1, y3 = _lm(10.0, 10.2), _lm(10.1, 10.3)
    t1, t3 = 55.4, 80.0
    grid = [y1 + (60 - t1) * (y3 - y1) / (t3 - t1), y1 + (70 - t1) * (y3 - y1) / (t3 - t1), y3]   # :30 repeats y3
    assert r.sigma_m_log == pytest.approx(st.pstdev(grid))


def test_quote_day_two_fill_and_duplicate(quote_ticks):
    r = _one(daily.daily_quotes(quote_ticks), date="2024-01-03")
    assert r.N == 3   # q5 valid through the overnight fill
    series = daily.sampled_series(quote_ticks).filter(F.col("date") == "2024-01-03").orderBy("time_us").collect()
    y6, y7 = _lm(10.2, 10.4), _lm(10.2, 10.5)
    assert [s.time_us for s in series] == [t(9, 0, 0), t(9, 0, 10), t(9, 0, 20)]
    assert series[0].log_midpoint == pytest.approx(y6)   # the last quote of the duplicated time
    assert series[1].log_midpoint == pytest.approx((y6 + y7) / 2)
    day_scope = _one(daily.daily_quotes(quote_ticks, fill_scope="day"), date="2024-01-03")
    assert day_scope.N == 2


def test_grid_starts_after_first_quote(quote_ticks):
    s = daily.sampled_series(quote_ticks).filter(F.col("date") == "2024-01-02").orderBy("time_us").collect()
    assert [x.time_us for x in s] == [t(9, 1, 0), t(9, 1, 10), t(9, 1, 20), t(9, 1, 30)]


def test_gap_minutes_distribution(spark):
    mins = [0, 1, 1, 4, 6]
    rows = [tick(i + 1, D1, t(9, m, 5.0 + i), "Trade", 10.0, 1.0) for i, m in enumerate(mins)]
    tr = clean.trades(clean.clean(frame(spark, rows)))
    got = {r.category: r.frequency for r in intervals.daily_distribution(tr, 60).collect()}
    assert got == {2: 1, 1: 1, 0: 3}
