"""Sources and sinks: gzip CSV round trip (S1-S3), day index (S4-S6), sinks."""

import csv
import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ticklens.operators import clean, daily
from ticklens.plans.catalog import rounded
from ticklens.schema import RAW_TICK_COLUMNS
from ticklens.sources import aggregates_io as io
from ticklens.sources import day_index as di
from ticklens.sources import fixtures as fx
from ticklens.sources import ticks_csv

VENUES = [("DAX Xetra", ""), ("CAC Paris", ""), ("DAX MTF", ".BS_"), ("DAX MTF", ".CHI_"), ("DAX MTF", ".TQ_"),
          ("CAC MTF", ".BS_"), ("CAC MTF", ".CHI_"), ("CAC MTF", ".TQ_")]


def _fmt_time(us):
    s, f = divmod(int(us), 1_000_000)
    h, s = divmod(s, 3600)
    m, s = divmod(s, 60)
    return f"{h:02d}:{m:02d}:{s:02d}.{f:06d}"


def _txt(v):
    return "" if v is None else repr(float(v))


def write_tick_files(ticks_rows, root):
    """One gz CSV per ticker, in the folder of its marketplace family, rows in seq order."""
    by_ticker = {}
    for r in sorted(ticks_rows, key=lambda r: r.seq):
        by_ticker.setdefault((r.marketplace, r.ticker), []).append(r)
    for (market, ticker), rows in by_ticker.items():
        folder = os.path.join(root, market if "MTF" not in market else market.rsplit(" ", 1)[0])
        os.makedirs(folder, exist_ok=True)
        with gzip.open(os.path.join(folder, f"RAW_{ticker}_2024.csv.gz"), "wt", newline="") as fh:
            w = csv.writer(fh)
            w.writerow(RAW_TICK_COLUMNS)
            for r in rows:
                w.writerow([r.ticker, r.date.strftime("%Y%m%d"), _fmt_time(r.time_us), r.gmt_offset, r.type, "",
                            _txt(r.price), _txt(r.volume), _txt(r.bid_price), _txt(r.bid_size),
                            _txt(r.ask_price), _txt(r.ask_size), r.qualifiers])


@pytest.fixture(scope="module")
def tick_root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ticks"))
    write_tick_files(fx.load_ticks(spark, SF001).collect(), root)
    return root


def _rows(df):
    return sorted(rounded(df).collect(), key=str)


def test_csv_round_trip(spark, tick_root):
    from_csv = ticks_csv.read_venues(spark, [(os.path.join(tick_root, f), flt) for f, flt in VENUES])
    direct = fx.load_ticks(spark, SF001)
    assert from_csv.count() == direct.count()
    assert sorted(r.marketplace for r in from_csv.select("marketplace").distinct().collect()) == \
        sorted(r.marketplace for r in direct.select("marketplace").distinct().collect())
    assert _rows(daily.daily_trades(from_csv)) == _rows(daily.daily_trades(direct))
    assert _rows(daily.daily_quotes(from_csv)) == _rows(daily.daily_quotes(direct))


def test_leading_space_kept(spark, tick_root):
    raw = ticks_csv.read_raw(spark, os.path.join(tick_root, "DAX Xetra"))
    assert raw.filter(F.col("Qualifiers").startswith(" [ACT_FLAG1]")).count() > 0


def test_name_filter_selects_venue(spark, tick_root):
    t = ticks_csv.read_ticks(spark, os.path.join(tick_root, "DAX MTF"), ".CHI_")
    tickers = {r.ticker for r in t.select("ticker").distinct().collect()}
    assert tickers and all(x.endswith(".CHI") for x in tickers)
    assert {r.marketplace for r in t.select("marketplace").distinct().collect()} == {"DAX MTF CHI"}


def test_day_index_and_range(spark, tmp_dir):
    ticks = fx.load_ticks(spark, SF001)
    idx = di.day_index(ticks)
    rows = sorted(ticks.select("ticker", "date", "seq").collect(), key=lambda r: (r.ticker, r.seq))
    expect, pos = {}, {}
    for r in rows:
        pos.setdefault(r.ticker, 0)
        expect.setdefault((r.ticker, r.date), [pos[r.ticker], 0])
        expect[(r.ticker, r.date)][1] += 1
        pos[r.ticker] += 1
    got = {(r.ticker, r.date): [r.first_row, r.n_rows] for r in idx.collect()}
    assert got == expect
    di.save_index(idx, os.path.join(tmp_dir, "idx"))
    back = di.load_index(spark, os.path.join(tmp_dir, "idx"))
    assert sorted(back.collect()) == sorted(idx.collect())
    some = rows[0].ticker
    rng = di.day_range(ticks, some, "2024-01-05", "2024-01-07")
    dates = {r.date for r in rng.select("date").distinct().collect()}
    assert dates <= {dt.date(2024, 1, 5), dt.date(2024, 1, 6)}
    assert rng.count() == sum(v[1] for (tk, d), v in expect.items()
                              if tk == some and dt.date(2024, 1, 5) <= d < dt.date(2024, 1, 7))


def test_append_is_idempotent(spark, tmp_dir):
    ticks = fx.load_ticks(spark, SF001)
    tr = daily.daily_trades(ticks, by_marketplace=True)
    path = os.path.join(tmp_dir, "trades")
    first = tr.filter(F.col("date") < "2024-01-15")
    io.append_daily(spark, first, path)
    io.append_daily(spark, tr, path)
    io.append_daily(spark, tr, path)
    stored = io.read_daily(spark, path)
    assert stored.count() == tr.count()
    assert stored.select("marketplace", "ticker", "date").distinct().count() == tr.count()


def test_csv_sink_and_lookups(spark, tmp_dir):
    ticks = fx.load_ticks(spark, SF001)
    tr = daily.daily_trades(ticks, by_marketplace=True)
    io.save_daily(tr, os.path.join(tmp_dir, "agg"), fmt="csv")
    back = io.read_daily(spark, os.path.join(tmp_dir, "agg"), fmt="csv")
    assert back.count() == tr.count()
    lst = os.path.join(tmp_dir, "dax.csv")
    with open(lst, "w") as fh:
        fh.write("ADSGn\nBASFN\n")
    assert [r.stock for r in io.read_ticker_list(spark, lst, "DAX").collect()] == ["ADSGn", "BASFN"]
    cap = os.path.join(tmp_dir, "cap.csv")
    with open(cap, "w") as fh:
        fh.write("RIC;BS;CHI;TQ;MARKET.CAPITALIZATION\nADSGn.DE;ADSGn.BS;ADSGn.CHI;ADSGn.TQ;50\n"
                 "TOTF.PA;TOTF.BS;TOTF.CHI;TOTF.TQ;120\n")
    mc = io.read_market_cap(spark, cap).orderBy("row_no").collect()
    assert [(r.ticker_rm, r.ticker_chi, r.market_capitalization) for r in mc] == \
        [("ADSGn.DE", "ADSGn.CHI", 50.0), ("TOTF.PA", "TOTF.CHI", 120.0)]


def test_unreadable_store_is_an_error(spark, tmp_dir):
    tr = daily.daily_trades(fx.load_ticks(spark, SF001), by_marketplace=True)
    path = os.path.join(tmp_dir, "broken")
    io.append_daily(spark, tr, path)
    n = io.read_daily(spark, path).count()
    part = next(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    os.remove(os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc"))
    with open(part, "wb") as fh:
        fh.write(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017  (any read error, as long as nothing is appended)
        io.append_daily(spark, tr, path)
    assert n == tr.count()


@pytest.mark.parametrize("text", ["ADSGn,BASFn,BAYGn", "ADSGn\nBASFn\nBAYGn\n", "ADSGn, BASFn\r\n\"BAYGn\",\n"])
def test_ticker_list_layouts(spark, tmp_dir, text):
    path = os.path.join(tmp_dir, "list.csv")
    with open(path, "w", newline="") as fh:
        fh.write(text)
    assert sorted(r.stock for r in io.read_ticker_list(spark, path, "DAX").collect()) == ["ADSGn", "BASFn", "BAYGn"]


def test_market_cap_column_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cap.csv")
    with open(path, "w") as fh:
        fh.write("RIC;BS;CHI;TQ;Name;Market capitalization\nA.DE;A.BS;A.CHI;A.TQ;Adam;50\nB.DE;B.BS;B.CHI;B.TQ;Berta;\n")
    got = {r.ticker_rm: r.market_capitalization for r in io.read_market_cap(spark, path).collect()}
    assert got == {"A.DE": 50.0, "B.DE": None}
    from ticklens.operators import container
    large = {r.ticker_rm: r.large_cap for r in container.market_cap_long(io.read_market_cap(spark, path)).collect()}
    assert large == {"A.DE": 0, "B.DE": None}


def test_blank_offsets_and_foreign_names(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "DAX Xetra")
    os.makedirs(folder)
    with gzip.open(os.path.join(folder, "RAW_OTHER.DE_2024.csv.gz"), "wt", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(RAW_TICK_COLUMNS)
        for k, offset in enumerate(["", "1", ""]):
            w.writerow(["ADSGn.DE", "20240102", f"09:00:0{k}.000000", offset, "Trade", "", "5", "1", "", "", "", "",
                        " [ACT_FLAG1]"])
        w.writerow(["ADSGn.DE", "bad", "09:00:05.000000", "1", "Trade", "", "5", "1", "", "", "", "", ""])
    ticks = clean.fill_offsets(ticks_csv.read_ticks(spark, folder))
    assert [r.gmt_offset for r in ticks.where("date is not null").collect()] == [1, 1, 1]
    assert {r.ticker for r in ticks.collect()} == {"ADSGn.DE"}
    assert [(r.ticker, r.no_date, r.no_offset) for r in clean.rejects(ticks).collect()] == [("ADSGn.DE", 1, 0)]
    assert [(r.ric, r.rows) for r in ticks_csv.name_mismatches(ticks_csv.read_raw(spark, folder)).collect()] == [("ADSGn.DE", 4)]
    assert daily.daily_trades(ticks).first().N == 3


def test_one_ticker_in_two_folders(spark):
    ticks = fx.load_ticks(spark, SF001)
    twice = ticks.unionByName(ticks.withColumn("marketplace", F.concat("marketplace", F.lit(" copy")))
                              .withColumn("gmt_offset", F.lit(1)))
    one = daily.daily_trades(ticks, by_marketplace=True).count()
    got = daily.daily_trades(twice, by_marketplace=True)
    assert got.select("marketplace", "ticker", "date").distinct().count() == got.count() > one


def test_staged_files_are_sorted(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ticks")
    ticks_csv.write_ticks_parquet(fx.load_ticks(spark, SF001), path)
    import pyarrow.parquet as pq
    for d, _, names in os.walk(path):
        for f in names:
            if f.endswith(".parquet"):
                rows = pq.ParquetFile(os.path.join(d, f)).read(["ticker", "seq"]).to_pylist()
                keys = [(r["ticker"], r["seq"]) for r in rows]
                assert keys == sorted(keys)
