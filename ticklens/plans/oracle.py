"""Reference SQL (DuckDB dialect) for the named queries; the driver runs it beside Spark.

The SQL states each rule directly with plain window functions over whole groups (no slices,
no boundary summaries), so it is an independent statement of the semantics. Doubles are
rounded to ``SIG_BITS`` significant bits on both sides because sums in a different order
differ in the last bits. Views available: the driver tables (events, lineitem, ...).
"""

from __future__ import annotations

STEP_US = 10_000_000
OPEN_US = 32_400_000_000     # 09:00:00.000
CLOSE_US = 59_400_000_000    # 16:30:00.000


SIG_BITS = 30       # significant bits kept for comparison (about 9 decimal digits) ...
ABS_BITS = 40       # ... but never finer than 2^-40 absolute (results of cancellation near 0)
ZERO_BELOW = 2.0 ** -42


def pow2_sql(k: str, dialect: str) -> str:
    """2^k exactly, for -62 <= k <= 62 (an integer shift, then a division by it)."""
    shift = (lambda e: f"CAST(shiftleft(CAST(1 AS BIGINT), CAST({e} AS INT)) AS DOUBLE)") if dialect == "spark" \
        else (lambda e: f"CAST((CAST(1 AS BIGINT) << CAST({e} AS INTEGER)) AS DOUBLE)")
    return f"(CASE WHEN ({k}) >= 0 THEN {shift(k)} ELSE 1 / {shift(f'-({k})')} END)"


def exponent2_sql(x: str, dialect: str) -> str:
    """floor(log2|x|) exactly: a log2 estimate corrected by comparisons with exact powers of 2."""
    a = f"least(greatest(abs({x}), {ZERO_BELOW!r}), 1e15)"      # clamped: no-op inside the range
    e0 = f"CAST(floor(log2({a})) AS BIGINT)"
    return (f"(CASE WHEN {pow2_sql(e0, dialect)} > {a} THEN {e0} - 1 "
            f"WHEN {pow2_sql(f'{e0} + 1', dialect)} <= {a} THEN {e0} + 1 ELSE {e0} END)")


def sig_round_sql(x: str, bits: int = SIG_BITS, dialect: str = "duckdb") -> str:
    """Round a DOUBLE to a step of max(2^-(bits-1) |x|, 2^-ABS_BITS); Spark SQL and DuckDB.

    Scaling by 2^s is exact, rounding to an integer is exact, so both engines produce the same
    double from the same input, and values on a decimal grid (cents) never sit on a rounding
    tie. Sums of the same numbers in a different order (last-bit noise) round alike unless
    they straddle a step; the absolute floor keeps near-zero results of cancellation (tiny r²,
    z near 0) from being compared on their noise. |x| >= 1e15 is kept as is.
    """
    s = f"least({bits - 1} - {exponent2_sql(x, dialect)}, {ABS_BITS})"
    p = pow2_sql(s, dialect)
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN {x} WHEN abs({x}) >= 1e15 THEN {x} "
            f"WHEN abs({x}) < {ZERO_BELOW!r} THEN CAST(0 AS DOUBLE) "
            f"ELSE round({x} * {p}, 0) / {p} END)")


def rounded(sql: str, columns: list[tuple[str, bool]]) -> str:
    """Wrap ``sql``; ``columns`` lists (name, is_double) in output order."""
    sel = ", ".join(f'{sig_round_sql(chr(34) + c + chr(34))} AS "{c}"' if dbl else f'"{c}"'
                    for c, dbl in columns)
    return f"SELECT {sel} FROM ({sql}) AS _q"


# --- adapters -----------------------------------------------------------------------------------

_NAMES = """
  (['ADSGn','BASFn','TOTF','BNPP'])[{t} % 4 + 1] || '.' ||
    CASE WHEN ({t} // 4) % 4 = 0 THEN (['DE','DE','PA','AS'])[{t} % 4 + 1]
         ELSE (['BS','CHI','TQ'])[({t} // 4) % 4] END"""

TICKS = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         event_type IN ('purchase', 'click') AS is_trade
  FROM events
),
ticks AS (
  SELECT
    CASE WHEN (user_id // 4) % 4 = 0
         THEN CASE WHEN user_id % 4 < 2 THEN 'DAX Xetra' ELSE 'CAC Paris' END
         ELSE CASE WHEN user_id % 4 < 2 THEN 'DAX' ELSE 'CAC' END || ' MTF ' ||
              (['BS','CHI','TQ'])[(user_id // 4) % 4] END AS marketplace,
    {_NAMES.format(t='user_id')} AS ticker,
    CAST(ts AS DATE) AS date,
    28800000000 + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 3 AS time_us,
    CASE WHEN (user_id // 4) % 4 = 0 THEN 1 ELSE 0 END AS gmt_offset,
    CASE WHEN is_trade THEN 'Trade' ELSE 'Quote' END AS type,
    CASE WHEN is_trade THEN value END AS price,
    CASE WHEN is_trade THEN CAST(k + 1 AS DOUBLE) END AS volume,
    CASE WHEN NOT is_trade AND event_id % 7 <> 0 THEN value END AS bid_price,
    CASE WHEN NOT is_trade THEN CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE CAST(k + 1 AS DOUBLE) END END AS bid_size,
    CASE WHEN NOT is_trade THEN value * (1 + (1 + k % 5) / 1000) END AS ask_price,
    CASE WHEN NOT is_trade THEN CAST(k + 2 AS DOUBLE) END AS ask_size,
    CASE WHEN event_id % 10 = 0 THEN '[OTHER]' ELSE ' [ACT_FLAG1] [X]' END AS qualifiers,
    event_id AS seq
  FROM ev
),
clean AS (
  SELECT * FROM (
    SELECT * REPLACE (time_us + (gmt_offset + CASE WHEN marketplace IN ('DAX Xetra', 'CAC Paris')
                                                   THEN 0 ELSE 1 END) * 3600000000 AS time_us)
    FROM ticks)
  WHERE time_us BETWEEN {OPEN_US} AND {CLOSE_US}
)"""

DAILY_TRADES_CTE = f"""
trades AS (
  SELECT ticker, date, time_us, price, volume, seq FROM clean
  WHERE type = 'Trade' AND starts_with(qualifiers, ' [ACT_FLAG1]')
),
tr AS (
  SELECT *, lag(price) OVER w AS prev_price, lead(time_us) OVER w AS next_time_us
  FROM trades WINDOW w AS (PARTITION BY ticker, date ORDER BY seq)
),
tr2 AS (
  SELECT *, CAST((next_time_us - time_us) // 1000 AS DOUBLE) AS dt_ms, price * volume AS value,
         CASE WHEN prev_price <> 0 THEN price / prev_price END AS gross_return
  FROM tr
),
daily_trades AS (
  SELECT ticker, date, sum(value) AS V, stddev_samp(gross_return) AS sigma_r,
         stddev_samp(price) AS sigma_p,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * price) / sum(dt_ms) END AS P,
         count(*) AS N, sum(volume) AS X, arg_min(price, seq) AS Open, arg_max(price, seq) AS Close,
         max(price) AS High, min(price) AS Low
  FROM tr2 GROUP BY ticker, date
)"""

QUOTE_ROWS_CTE = f"""
quotes AS (
  SELECT ticker, date, time_us, bid_price, bid_size, ask_price, ask_size, seq FROM clean
  WHERE type = 'Quote'
),
q1 AS (
  SELECT ticker, date, time_us, seq,
         CAST((lead(time_us) OVER (PARTITION BY ticker, date ORDER BY seq) - time_us) // 1000 AS DOUBLE) AS dt_ms,
         last_value(bid_price IGNORE NULLS) OVER wf AS bid_price,
         last_value(bid_size IGNORE NULLS) OVER wf AS bid_size,
         last_value(ask_price IGNORE NULLS) OVER wf AS ask_price,
         last_value(ask_size IGNORE NULLS) OVER wf AS ask_size
  FROM quotes
  WINDOW wf AS (PARTITION BY ticker ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
vq AS (
  SELECT *, ask_price - bid_price AS abs_spread, (ask_price + bid_price) / 2 AS mid,
         (ask_price - bid_price) / ((ask_price + bid_price) / 2) * 10000 AS rel_spread,
         (ln(bid_price) + ln(ask_price)) / 2 AS log_mid
  FROM q1 WHERE bid_price > 0 AND bid_size > 0 AND ask_price > 0 AND ask_size > 0
),
dedup AS (
  SELECT * FROM (
    SELECT *, lead(time_us) OVER (PARTITION BY ticker, date ORDER BY seq) AS dup_t FROM vq)
  WHERE dup_t IS NULL OR dup_t <> time_us
),
seg AS (
  SELECT ticker, date, time_us AS t0, log_mid AS y0, lead(time_us) OVER w AS t1, lead(log_mid) OVER w AS y1
  FROM dedup WINDOW w AS (PARTITION BY ticker, date ORDER BY seq)
),
bounds AS (
  SELECT *, (t0 + {STEP_US - 1}) // {STEP_US} AS lo,
         CASE WHEN t1 IS NULL THEN t0 // {STEP_US} ELSE (t1 + {STEP_US - 1}) // {STEP_US} - 1 END AS hi
  FROM seg
),
grid AS (
  SELECT ticker, date, t0, t1, y0, y1, k * {STEP_US} AS g
  FROM (SELECT *, unnest(generate_series(lo, hi)) AS k FROM bounds WHERE hi >= lo)
),
series AS (
  SELECT ticker, date, g AS time_us,
         CASE WHEN g = t0 THEN y0 ELSE (y1 - y0) / CAST(t1 - t0 AS DOUBLE) * CAST(g - t0 AS DOUBLE) + y0 END
           AS log_midpoint
  FROM grid
)"""

DAILY_QUOTES_CTE = QUOTE_ROWS_CTE + """,
rep AS (
  SELECT *, lag(log_midpoint) OVER (PARTITION BY ticker, date ORDER BY time_us) AS prev_y FROM series
),
vol AS (
  SELECT ticker, date, stddev_pop(log_midpoint) AS sigma_m_log FROM rep
  WHERE prev_y IS NULL OR prev_y <> log_midpoint GROUP BY ticker, date
),
qagg AS (
  SELECT ticker, date, count(*) AS N, stddev_samp(abs_spread) AS sigma_s, stddev_samp(mid) AS sigma_m,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * bid_price) / sum(dt_ms) END AS bid_price,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * bid_size) / sum(dt_ms) END AS bid_size,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * ask_price) / sum(dt_ms) END AS ask_price,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * ask_size) / sum(dt_ms) END AS ask_size,
         CASE WHEN sum(dt_ms) <> 0 THEN sum(dt_ms * rel_spread) / sum(dt_ms) END AS rel_spread
  FROM vq GROUP BY ticker, date
),
daily_quotes AS (
  SELECT qagg.ticker, qagg.date, N, sigma_s, sigma_m, sigma_m_log, bid_price, bid_size, ask_price,
         ask_size, rel_spread
  FROM qagg LEFT JOIN vol ON qagg.ticker = vol.ticker AND qagg.date = vol.date
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


# --- container ------------------------------------------------------------------------------------

def ln_pos(e: str) -> str:
    return f"(CASE WHEN ({e}) > 0 THEN ln({e}) END)"


def ddiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


DAILY_LINEITEM_CTE = f"""
li AS (
  SELECT {_NAMES.format(t='l_suppkey')} AS ticker,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice / l_quantity AS p
  FROM lineitem
),
li_agg AS (
  SELECT ticker, date, count(*) AS n_trades, count(DISTINCT l_orderkey) + 1 AS n_quotes,
         sum(l_extendedprice) AS V, sum(l_quantity) AS X, avg(p) AS P, stddev_pop(ln(p)) AS sigma_m_log,
         avg(p * (1 - l_discount)) AS bid_price, avg(p * (1 + l_tax)) AS ask_price,
         avg(l_quantity) AS bid_size, max(l_quantity) AS ask_size
  FROM li GROUP BY ticker, date
),
daily AS (
  SELECT *, (ask_price - bid_price) / ((ask_price + bid_price) / 2) * 10000 AS rel_spread FROM li_agg
)"""

DAILY_EVENTS_CTE = """
daily AS (
  SELECT t.ticker, t.date, t.V, t.sigma_r, t.sigma_p, t.P, t.N AS n_trades, t.X, t.Open, t.Close,
         t.High, t.Low, q.N AS n_quotes, q.sigma_s, q.sigma_m, q.sigma_m_log, q.bid_price, q.bid_size,
         q.ask_price, q.ask_size, q.rel_spread
  FROM daily_trades t JOIN daily_quotes q ON t.ticker = q.ticker AND t.date = q.date
)"""


def _str_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def container_cte(excluded, dax, cac, caps_rows, cac_period2_start: str, dax_period1_end: str,
                  drop_crossed: bool = True) -> str:
    """``container`` from ``daily``; caps_rows = [(rm, bs, chi, tq, cap, row_no)]."""
    caps_values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', CAST({e} AS DOUBLE), {f})"
                            for a, b, c, d, e, f in caps_rows)
    crossed = "AND bid_price < ask_price" if drop_crossed else ""
    excl = f"ticker NOT IN ({_str_list(excluded)})" if excluded else "TRUE"
    return f"""
c0 AS (SELECT *, sigma_m_log * V AS W FROM daily WHERE {excl} {crossed}),
c1 AS (
  SELECT *, (SELECT avg(W) FROM c0) AS W_star,
         split_part(ticker, '.', 1) AS stock, upper(split_part(ticker, '.', 1)) AS stock_upper,
         CASE WHEN split_part(ticker, '.', 2) IN ('AS', 'BR') THEN 'PA' ELSE split_part(ticker, '.', 2) END AS venue
  FROM c0
),
c2 AS (
  SELECT *, CASE WHEN venue IN ('DE', 'PA') THEN 'Primary' ELSE 'MTF' END AS market,
         CASE WHEN stock IN ({_str_list(dax)}) OR stock_upper IN ({_str_list(dax)}) THEN 'DAX'
              WHEN stock IN ({_str_list(cac)}) OR stock_upper IN ({_str_list(cac)}) THEN 'CAC' END AS "index"
  FROM c1
),
caps AS (
  SELECT * FROM (VALUES {caps_values})
    AS t(ticker_rm, ticker_bs, ticker_chi, ticker_tq, market_capitalization, row_no)
),
caps2 AS (
  SELECT *, CASE WHEN market_capitalization IS NULL THEN NULL
                 WHEN market_capitalization > (SELECT median(market_capitalization) FROM caps)
                 THEN 1 ELSE 0 END AS large_cap FROM caps
),
lk AS (
  SELECT 'rm' AS lookup, ticker_rm AS lookup_ticker, ticker_rm, large_cap, row_no FROM caps2
  UNION ALL SELECT 'bs', ticker_bs, ticker_rm, large_cap, row_no FROM caps2
  UNION ALL SELECT 'chi', ticker_chi, ticker_rm, large_cap, row_no FROM caps2
  UNION ALL SELECT 'tq', ticker_tq, ticker_rm, large_cap, row_no FROM caps2
),
lk1 AS (
  SELECT lookup, lookup_ticker, arg_min(ticker_rm, row_no) AS ticker_rm, arg_min(large_cap, row_no) AS large_cap
  FROM lk GROUP BY lookup, lookup_ticker
),
c3 AS (
  SELECT c2.*, lk1.ticker_rm, lk1.large_cap FROM c2 LEFT JOIN lk1
    ON lk1.lookup = CASE WHEN c2.market = 'Primary' THEN 'rm' WHEN c2.venue = 'BS' THEN 'bs'
                         WHEN c2.venue = 'CHI' THEN 'chi' ELSE 'tq' END
   AND lk1.lookup_ticker = c2.ticker
),
container AS (
  SELECT *, CASE WHEN ("index" = 'CAC' AND date < DATE '{cac_period2_start}')
                   OR ("index" = 'DAX' AND date <= DATE '{dax_period1_end}') THEN 1
                 WHEN ("index" = 'CAC' AND date >= DATE '{cac_period2_start}')
                   OR ("index" = 'DAX' AND date > DATE '{dax_period1_end}') THEN 2 END AS period
  FROM c3
)"""


MODEL_Y = {
    "trade_freq": ln_pos("CAST(n_trades AS DOUBLE)"),
    "quote_freq": ln_pos("CAST(n_quotes AS DOUBLE)"),
    "trade_vol": ln_pos(ddiv("X", ddiv("V", "P"))),
    "quote_vol": ln_pos("bid_size + ask_size"),
    "abs_spread": ln_pos("ask_price - bid_price"),
    "rel_spread": ln_pos("rel_spread"),
}


def long_cte(name: str, source: str, keys: list[str], relative: bool = True, where: str = "TRUE") -> str:
    """``name``: one row per (observation, model) with x and y, as ``model_long``."""
    x = ln_pos(ddiv("W", "W_star")) if relative else ln_pos("W")
    cases = " ".join(f"WHEN '{m}' THEN {e}" for m, e in MODEL_Y.items())
    models = ", ".join(f"('{m}')" for m in MODEL_Y)
    k = "".join(('"index"' if c == "index" else c) + ", " for c in keys)
    return f"""
{name} AS (
  SELECT {k}m.model, {x} AS x,
         CASE m.model {cases} END AS y
  FROM (SELECT * FROM {source} WHERE {where}) AS s CROSS JOIN (VALUES {models}) AS m(model)
)"""


def moments_sql(y: str = "y", x: str = "x") -> str:
    return (f"CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_sxx({y}, {x}) AS sxx, "
            f"regr_sxy({y}, {x}) AS sxy, regr_syy({y}, {x}) AS syy, regr_avgx({y}, {x}) AS avgx, "
            f"regr_avgy({y}, {x}) AS avgy")
