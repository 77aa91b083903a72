"""The named queries (registered into ``catalog.REGISTRY``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import daily
from ..sources import fixtures as fx
from . import oracle as O
from .catalog import register

D, S, I = True, False, False   # column kinds for rounding: double / other


def _sql(ctes: list[str], final: str, columns: list[tuple[str, bool]]) -> str:
    return O.rounded(O.with_ctes(*ctes, body=final), columns)


DAILY_TRADES_OUT = [("ticker", S), ("date", S), ("V", D), ("sigma_r", D), ("sigma_p", D), ("P", D),
                    ("N", I), ("X", D), ("Open", D), ("Close", D), ("High", D), ("Low", D)]
DAILY_QUOTES_OUT = [("ticker", S), ("date", S), ("N", I), ("sigma_s", D), ("sigma_m", D),
                    ("sigma_m_log", D), ("bid_price", D), ("bid_size", D), ("ask_price", D),
                    ("ask_size", D), ("rel_spread", D)]


@register("daily_trades", _sql([O.TICKS, O.DAILY_TRADES_CTE], "SELECT * FROM daily_trades", DAILY_TRADES_OUT))
def q_daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4 + T1/T2/F1-F3/F12: one row per ticker and day of cleaned trades."""
    return daily.daily_trades(fx.load_ticks(spark, sf_dir))


@register("daily_quotes", _sql([O.TICKS, O.DAILY_QUOTES_CTE], "SELECT * FROM daily_quotes", DAILY_QUOTES_OUT))
def q_daily_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3-A7 + T2-T5/F4/F6/F11: one row per ticker and day of valid quotes."""
    return daily.daily_quotes(fx.load_ticks(spark, sf_dir))


@register("log_midpoint_series",
          _sql([O.TICKS, O.QUOTE_ROWS_CTE], "SELECT * FROM series",
               [("ticker", S), ("date", S), ("time_us", I), ("log_midpoint", D)]))
def q_log_midpoint_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated log midpoint at every 10-second grid point inside each day."""
    return daily.sampled_series(fx.load_ticks(spark, sf_dir))


# --- container ------------------------------------------------------------------------------------

from ..operators import compare, container, models  # noqa: E402

CAPS_ROWS = [(f"{s}.{p}", f"{s}.BS", f"{s}.CHI", f"{s}.TQ", cap, i)
             for i, (s, p, cap) in enumerate(zip(fx.FIXTURE_STOCKS, fx.FIXTURE_PRIMARY, fx.FIXTURE_CAPS))]


def _container_sql(split: str) -> str:
    return O.container_cte(fx.FIXTURE_EXCLUDED, fx.FIXTURE_DAX, fx.FIXTURE_CAC, CAPS_ROWS, split, split)


LI_CTES = [O.DAILY_LINEITEM_CTE, _container_sql(fx.LINEITEM_PERIOD_SPLIT)]
EV_CTES = [O.TICKS, O.DAILY_TRADES_CTE, O.DAILY_QUOTES_CTE, O.DAILY_EVENTS_CTE,
           _container_sql(fx.FIXTURE_PERIOD_SPLIT)]

ENRICH_OUT = [("W", D), ("W_star", D), ("stock", S), ("stock_upper", S), ("venue", S), ("market", S),
              ("index", S), ("ticker_rm", S), ("large_cap", I), ("period", I)]
CONTAINER_LI_OUT = [("ticker", S), ("date", S), ("n_trades", I), ("n_quotes", I), ("V", D), ("X", D),
                    ("P", D), ("sigma_m_log", D), ("bid_price", D), ("ask_price", D), ("bid_size", D),
                    ("ask_size", D), ("rel_spread", D)] + ENRICH_OUT
CONTAINER_EV_OUT = [("ticker", S), ("date", S), ("V", D), ("sigma_r", D), ("sigma_p", D), ("P", D),
                    ("n_trades", I), ("X", D), ("Open", D), ("Close", D), ("High", D), ("Low", D),
                    ("n_quotes", I), ("sigma_s", D), ("sigma_m", D), ("sigma_m_log", D),
                    ("bid_price", D), ("bid_size", D), ("ask_price", D), ("ask_size", D),
                    ("rel_spread", D)] + ENRICH_OUT


def container_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.build_container(
        fx.load_daily_lineitem(spark, sf_dir), fx.index_members(spark), fx.market_cap(spark),
        excluded=fx.FIXTURE_EXCLUDED, cac_period2_start=fx.LINEITEM_PERIOD_SPLIT,
        dax_period1_end=fx.LINEITEM_PERIOD_SPLIT)


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fx.load_ticks(spark, sf_dir)
    return container.join_daily(daily.daily_trades(ticks), daily.daily_quotes(ticks))


def container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.build_container(
        daily_events(spark, sf_dir), fx.index_members(spark), fx.market_cap(spark),
        excluded=fx.FIXTURE_EXCLUDED, cac_period2_start=fx.FIXTURE_PERIOD_SPLIT,
        dax_period1_end=fx.FIXTURE_PERIOD_SPLIT)


def plot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample behind plots and densities: the plain daily join, without F5 and F7."""
    return container.with_activity(daily_events(spark, sf_dir))


PLOT_CTES = [O.TICKS, O.DAILY_TRADES_CTE, O.DAILY_QUOTES_CTE, O.DAILY_EVENTS_CTE,
             "container AS (SELECT *, sigma_m_log * V AS W FROM daily)"]


@register("container_events", _sql(EV_CTES, "SELECT * FROM container", CONTAINER_EV_OUT))
def q_container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily trades x quotes from ticks, enriched."""
    return container_events(spark, sf_dir).select(*[c for c, _ in CONTAINER_EV_OUT])


@register("container_lineitem", _sql(LI_CTES, "SELECT * FROM container", CONTAINER_LI_OUT))
def q_container_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container over the lineitem adapter (ticker-months), used by the regressions."""
    return container_lineitem(spark, sf_dir).select(*[c for c, _ in CONTAINER_LI_OUT])


MEANS_OUT = [("date", S), ("mean_n_trades", D), ("mean_n_quotes", D), ("mean_w", D), ("mean_ln_w", D),
             ("mean_x_over_v", D), ("mean_depth", D), ("mean_abs_spread", D), ("mean_rel_spread", D)]
MEANS_SQL = _sql([O.TICKS, O.DAILY_TRADES_CTE, O.DAILY_QUOTES_CTE, O.DAILY_EVENTS_CTE], f"""
SELECT date, avg(n_trades) AS mean_n_trades, avg(n_quotes) AS mean_n_quotes, avg(W) AS mean_w,
       avg({O.ln_pos('W')}) AS mean_ln_w, avg({O.ddiv('X', 'V')}) AS mean_x_over_v,
       avg(ask_size + bid_size) AS mean_depth, avg(ask_price - bid_price) AS mean_abs_spread,
       avg(rel_spread) AS mean_rel_spread
FROM (SELECT *, sigma_m_log * V AS W FROM daily WHERE ticker NOT IN ('{"','".join(fx.FIXTURE_EXCLUDED)}'))
GROUP BY date""", MEANS_OUT)


@register("means_over_time", MEANS_SQL)
def q_means_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-date cross-sectional means of the regression variables (after F5, no F7)."""
    return container.means_over_time(daily_events(spark, sf_dir), fx.FIXTURE_EXCLUDED)


# --- regressions ----------------------------------------------------------------------------------

FIT_OUT = [("mu", D), ("a", D), ("p", D), ("r_squared", D), ("r_adjusted", D), ("a_se", D), ("f_test_p", D)]
COEF_OUT = [("symbol", S), ("model", S)] + FIT_OUT + [("symbol_rm", S), ("index", S), ("venue", S),
                                                      ("market", S)]


def _fit(moments_query: str, df_resid: str = "n - 2", intercept: bool = True) -> str:
    from ..functions.ols import fit_sql
    from ..functions.special import DUCKDB
    return fit_sql(moments_query, DUCKDB, df_resid, intercept)


POOLED_SQL = _sql(LI_CTES + [O.long_cte("lng", "container", [])],
                  _fit(f"SELECT model, {O.moments_sql()} FROM lng GROUP BY model"),
                  [("model", S), ("n", I)] + FIT_OUT)


@register("coef_pooled", POOLED_SQL)
def q_coef_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: pooled OLS of the six models on ln(W/W*)."""
    return models.pooled(container_lineitem(spark, sf_dir))


_COEF_MOMENTS = (f"SELECT ticker AS symbol, model, {O.moments_sql()}, max(ticker_rm) AS symbol_rm, "
                 f"max(\"index\") AS \"index\", max(venue) AS venue, max(market) AS market FROM lng ")
COEF_CTES = LI_CTES + [O.long_cte("lng", "container", ["ticker", "ticker_rm", "index", "venue", "market"])]
COEF_SQL = _sql(COEF_CTES, _fit(_COEF_MOMENTS + "GROUP BY ticker, model"), COEF_OUT)
COEF_P_CTES = LI_CTES + [O.long_cte("lng", "container", ["ticker", "ticker_rm", "index", "venue", "market",
                                                         "period"], where="period IS NOT NULL")]
COEF_P_BODY = _fit(_COEF_MOMENTS.replace("SELECT ", "SELECT period, ", 1) + "GROUP BY period, ticker, model")
COEF_P_SQL = _sql(COEF_P_CTES, COEF_P_BODY, [("period", I)] + COEF_OUT)


@register("coefficient", COEF_SQL)
def q_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2/M3: OLS per ticker and model with p-values, symbol_rm, index, venue, market."""
    return models.per_ticker(container_lineitem(spark, sf_dir))


@register("coefficient_period", COEF_P_SQL)
def q_coefficient_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + F8: per-ticker OLS in period 1 and period 2 (W* from the full sample)."""
    return models.per_ticker(container_lineitem(spark, sf_dir), by_period=True)


SUMMARY_OUT = [("index", S), ("model", S), ("venue", S), ("mean_all", D), ("min_all", D), ("max_all", D),
               ("median_all", D), ("mean_significant", D), ("min_significant", D), ("max_significant", D),
               ("median_significant", D), ("p5", I), ("p1", I), ("n", I), ("r_squared", D), ("r_adjusted", D)]
_SIG = "CASE WHEN p <= 0.05 THEN a END"
SUMMARY_SQL = _sql(COEF_CTES + [f"coef AS ({_fit(_COEF_MOMENTS + 'GROUP BY ticker, model')})"], f"""
SELECT "index", model, venue, avg(a) AS mean_all, min(a) AS min_all, max(a) AS max_all, median(a) AS median_all,
       avg({_SIG}) AS mean_significant, min({_SIG}) AS min_significant, max({_SIG}) AS max_significant,
       median({_SIG}) AS median_significant, count_if(p <= 0.05) AS p5, count_if(p <= 0.01) AS p1,
       count(*) AS n, avg(r_squared) AS r_squared, avg(r_adjusted) AS r_adjusted
FROM coef WHERE "index" IS NOT NULL GROUP BY "index", model, venue HAVING count_if(p <= 0.05) > 0""", SUMMARY_OUT)


@register("slope_summary", SUMMARY_SQL)
def q_slope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope statistics by index, model and venue, all and significant."""
    return compare.slope_summary(models.per_ticker(container_lineitem(spark, sf_dir)))


def _zpivot(keys: str) -> str:
    zs = ", ".join(f"max(CASE WHEN model = '{m}' THEN z END) AS z{i}" for i, m in enumerate(O.MODEL_Y, 1))
    return f"SELECT {keys}, {zs} FROM pairs GROUP BY {keys}"


_Z = "CASE WHEN sqrt(l.a_se * l.a_se + r.a_se * r.a_se) <> 0 THEN (l.a - r.a) / sqrt(l.a_se * l.a_se + r.a_se * r.a_se) END"
Z_OUT = [(f"z{i}", D) for i in range(1, 7)]
COEF_CTE = f"coef AS ({_fit(_COEF_MOMENTS + 'GROUP BY ticker, model')})"

Z_STOCKS_SQL = _sql(COEF_CTES + [COEF_CTE, f"""
pairs AS (
  SELECT l.venue, l.model, l.symbol AS symbol1, r.symbol AS symbol2, {_Z} AS z
  FROM coef l JOIN coef r ON l.venue = r.venue AND l.model = r.model AND l.symbol < r.symbol
  WHERE l.venue IN ('DE', 'PA')
)"""], _zpivot("symbol1, symbol2, venue"), [("symbol1", S), ("symbol2", S), ("venue", S)] + Z_OUT)

Z_VENUES_SQL = _sql(COEF_CTES + [COEF_CTE, f"""
pairs AS (
  SELECT l."index", l.model, l.symbol_rm AS symbol, l.venue AS venue1, r.venue AS venue2, {_Z} AS z
  FROM coef l JOIN coef r ON l."index" = r."index" AND l.symbol_rm = r.symbol_rm AND l.model = r.model
   AND l.venue < r.venue
)"""], _zpivot('"index", symbol, venue1, venue2'),
    [("index", S), ("symbol", S), ("venue1", S), ("venue2", S)] + Z_OUT)

Z_PERIODS_SQL = _sql(COEF_P_CTES + [f"coef AS ({COEF_P_BODY})", f"""
pairs AS (
  SELECT l.venue, l.symbol_rm AS symbol, l.model, {_Z} AS z
  FROM coef l JOIN coef r ON l.venue = r.venue AND l.symbol_rm = r.symbol_rm AND l.model = r.model
  WHERE l.period = 1 AND r.period = 2 AND l.venue IN ('DE', 'PA')
)"""], _zpivot("symbol, venue"), [("symbol", S), ("venue", S)] + Z_OUT)


@register("z_between_stocks", Z_STOCKS_SQL)
def q_z_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-tests of equal slopes between stocks of a primary venue."""
    return compare.z_between_stocks(models.per_ticker(container_lineitem(spark, sf_dir)))


@register("z_between_venues", Z_VENUES_SQL)
def q_z_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-tests of equal slopes between venues of a stock."""
    return compare.z_between_venues(models.per_ticker(container_lineitem(spark, sf_dir)))


@register("z_between_periods", Z_PERIODS_SQL)
def q_z_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-tests of equal slopes between period 1 and period 2."""
    return compare.z_between_periods(models.per_ticker(container_lineitem(spark, sf_dir), by_period=True))


# --- panel ----------------------------------------------------------------------------------------

from ..functions.special import DUCKDB as _DUCKDB  # noqa: E402
from ..functions.special import apply_stages_sql as _apply_stages_sql  # noqa: E402
from ..functions.special import t_pvalue_stages as _t_pvalue_stages  # noqa: E402

PANEL_OUT = [("model", S)] + FIT_OUT + [("index", S), ("venue", S), ("panel", S)]
_PANEL_WHERE = ("venue IN ('DE', 'PA', 'BS', 'CHI', 'TQ') AND \"index\" IS NOT NULL AND NOT "
                "((\"index\" = 'DAX' AND venue = 'PA') OR (\"index\" = 'CAC' AND venue = 'DE'))")


def _panel_ctes(period: bool = False) -> list[str]:
    keys = ["venue", "index", "ticker"] + (["period"] if period else [])
    where = _PANEL_WHERE + (" AND period IS NOT NULL" if period else "")
    return LI_CTES + [O.long_cte("plong", "container", keys, relative=False, where=where)]


def _within_sql(period: bool = False) -> str:
    pk = "period, " if period else ""
    per = (f"SELECT {pk}venue, \"index\", model, ticker, CAST(regr_count(y, x) AS BIGINT) AS n_i, "
           "regr_sxx(y, x) AS sxx_i, regr_sxy(y, x) AS sxy_i, regr_syy(y, x) AS syy_i FROM plong "
           f"GROUP BY {pk}venue, \"index\", model, ticker")
    tot = (f"SELECT {pk}venue, \"index\", model, CAST(sum(n_i) AS BIGINT) AS n, sum(sxx_i) AS sxx, "
           "sum(sxy_i) AS sxy, sum(syy_i) AS syy, count_if(n_i > 0) AS groups, CAST(0 AS DOUBLE) AS avgx, "
           f"CAST(0 AS DOUBLE) AS avgy FROM ({per}) GROUP BY {pk}venue, \"index\", model")
    return f"SELECT *, 'within' AS panel FROM ({_fit(tot, 'n - groups - 1', intercept=False)})"


@register("panel_within", _sql(_panel_ctes(), _within_sql(), PANEL_OUT))
def q_panel_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-effects panel slope per venue x index and model."""
    return models.panel_within(container_lineitem(spark, sf_dir))


@register("panel_pooling", _sql(_panel_ctes(), "SELECT *, 'pooling' AS panel FROM (" + _fit(
    f"SELECT venue, \"index\", model, {O.moments_sql()} FROM plong GROUP BY venue, \"index\", model") + ")",
    PANEL_OUT))
def q_panel_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: pooled panel OLS (with intercept) per venue x index and model."""
    return models.panel_pooling(container_lineitem(spark, sf_dir))


@register("panel_between", _sql(_panel_ctes(), "SELECT *, 'between' AS panel FROM (" + _fit(
    f"SELECT venue, \"index\", model, {O.moments_sql()} FROM (SELECT venue, \"index\", model, ticker, "
    "avg(x) AS x, avg(y) AS y FROM plong WHERE x IS NOT NULL AND y IS NOT NULL "
    "GROUP BY venue, \"index\", model, ticker) GROUP BY venue, \"index\", model") + ")", PANEL_OUT))
def q_panel_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: between estimator (OLS on ticker means) per venue x index and model."""
    return models.panel_between(container_lineitem(spark, sf_dir))


# quasi-demeaned rows, least squares on them with the first regressor partialled out row by row
RANDOM_CTES = ["""
rl AS (SELECT venue, "index", model, ticker, x, y FROM plong WHERE x IS NOT NULL AND y IS NOT NULL),
rt AS (
  SELECT *, avg(x) OVER t AS xb, avg(y) OVER t AS yb, count(*) OVER t AS t_i FROM rl
  WINDOW t AS (PARTITION BY venue, "index", model, ticker)
),
rw AS (
  SELECT venue, "index", model, count(*) AS n, count(DISTINCT ticker) AS g,
         regr_syy(y - yb, x - xb) - regr_sxy(y - yb, x - xb) ** 2 / nullif(regr_sxx(y - yb, x - xb), 0) AS wrss
  FROM rt GROUP BY venue, "index", model
),
rb AS (
  SELECT venue, "index", model,
         regr_syy(yb, xb) - regr_sxy(yb, xb) ** 2 / nullif(regr_sxx(yb, xb), 0) AS brss
  FROM (SELECT DISTINCT venue, "index", model, ticker, xb, yb FROM rt) GROUP BY venue, "index", model
),
rc AS (
  SELECT rw.venue, rw."index", rw.model, n, greatest(wrss, 0) / nullif(n - g - 1, 0) AS s2e,
         greatest(greatest(brss, 0) / nullif(g - 2, 0) * n / g - greatest(wrss, 0) / nullif(n - g - 1, 0), 0)
           / (n / g) AS s2u
  FROM rw JOIN rb ON rw.venue = rb.venue AND rw."index" = rb."index" AND rw.model = rb.model
),
rq AS (
  SELECT venue, "index", model, n, q AS z1, x - xb + q * xb AS z2, y - yb + q * yb AS ys FROM (
    SELECT rt.*, n, sqrt(s2e / nullif(t_i * s2u + s2e, 0)) AS q
    FROM rt JOIN rc ON rt.venue = rc.venue AND rt."index" = rc."index" AND rt.model = rc.model)
),
ro AS (
  SELECT *, z2 - z1 * c2 AS r2, ys - z1 * cy AS ry FROM (
    SELECT *, sum(z1 * z2) OVER k / nullif(sum(z1 * z1) OVER k, 0) AS c2,
           sum(z1 * ys) OVER k / nullif(sum(z1 * z1) OVER k, 0) AS cy, avg(ys) OVER k AS ysm
    FROM rq WINDOW k AS (PARTITION BY venue, "index", model))
),
rf AS (
  SELECT *, sum(r2 * ry) OVER k / nullif(sum(r2 * r2) OVER k, 0) AS a FROM ro
  WINDOW k AS (PARTITION BY venue, "index", model)
),
rs AS (
  SELECT venue, "index", model, max(n) - 2 AS df_resid, max(a) AS a, max(cy) - max(a) * max(c2) AS mu,
         1 - sum((ry - a * r2) ** 2) / nullif(sum((ys - ysm) ** 2), 0) AS r_squared,
         sqrt(sum((ry - a * r2) ** 2) / nullif(max(n) - 2, 0) / nullif(sum(r2 * r2), 0)) AS a_se
  FROM rf GROUP BY venue, "index", model
)"""]
RANDOM_SQL = _sql(_panel_ctes() + RANDOM_CTES, "SELECT *, 1 - (1 - r_squared) * (df_resid + 1) / nullif(df_resid, 0) "
                  "AS r_adjusted, p AS f_test_p, 'random' AS panel FROM (" + _apply_stages_sql(
                      "SELECT *, a / nullif(a_se, 0) AS t_stat FROM rs",
                      _t_pvalue_stages("t_stat", "df_resid", "p", _DUCKDB)) + ")", PANEL_OUT)


@register("panel_random", RANDOM_SQL)
def q_panel_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: random-effects GLS (Swamy-Arora components) per venue x index and model."""
    return models.panel_random(container_lineitem(spark, sf_dir))


ZP_VENUES_SQL = _sql(_panel_ctes() + [f"pw AS ({_within_sql()})", f"""
pairs AS (
  SELECT l."index", l.model, l.venue AS venue1, r.venue AS venue2, {_Z} AS z
  FROM pw l JOIN pw r ON l."index" = r."index" AND l.model = r.model AND l.venue < r.venue
)"""], _zpivot('"index", venue1, venue2'), [("index", S), ("venue1", S), ("venue2", S)] + Z_OUT)

ZP_PERIODS_SQL = _sql(_panel_ctes(period=True) + [f"pw AS ({_within_sql(period=True)})", f"""
pairs AS (
  SELECT l."index", l.venue, l.model, {_Z} AS z
  FROM pw l JOIN pw r ON l."index" = r."index" AND l.venue = r.venue AND l.model = r.model
  WHERE l.period = 1 AND r.period = 2 AND l.venue IN ('DE', 'PA')
)"""], _zpivot('"index", venue'), [("index", S), ("venue", S)] + Z_OUT)


@register("z_panel_between_venues", ZP_VENUES_SQL)
def q_zp_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-tests of equal within slopes between venues of an index."""
    return compare.z_panel_between_venues(models.panel_within(container_lineitem(spark, sf_dir)))


@register("z_panel_between_periods", ZP_PERIODS_SQL)
def q_zp_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-tests of equal within slopes between period 1 and period 2."""
    return compare.z_panel_between_periods(
        models.panel_within(container_lineitem(spark, sf_dir), by_period=True))


# --- intervals ------------------------------------------------------------------------------------

from ..operators import clean as _clean, intervals  # noqa: E402


def clean_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean.trades(_clean.clean(fx.load_ticks(spark, sf_dir)))


DIST_CTES = [O.TICKS, O.DAILY_TRADES_CTE, """
bc0 AS (
  SELECT ticker, date, time_us // 60000000 AS bucket, count(*) AS n, min(seq) AS s0, max(seq) AS s1
  FROM trades GROUP BY ticker, date, time_us // 60000000
),
bc AS (
  SELECT *, arg_min(bucket, s0) OVER (PARTITION BY ticker, date) AS k_first,
            arg_max(bucket, s1) OVER (PARTITION BY ticker, date) AS k_last
  FROM bc0
),
daily_dist AS (
  SELECT ticker, date, n AS category, count(*) AS frequency FROM bc
  WHERE bucket <> k_first AND bucket <> k_last GROUP BY ticker, date, n
  UNION ALL
  SELECT ticker, date, CAST(0 AS BIGINT), CAST(greatest(greatest(max(k_last) - max(k_first) - 1, 0)
         - count_if(bucket <> k_first AND bucket <> k_last), 0) AS BIGINT)
  FROM bc GROUP BY ticker, date
),
dist AS (
  SELECT ticker, category, CAST(sum(frequency) AS BIGINT) AS frequency FROM daily_dist GROUP BY ticker, category
)"""]


@register("daily_distribution", _sql(DIST_CTES, "SELECT * FROM daily_dist",
                                     [("ticker", S), ("date", S), ("category", I), ("frequency", I)]))
def q_daily_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, interior one-minute intervals by number of trades (0 included)."""
    return intervals.daily_distribution(clean_trades(spark, sf_dir), 60)


@register("distribution", _sql(DIST_CTES, "SELECT * FROM dist",
                               [("ticker", S), ("category", I), ("frequency", I)]))
def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: trades-per-minute distribution summed over days, per ticker."""
    return intervals.distribution(clean_trades(spark, sf_dir), 60)


def _lgamma_sql(x: str) -> str:
    from ..functions.special import lgamma_sql
    return lgamma_sql(x)


POISSON_SQL = _sql(DIST_CTES + ["""
lam AS (
  SELECT ticker, CASE WHEN sum(frequency) <> 0 THEN sum(category * frequency) / sum(frequency) END AS lambda,
         sum(frequency) AS total
  FROM dist GROUP BY ticker
)"""], f"""
SELECT g.ticker, CAST(g.k AS INTEGER) AS k,
       CASE WHEN g.lambda = 0 THEN CASE WHEN g.k = 0 THEN 1.0 ELSE 0.0 END
            ELSE exp(CAST(g.k AS DOUBLE) * ln(g.lambda) - g.lambda - {_lgamma_sql('CAST(g.k AS DOUBLE) + 1')}) END AS pmf,
       CASE WHEN g.total <> 0 THEN CAST(coalesce(d.frequency, 0) AS DOUBLE) / g.total END AS share
FROM (SELECT * FROM lam, generate_series(0, 30) AS t(k)) AS g
LEFT JOIN dist d ON d.ticker = g.ticker AND d.category = g.k""", [("ticker", S), ("k", I), ("pmf", D), ("share", D)])


@register("poisson_check", POISSON_SQL)
def q_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson pmf with the empirical mean beside the observed share, k = 0..30."""
    return intervals.poisson_check(intervals.distribution(clean_trades(spark, sf_dir), 60))


HIST_SQL = _sql(DIST_CTES + ["""
h AS (
  SELECT ticker, category, frequency, lag(category) OVER w AS lo, row_number() OVER w AS rnk,
         first_value(frequency) OVER w AS first_freq, sum(frequency) OVER (PARTITION BY ticker) AS total
  FROM dist WINDOW w AS (PARTITION BY ticker ORDER BY category)
)"""], """
SELECT ticker, lo AS bin_lo, category AS bin_hi,
       CASE WHEN total * (category - lo) <> 0
            THEN CAST(frequency + CASE WHEN rnk = 2 THEN first_freq ELSE 0 END AS DOUBLE)
                 / CAST(total * (category - lo) AS DOUBLE) END AS density
FROM h WHERE lo IS NOT NULL""", [("ticker", S), ("bin_lo", I), ("bin_hi", I), ("density", D)])


@register("density_histogram", HIST_SQL)
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density histogram of trades per minute with breaks at the categories."""
    return intervals.density_histogram(intervals.distribution(clean_trades(spark, sf_dir), 60))


# --- distribution checks --------------------------------------------------------------------------

import math as _math  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from ..functions.normal import norm_ppf_sql  # noqa: E402
from ..functions.special import DUCKDB, apply_stages_sql, t_pvalue_stages  # noqa: E402
from ..operators import distrib  # noqa: E402
from ..operators import distrib as _distrib  # noqa: E402


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.sampled_series(fx.load_ticks(spark, sf_dir))


QQ_SQL = _sql([O.TICKS, O.QUOTE_ROWS_CTE, f"""
qq AS (
  SELECT ticker, date, log_midpoint AS sample,
         row_number() OVER (PARTITION BY ticker, date ORDER BY log_midpoint) AS i,
         count(*) OVER (PARTITION BY ticker, date) AS n,
         quantile_cont(log_midpoint, 0.25) OVER (PARTITION BY ticker, date) AS q1,
         quantile_cont(log_midpoint, 0.75) OVER (PARTITION BY ticker, date) AS q3
  FROM series WHERE log_midpoint IS NOT NULL
),
qq2 AS (
  SELECT *, {norm_ppf_sql('(i - 0.375e0) / (n + 0.25e0)')} AS theoretical,
         (q3 - q1) / ({norm_ppf_sql('0.75e0')} - {norm_ppf_sql('0.25e0')}) AS slope FROM qq
)"""], f"""
SELECT ticker, date, i, sample, theoretical,
       q1 - slope * {norm_ppf_sql('0.25e0')} + slope * theoretical AS line FROM qq2""",
    [("ticker", S), ("date", S), ("i", I), ("sample", D), ("theoretical", D), ("line", D)])


@register("qq_log_midpoint", QQ_SQL)
def q_qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal Q-Q points and quartile line of each day's 10-second log midpoints."""
    return distrib.qq_points(_series(spark, sf_dir), ["ticker", "date"], "log_midpoint")


# weights row by row; the normal tail by its power series alone, which is exact enough inside +-9
_PHI_SUM = DUCKDB.fold("1", "250", "{'f': CAST(zc AS DOUBLE), 's': CAST(zc AS DOUBLE)}", "acc", "j",
                       "{'f': acc.f * zc * zc / (2 * j + 1), 's': acc.s + acc.f * zc * zc / (2 * j + 1)}")


def _powers(coef: list[float], x: str) -> str:
    return "(" + " + ".join(f"({c!r}) * pow({x}, {k})" for k, c in enumerate(coef)) + ")"


SHAPIRO_SQL = _sql([O.TICKS, O.QUOTE_ROWS_CTE, f"""
sw0 AS (
  SELECT ticker, date, count(log_midpoint) AS n, min(log_midpoint) AS lo, max(log_midpoint) AS hi FROM series
  GROUP BY ticker, date
),
sw1 AS (
  SELECT s.ticker, s.date, w.n, log_midpoint AS x, avg(log_midpoint) OVER (PARTITION BY s.ticker, s.date) AS mean,
         row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY log_midpoint) AS i
  FROM series s JOIN sw0 w ON s.ticker = w.ticker AND s.date = w.date
  WHERE log_midpoint IS NOT NULL AND w.n BETWEEN 3 AND 5000 AND hi > lo
),
sw2 AS (SELECT *, least(i, n + 1 - i) AS side, {norm_ppf_sql('(i - 0.375e0) / (n + 0.25e0)')} AS m FROM sw1),
sw3 AS (
  SELECT *, sum(m * m) OVER k AS mm, sum(CASE WHEN side > (CASE WHEN n > 5 THEN 2 ELSE 1 END) THEN m * m END) OVER k AS inner_mm
  FROM sw2 WINDOW k AS (PARTITION BY ticker, date)
),
sw4 AS (
  SELECT *, abs(m) / sqrt(mm) + {_powers(distrib.SW_C1, '(1 / sqrt(n))')} AS p1,
         abs(m) / sqrt(mm) + {_powers(distrib.SW_C2, '(1 / sqrt(n))')} AS p2 FROM sw3
),
sw5 AS (
  SELECT *, CASE WHEN n = 3 THEN CASE i WHEN 1 THEN -sqrt(0.5) WHEN 2 THEN 0 ELSE sqrt(0.5) END
                 WHEN side = 1 THEN sign(m) * p1 WHEN side = 2 AND n > 5 THEN sign(m) * p2
                 ELSE m / sqrt(inner_mm / (1 - 2 * (max(CASE WHEN side = 1 THEN p1 END) OVER k) ** 2
                   - CASE WHEN n > 5 THEN 2 * (max(CASE WHEN side = 2 THEN p2 END) OVER k) ** 2 ELSE 0 END)) END AS wt
  FROM sw4 WINDOW k AS (PARTITION BY ticker, date)
),
sw6 AS (
  SELECT ticker, date, n, least(sum(wt * (x - mean)) ** 2 / (sum(wt * wt) * sum((x - mean) ** 2)), 1) AS w
  FROM sw5 GROUP BY ticker, date, n
),
sw7 AS (
  SELECT *, CASE WHEN w < 1 AND n > 11 THEN (ln(1 - w) - {_powers(distrib.SW_C5, 'ln(n)')}) / exp({_powers(distrib.SW_C6, 'ln(n)')})
                 WHEN w < 1 AND n > 3 AND ln(1 - w) < {_powers(distrib.SW_G, 'n')} THEN
                   (-ln({_powers(distrib.SW_G, 'n')} - ln(1 - w)) - {_powers(distrib.SW_C3, 'n')}) / exp({_powers(distrib.SW_C4, 'n')})
            END AS z FROM sw6
),
sw8 AS (
  SELECT *, 0.5 - exp(-0.5 * zc * zc) / sqrt(2 * pi()) * ({_PHI_SUM}).s AS tail
  FROM (SELECT *, least(greatest(z, -9), 9) AS zc FROM sw7)
)"""], """
SELECT w.ticker, w.date, w.n, t.w,
       CASE WHEN t.n = 3 THEN greatest(6 / pi() * (asin(sqrt(t.w)) - asin(sqrt(0.75))), 0)
            WHEN t.w = 1 THEN 1 WHEN t.z IS NULL THEN 0 ELSE t.tail END AS p,
       CASE WHEN w.n < 3 THEN 'fewer than 3 values' WHEN w.n > 5000 THEN 'more than 5000 values'
            WHEN NOT hi > lo THEN 'no spread' END AS reason
FROM sw0 w LEFT JOIN sw8 t ON w.ticker = t.ticker AND w.date = t.date""",
    [("ticker", S), ("date", S), ("n", I), ("w", D), ("p", D), ("reason", S)])


@register("shapiro_log_midpoint", SHAPIRO_SQL)
def q_shapiro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro-Wilk W and p of each day's 10-second log-midpoint series."""
    return distrib.shapiro_by_group(_series(spark, sf_dir), ["ticker", "date"], "log_midpoint")


def _container_vars(c: DataFrame) -> DataFrame:
    """W, ln W, N, ln N of the container in long form (variable, x)."""
    ln = lambda e: F.when(e > 0, F.log(e))
    arr = F.array(F.struct(F.lit("W").alias("variable"), F.col("W").alias("x")),
                  F.struct(F.lit("ln_W").alias("variable"), ln(F.col("W")).alias("x")),
                  F.struct(F.lit("N").alias("variable"), F.col("n_trades").cast("double").alias("x")),
                  F.struct(F.lit("ln_N").alias("variable"), ln(F.col("n_trades").cast("double")).alias("x")))
    return c.select("ticker", F.explode(arr).alias("v")).select("ticker", "v.variable", "v.x")


_CVARS = f"""
cvars AS (
  SELECT ticker, 'W' AS variable, W AS x FROM container
  UNION ALL SELECT ticker, 'ln_W', {O.ln_pos('W')} FROM container
  UNION ALL SELECT ticker, 'N', CAST(n_trades AS DOUBLE) FROM container
  UNION ALL SELECT ticker, 'ln_N', {O.ln_pos('CAST(n_trades AS DOUBLE)')} FROM container
)"""
_ISQ = f"{1.0 / _math.sqrt(2 * _math.pi):.17e}"
KDE_SQL = _sql(PLOT_CTES + [_CVARS, """
kx AS (SELECT * FROM cvars WHERE x IS NOT NULL),
st0 AS (
  SELECT ticker, variable, count(x) AS n, avg(x) AS mean, min(x) AS lo, max(x) AS hi FROM kx
  GROUP BY ticker, variable
),
st1 AS (
  SELECT st0.*, sqrt(CASE WHEN n - 1 <> 0 THEN ss / (n - 1) END) AS sd FROM st0 JOIN (
    SELECT k.ticker, k.variable, sum((k.x - s.mean) * (k.x - s.mean)) AS ss FROM kx k
    JOIN st0 s ON k.ticker = s.ticker AND k.variable = s.variable GROUP BY k.ticker, k.variable) d
  ON st0.ticker = d.ticker AND st0.variable = d.variable
),
st AS (
  SELECT * FROM (SELECT *, sd * pow(CAST(4 AS DOUBLE) / (3 * n), 0.2) AS h FROM st1)
  WHERE n >= 2 AND h > 0
),
st2 AS (SELECT *, lo - 3.0 * h AS g0, (hi - lo + 2 * 3.0 * h) / 99 AS dg FROM st),
ks AS (
  SELECT k.ticker, k.variable, t.j,
         sum(exp(-0.5 * ((s.g0 + t.j * s.dg - k.x) / s.h) * ((s.g0 + t.j * s.dg - k.x) / s.h))) AS k
  FROM kx k JOIN st2 s ON k.ticker = s.ticker AND k.variable = s.variable
  CROSS JOIN generate_series(0, 99) AS t(j)
  GROUP BY k.ticker, k.variable, t.j
),
kd AS (
  SELECT ks.ticker, ks.variable, CAST(ks.j AS INTEGER) AS j, s.g0 + ks.j * s.dg AS g, ks.k, s.n, s.h, s.sd, s.mean
  FROM ks JOIN st2 s ON ks.ticker = s.ticker AND ks.variable = s.variable
),
kr AS (
  SELECT *, exp(-0.5 * (g - mean) * (g - mean) / (sd * sd + h * h)) * """ + _ISQ + """ / sqrt(sd * sd + h * h) AS ref,
         (exp(-0.5 * 0.0 * 0.0 / (2 * h * h)) * """ + _ISQ + """ / sqrt(2 * h * h)
          * (exp(-0.5 * (g - mean) * (g - mean) / (sd * sd + h * h / 2)) * """ + _ISQ + """ / sqrt(sd * sd + h * h / 2))
          - (exp(-0.5 * (g - mean) * (g - mean) / (sd * sd + h * h)) * """ + _ISQ + """ / sqrt(sd * sd + h * h))
          * (exp(-0.5 * (g - mean) * (g - mean) / (sd * sd + h * h)) * """ + _ISQ + """ / sqrt(sd * sd + h * h))) / n AS bv
  FROM kd
)"""], f"""
SELECT ticker, variable, j, g, k * {_ISQ} / (n * h) AS density, ref AS normal,
       ref - 2 * sqrt(greatest(bv, 0)) AS normal_lo, ref + 2 * sqrt(greatest(bv, 0)) AS normal_hi FROM kr""",
    [("ticker", S), ("variable", S), ("j", I), ("g", D), ("density", D), ("normal", D), ("normal_lo", D),
     ("normal_hi", D)])


@register("kde_container", KDE_SQL)
def q_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density of W, ln W, N, ln N per ticker with the normal reference band."""
    return distrib.kde(_container_vars(plot_events(spark, sf_dir)), ["ticker", "variable"], "x")


def _loess_input(c: DataFrame) -> DataFrame:
    v = container.plot_variables(c)
    n = F.col("N").cast("double")
    ln_w = F.when(F.col("W") > 0, F.log("W"))
    relations = [("N_on_W", F.col("W"), n), ("lnN_on_lnW", ln_w, F.col("log_n")),
                 ("lnN_on_lnW_over_Wstar", F.col("log_w_over_w_star_plot"), F.col("log_n"))]
    arr = F.array(*(F.struct(F.lit(name).alias("relation"), x.alias("x"), y.alias("y")) for name, x, y in relations))
    return v.select("ticker", F.explode(arr).alias("r")).select("ticker", "r.relation", "r.x", "r.y")


_LOESS_IN = f"""
lin AS (
  SELECT ticker, 'N_on_W' AS relation, W AS x, CAST(n_trades AS DOUBLE) AS y FROM container
  UNION ALL SELECT ticker, 'lnN_on_lnW', {O.ln_pos('W')}, {O.ln_pos('CAST(n_trades AS DOUBLE)')} FROM container
  UNION ALL SELECT ticker, 'lnN_on_lnW_over_Wstar',
    {O.ddiv(O.ln_pos('W'), '(avg(W) OVER (PARTITION BY ticker))')}, {O.ln_pos('CAST(n_trades AS DOUBLE)')} FROM container
)"""
_U = "((x - (lo + j * dg)) / greatest((lo + j * dg) - lo, hi - (lo + j * dg)))"
_WT = f"(CASE WHEN abs({_U}) < 1 THEN pow(1 - abs({_U}) * abs({_U}) * abs({_U}), 3) ELSE 0.0 END)"
LOESS_SQL = _sql(PLOT_CTES + [_LOESS_IN, f"""
ld AS (SELECT * FROM lin WHERE x IS NOT NULL AND y IS NOT NULL),
lst AS (
  SELECT *, (hi - lo) / 79 AS dg FROM (
    SELECT ticker, relation, count(*) AS n, min(x) AS lo, max(x) AS hi FROM ld GROUP BY ticker, relation)
  WHERE n >= 3 AND hi > lo
),
lp AS (
  SELECT d.ticker, d.relation, t.j, d.y, s.lo, s.hi, s.dg, d.x
  FROM ld d JOIN lst s ON d.ticker = s.ticker AND d.relation = s.relation
  CROSS JOIN generate_series(0, 79) AS t(j)
),
lw AS (SELECT ticker, relation, j, y, lo, dg, {_U} AS u, {_WT} AS w FROM lp),
lm AS (
  SELECT *, u - m AS v FROM (
    SELECT *, CASE WHEN sum(w) OVER (PARTITION BY ticker, relation, j) <> 0
                   THEN sum(w * u) OVER (PARTITION BY ticker, relation, j) / sum(w) OVER (PARTITION BY ticker, relation, j)
              END AS m FROM lw)
),
ls AS (
  SELECT ticker, relation, j, max(lo) AS lo, max(dg) AS dg, max(m) AS m,
         {', '.join(f'sum(w * pow(v, {k})) AS s{k}' for k in range(5))},
         {', '.join(f'sum(w * pow(v, {k}) * y) AS t{k}' for k in range(3))}, count_if(w > 0) AS n_w
  FROM lm GROUP BY ticker, relation, j
),
lsol AS (
  SELECT *, {_distrib.LOESS_DET} AS det, {_distrib.LOESS_B0} AS b0, {_distrib.LOESS_B1} AS b1,
         {_distrib.LOESS_B2} AS b2 FROM ls
)"""], """
SELECT ticker, relation, CAST(j AS INTEGER) AS j, lo + j * dg AS g,
       CASE WHEN n_w >= 3 AND abs(det) > 1e-6 * s0 * s2 * s4 AND det <> 0
            THEN (b0 - b1 * m + b2 * m * m) / det END AS fitted
FROM lsol""", [("ticker", S), ("relation", S), ("j", I), ("g", D), ("fitted", D)])


@register("loess_container", LOESS_SQL)
def q_loess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local quadratic (span 1) curves of N on W, ln N on ln W and ln N on ln(W)/W* per ticker."""
    return distrib.loess_curve(_loess_input(plot_events(spark, sf_dir)), ["ticker", "relation"], "x", "y")


FITTED_SQL = _sql(PLOT_CTES + [f"""
fl AS (
  SELECT 'lnN_on_lnW' AS relation, ticker, date, {O.ln_pos('W')} AS x, {O.ln_pos('CAST(n_trades AS DOUBLE)')} AS y FROM container
  UNION ALL SELECT 'N_on_W', ticker, date, W, CAST(n_trades AS DOUBLE) FROM container),
fm AS ({_fit(f"SELECT relation, ticker, {O.moments_sql()} FROM fl GROUP BY relation, ticker")})"""], """
SELECT fl.relation, fl.ticker, fl.date, fl.x, fl.y, fm.mu + fm.a * fl.x AS fitted
FROM fl JOIN fm ON fl.ticker = fm.ticker AND fl.relation = fm.relation""",
    [("relation", S), ("ticker", S), ("date", S), ("x", D), ("y", D), ("fitted", D)])


@register("fitted_line", FITTED_SQL)
def q_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-ticker straight fits ln N ~ ln W and N ~ W with fitted values."""
    c = plot_events(spark, sf_dir)
    lines = [models.fitted_line(c, log=log).withColumn("relation", F.lit(name))
             for name, log in (("lnN_on_lnW", True), ("N_on_W", False))]
    return lines[0].unionByName(lines[1])


def _ttest_sql(value: str) -> str:
    base = f"""
SELECT *, CASE WHEN sqrt(sp2 * ({O.ddiv('1', 'n1')} + {O.ddiv('1', 'n0')})) <> 0
               THEN (m1 - m0) / sqrt(sp2 * ({O.ddiv('1', 'n1')} + {O.ddiv('1', 'n0')})) END AS t_stat
FROM (SELECT *, n1 + n0 - 2 AS df_resid, {O.ddiv('(n1 - 1) * v1 + (n0 - 1) * v0', 'n1 + n0 - 2')} AS sp2
      FROM (SELECT '{value}' AS variable, count_if(large_cap = 1) AS n1, count_if(large_cap = 0) AS n0,
                   avg(CASE WHEN large_cap = 1 THEN {value} END) AS m1,
                   avg(CASE WHEN large_cap = 0 THEN {value} END) AS m0,
                   var_samp(CASE WHEN large_cap = 1 THEN {value} END) AS v1,
                   var_samp(CASE WHEN large_cap = 0 THEN {value} END) AS v0
            FROM container WHERE large_cap IS NOT NULL AND {value} IS NOT NULL))"""
    staged = apply_stages_sql(base, t_pvalue_stages("t_stat", "df_resid", "p", DUCKDB))
    return f"SELECT variable, n1, n0, m1 AS mean_1, m0 AS mean_0, t_stat AS t, df_resid, p FROM ({staged})"


TTEST_OUT = [("variable", S), ("n1", I), ("n0", I), ("mean_1", D), ("mean_0", D), ("t", D),
             ("df_resid", I), ("p", D)]


@register("t_test_large_cap", _sql(LI_CTES, "(" + _ttest_sql("sigma_m_log") + ") UNION ALL (" + _ttest_sql("V") + ")",
                                   TTEST_OUT))
def q_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-variance t-tests of sigma_m_log and V between large and small caps."""
    c = container_lineitem(spark, sf_dir)
    return models.two_sample_t(c, "sigma_m_log").unionByName(models.two_sample_t(c, "V"))


PLOT_SQL = _sql(PLOT_CTES + ["""
pv AS (SELECT *, avg(W) OVER (PARTITION BY ticker) AS w_star_ticker FROM container)"""], f"""
SELECT ticker, date, W, n_trades AS N, (ask_price + bid_price) / 2 AS midpoint,
       {O.ddiv(O.ln_pos('W'), 'w_star_ticker')} AS log_w_over_w_star_plot,
       {O.ln_pos('CAST(n_trades AS DOUBLE)')} AS log_n FROM pv""",
    [("ticker", S), ("date", S), ("W", D), ("N", I), ("midpoint", D), ("log_w_over_w_star_plot", D),
     ("log_n", D)])


@register("plot_variables", PLOT_SQL)
def q_plot_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: midpoint, ln(W)/W* (W* per ticker) and ln N for every ticker-day of the plain daily join."""
    return container.plot_variables(plot_events(spark, sf_dir))


# --- sources --------------------------------------------------------------------------------------

from ..sources import day_index as _di  # noqa: E402

DAY_INDEX_SQL = _sql([O.TICKS], """
SELECT ticker, date,
       CAST(coalesce(sum(n_rows) OVER (PARTITION BY ticker ORDER BY s0
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row, n_rows
FROM (SELECT ticker, date, count(*) AS n_rows, min(seq) AS s0 FROM ticks GROUP BY ticker, date)""",
    [("ticker", S), ("date", S), ("first_row", I), ("n_rows", I)])


@register("day_index", DAY_INDEX_SQL)
def q_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row number and row count of every ticker-day in file order."""
    return _di.day_index(fx.load_ticks(spark, sf_dir))


# --- mixed model ----------------------------------------------------------------------------------

from ..operators import mixed, mixed_slope  # noqa: E402


def _reml_level(k: int) -> str:
    """Restricted likelihood of every (sample, ratio) of grid ``reml_g{k}`` and its least row ``reml_b{k}``.

    Per ticker V^-1 is I - l / (1 + n l) J, written out on sums about the sample's means.
    """
    return f"""
reml_v{k} AS (
  SELECT s.venue, s."index", s.model, lam, sum(n) AS n_obs, count(*) AS groups, max(mx) AS mx, max(my) AS my,
         sum(ln(1 + n * lam)) AS logdet, sum(n - lam / (1 + n * lam) * n * n) AS a11,
         sum(sx - lam / (1 + n * lam) * n * sx) AS a12, sum(sxx - lam / (1 + n * lam) * sx * sx) AS a22,
         sum(sy - lam / (1 + n * lam) * n * sy) AS b1, sum(sxy - lam / (1 + n * lam) * sx * sy) AS b2,
         sum(syy - lam / (1 + n * lam) * sy * sy) AS yvy
  FROM ms s JOIN reml_g{k} g ON s.venue = g.venue AND s."index" = g."index" AND s.model = g.model
  GROUP BY s.venue, s."index", s.model, lam
),
reml_d{k} AS (
  SELECT *, a11 * a22 - a12 * a12 AS det,
         yvy - (a22 * b1 * b1 - 2 * a12 * b1 * b2 + a11 * b2 * b2) / nullif(a11 * a22 - a12 * a12, 0) AS rss FROM reml_v{k}
),
reml_c{k} AS (
  SELECT *, (n_obs - 2) * ln(rss / (n_obs - 2)) + logdet + ln(det) AS crit FROM reml_d{k}
  WHERE n_obs > 2 AND rss > 0 AND det > 0 AND (groups > 1 OR lam = 0)
),
reml_b{k} AS (SELECT * FROM reml_c{k} QUALIFY row_number() OVER (PARTITION BY venue, "index", model ORDER BY crit) = 1)"""


def _reml_grid(k: int, width: float) -> str:
    centre = f"(CASE WHEN lam > 0 THEN log10(lam) ELSE {mixed.LOG10_LO!r} END)"
    return f"""
reml_g{k} AS (
  SELECT venue, "index", model, pow(10.0, {centre} - {width!r} + i * {2 * width / mixed.FINE!r}) AS lam
  FROM reml_b{k - 1}, generate_series(0, {mixed.FINE}) AS t(i)
  UNION SELECT venue, "index", model, lam FROM reml_b{k - 1}
)"""


_REML_STEP = (mixed.LOG10_HI - mixed.LOG10_LO) / mixed.COARSE
MIXED_SQL = _sql(_panel_ctes() + [f"""
mr AS (
  SELECT *, avg(x) OVER k AS mx, avg(y) OVER k AS my FROM plong WHERE x IS NOT NULL AND y IS NOT NULL
  WINDOW k AS (PARTITION BY venue, "index", model)
),
ms AS (
  SELECT venue, "index", model, ticker, max(mx) AS mx, max(my) AS my, CAST(count(*) AS DOUBLE) AS n,
         sum(x - mx) AS sx, sum(y - my) AS sy, sum((x - mx) ** 2) AS sxx, sum((x - mx) * (y - my)) AS sxy,
         sum((y - my) ** 2) AS syy FROM mr GROUP BY venue, "index", model, ticker
),
reml_g1 AS (
  SELECT venue, "index", model, CASE WHEN i < 0 THEN 0 ELSE pow(10.0, {mixed.LOG10_LO!r} + i * {_REML_STEP!r}) END AS lam
  FROM (SELECT DISTINCT venue, "index", model FROM ms), generate_series(-1, {mixed.COARSE}) AS t(i)
)""", _reml_level(1), _reml_grid(2, _REML_STEP), _reml_level(2), _reml_grid(3, 2 * _REML_STEP / mixed.FINE),
    _reml_level(3), f"""
mf AS (
  SELECT *, (a11 * b2 - a12 * b1) / det AS a, (a22 * b1 - a12 * b2) / det AS b0, rss / (n_obs - 2) AS s2e,
         CAST(n_obs - groups - 1 AS BIGINT) AS df_resid FROM reml_b3
)"""], "SELECT *, b0 + my - a * mx AS mu, sqrt(s2e) AS sigma_e, sqrt(lam * s2e) AS sigma_u, lam AS variance_ratio, "
    f"lam > 0 AND (lam <= {10.0 ** mixed.LOG10_LO * 1.01!r} OR lam >= {10.0 ** mixed.LOG10_HI * 0.99!r}) AS at_bound, "
    "CAST(n_obs AS BIGINT) AS n, crit AS reml_deviance FROM ("
    + apply_stages_sql("SELECT *, sqrt(s2e * a11 / det) AS a_se, a / nullif(sqrt(s2e * a11 / det), 0) AS t_stat FROM mf",
                       t_pvalue_stages("t_stat", "df_resid", "p", DUCKDB)) + ")",
    [("venue", S), ("index", S), ("model", S), ("mu", D), ("a", D), ("a_se", D), ("p", D), ("sigma_e", D),
     ("sigma_u", D), ("variance_ratio", D), ("at_bound", S), ("n", I), ("groups", I), ("reml_deviance", D)])


@register("mixed_random_intercept", MIXED_SQL)
def q_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: REML random-intercept model y ~ ln W + (1 | ticker) per venue x index and model."""
    return mixed.panel_random_intercept(container_lineitem(spark, sf_dir))


@register("mixed_random_slope")
def q_mixed_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: REML model ln N ~ ln W + ten covariates + (1 + ln W | ticker) per venue x index."""
    return mixed_slope.panel_random_slope(container_events(spark, sf_dir))


# --- lookups and conversions over many rows -------------------------------------------------------

from ..functions import convert  # noqa: E402

_CAP_ROWS = f"""
caps AS (
  SELECT 'S' || s_suppkey || '.DE' AS ticker_rm, 'S' || s_suppkey || '.BS' AS ticker_bs,
         'S' || s_suppkey || '.CHI' AS ticker_chi, 'S' || s_suppkey || '.TQ' AS ticker_tq,
         CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS market_capitalization, s_suppkey AS row_no
  FROM supplier
),
look AS (
  SELECT DISTINCT 'S' || (l_suppkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END) || '.' ||
         (['DE','BS','CHI','TQ'])[l_linenumber % 4 + 1] AS ticker,
         (['DE','BS','CHI','TQ'])[l_linenumber % 4 + 1] AS venue
  FROM lineitem
)"""
MARKET_CAP_SQL = _sql([_CAP_ROWS, """
med AS (SELECT median(market_capitalization) AS m FROM caps),
hit AS (
  SELECT look.ticker, look.venue, caps.ticker_rm,
         CASE WHEN market_capitalization > m THEN 'large' WHEN market_capitalization <= m THEN 'small' END AS size
  FROM look CROSS JOIN med LEFT JOIN caps
    ON look.ticker = CASE venue WHEN 'DE' THEN ticker_rm WHEN 'BS' THEN ticker_bs WHEN 'CHI' THEN ticker_chi
                     ELSE ticker_tq END
)"""], "SELECT * FROM hit", [("ticker", S), ("venue", S), ("ticker_rm", S), ("size", S)])


@register("market_cap_lookup", MARKET_CAP_SQL)
def q_market_cap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary ticker and size class of every supplier's tickers, unknown caps included."""
    key = F.col("s_suppkey")
    caps = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        *(F.concat(F.lit("S"), key, F.lit(f".{v}")).alias(f"ticker_{n}")
          for v, n in (("DE", "rm"), ("BS", "bs"), ("CHI", "chi"), ("TQ", "tq"))),
        F.when(key % 13 != 0, F.col("s_acctbal").cast("double")).alias("market_capitalization"), key.alias("row_no"))
    line = F.col("l_linenumber")
    venue = F.element_at(F.array(*map(F.lit, ("DE", "BS", "CHI", "TQ"))), (line % 4 + 1).cast("int"))
    number = F.col("l_suppkey") + F.when(line == 7, 1000000).otherwise(0)
    c = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
         .select(F.concat(F.lit("S"), number, F.lit("."), venue).alias("ticker"), venue.alias("venue")).distinct()
         .withColumn("market", F.when(F.col("venue") == "DE", "Primary").otherwise("MTF")))
    size = F.when(F.col("large_cap") == 1, "large").when(F.col("large_cap") == 0, "small")
    return container.with_market_cap(c, caps).select("ticker", "venue", "ticker_rm", size.alias("size"))


INDEX_SQL = _sql(["""
members AS (
  SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'S' ELSE 's' END || s_suppkey || 'n' AS stock,
         CASE WHEN s_suppkey % 3 = 0 THEN 'DAX' ELSE 'CAC' END AS idx
  FROM supplier WHERE s_suppkey % 3 <> 2
  UNION ALL SELECT 'S' || s_suppkey || 'N', 'DAX' FROM supplier WHERE s_suppkey % 7 = 0
),
stocks AS (SELECT DISTINCT CASE WHEN ps % 2 = 0 THEN 'S' ELSE 's' END || ps || 'n' AS stock
           FROM (SELECT l_suppkey AS ps FROM lineitem))"""], """
SELECT stock, CASE WHEN stock IN (SELECT stock FROM members WHERE idx = 'DAX')
                     OR upper(stock) IN (SELECT stock FROM members WHERE idx = 'DAX') THEN 'DAX'
                   WHEN stock IN (SELECT stock FROM members WHERE idx = 'CAC')
                     OR upper(stock) IN (SELECT stock FROM members WHERE idx = 'CAC') THEN 'CAC' END AS "index"
FROM stocks""", [("stock", S), ("index", S)])


@register("index_lookup", INDEX_SQL)
def q_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index membership of every supplier's stock code, by code or its upper case, DAX first."""
    key = F.col("s_suppkey")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    listed = supplier.where(key % 3 != 2).select(
        F.concat(F.when(key % 5 == 0, "S").otherwise("s"), key, F.lit("n")).alias("stock"),
        F.when(key % 3 == 0, "DAX").otherwise("CAC").alias("index"))
    upper = supplier.where(key % 7 == 0).select(F.concat(F.lit("S"), key, F.lit("N")).alias("stock"),
                                                F.lit("DAX").alias("index"))
    part = F.col("l_suppkey")
    stocks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.when(part % 2 == 0, "S").otherwise("s"), part, F.lit("n")).alias("stock")).distinct()
    c = stocks.withColumn("stock_upper", F.upper("stock"))
    return container.with_index(c, listed.unionByName(upper)).select("stock", "index")


CONVERSIONS_SQL = _sql(["""
raw AS (
  SELECT event_id, value, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS BIGINT) AS us FROM events
)"""], """
SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS number,
       CASE WHEN event_id % 5 = 0 THEN -1 ELSE us END AS time_us,
       CASE WHEN ceil((us % 60000000) / 1000000.0 / 10) * 10 = 60 THEN 0
            ELSE CAST(ceil((us % 60000000) / 1000000.0 / 10) * 10 AS BIGINT) END AS up,
       (us // 1000000) % 60 - (us // 1000000) % 60 % 10 AS down, us - us % 10000000 AS floored
FROM raw""", [("event_id", I), ("number", D), ("time_us", I), ("up", I), ("down", I), ("floored", I)])


@register("conversions", CONVERSIONS_SQL)
def q_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times of day through their text form (blank and bad text included), rounding."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid = F.col("event_id")
    us = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)")
    text = e.select(
        eid, us.alias("us"),
        F.when(eid % 7 == 0, "").when(eid % 11 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
        .alias("number"),
        F.when(eid % 5 == 0, "9 o'clock").otherwise(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("time"))
    minute = F.pmod(F.col("us"), F.lit(60_000_000))
    return text.select(
        eid, convert.to_number("number").alias("number"), F.coalesce(convert.time_of_day_us("time"), F.lit(-1)).alias("time_us"),
        convert.round_seconds_up(minute / 1_000_000, 10, in_range=True).alias("up"),
        convert.round_seconds_down(F.floor(minute / 1_000_000), 10).alias("down"),
        convert.floor_time_us("us", 10).alias("floored"))
