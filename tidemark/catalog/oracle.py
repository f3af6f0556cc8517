"""SQL twins of the registered queries, for a second engine on the same tables.

Written from the definitions, with plain window frames and joins; they share no code with the
DataFrame side but the parameters.
"""

from __future__ import annotations

from tidemark.catalog import fixtures as fx
from tidemark.config import LOOKBACKS, REGISTRY
from tidemark.schema import FEATURES

_SQL: dict[str, str] = {}


def _bars(table: str, series: str, ts: str, price: str, adj: str, volume: str, key: str, where: str = "") -> str:
    return f"""bars AS (
  SELECT CAST({series} AS VARCHAR) AS series_id, CAST({ts} AS DATE) AS dt,
         arg_min({price}, {key}) AS open, max({price}) AS high, min({price}) AS low,
         arg_max({price}, {key}) AS close, arg_max({adj}, {key}) AS adj_close,
         CAST(sum({volume}) AS DOUBLE) AS volume
  FROM {table} {where} GROUP BY ALL)"""


def _line(series: str, where: str = "") -> str:
    return _bars(
        "lineitem", series, "l_shipdate", "l_extendedprice", "l_extendedprice * (1 - l_discount)",
        "l_quantity", "row(l_orderkey, l_linenumber, l_partkey, l_suppkey)", where,
    )


FLAG = _line("l_returnflag")
SUPPLIER = _line("l_suppkey")
ORDERS = _bars("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_totalprice", "1.0", "o_orderkey")
W = "(PARTITION BY series_id ORDER BY dt)"
F_ALL = ", ".join(FEATURES)


def r(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({x}, {digits}) AS {name or x}"


def put(name: str, *ctes: str, select: str) -> None:
    _SQL[name] = "WITH " + ",\n".join(ctes) + "\n" + select


# --- ingest -------------------------------------------------------------------------------
_bar_cols = f"SELECT series_id, dt, open, high, low, close, {r('adj_close')}, {r('volume')} FROM bars"
put("bars_daily", FLAG, select=_bar_cols)
put("bars_by_supplier", SUPPLIER, select=_bar_cols)
put("bars_of_orders", ORDERS, select=_bar_cols)
put(
    "bars_in_range",
    _line("l_returnflag", "WHERE l_shipdate >= DATE '1996-06-01' AND l_shipdate < DATE '1999-06-01'"),
    select=_bar_cols,
)
NUMBERED = f"""numbered AS (
  SELECT *, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM bars)"""
put("bars_numbered", FLAG, NUMBERED, select="SELECT series_id, dt, close, rn, n FROM numbered")

put("checked_lines", """judged AS (SELECT l_returnflag AS flag, CASE WHEN l_orderkey % 59 = 0 THEN 'empty' WHEN l_orderkey % 47 = 0 THEN 'columns'
    WHEN l_orderkey % 41 = 0 THEN 'dt' WHEN l_orderkey % 43 = 0 THEN 'open' WHEN l_orderkey % 61 = 0 THEN 'adj_close'
    WHEN l_orderkey % 53 = 0 THEN 'range' ELSE 'accepted' END AS outcome FROM lineitem)""",
    select="SELECT flag, outcome, count(*) AS n FROM judged GROUP BY ALL")
put("upkeep_days", FLAG, select=_bar_cols)
put("upkeep_running", FLAG, select=f"""SELECT series_id, dt, close, row_number() OVER {W} AS rn, max(close) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING)
    AS running_high, sum(volume) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS running_volume FROM bars""")


# --- indicators ---------------------------------------------------------------------------
def _ma(k: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(*) OVER {frame} = {k} THEN "
        f"CAST(sum(CAST(close AS DECIMAL(18,2))) OVER {frame} AS DOUBLE) / {k} END AS ma{k}"
    )


MA = f"ma AS (SELECT *, {_ma(50)}, {_ma(200)} FROM bars)"
_HIGH = f"max(close) OVER (PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING)"
DD = f"dd AS (SELECT series_id, dt, close, {_HIGH} AS running_high FROM bars)"
for _name, _src in (("moving_averages", FLAG), ("moving_averages_by_supplier", SUPPLIER), ("moving_averages_long", FLAG)):
    put(_name, _src, MA, select="SELECT series_id, dt, close, ma50, ma200 FROM ma")
for _name, _src in (("drawdown", FLAG), ("drawdown_by_supplier", SUPPLIER), ("drawdown_long", FLAG)):
    put(_name, _src, DD, select=f"""SELECT series_id, dt, close, running_high,
      {r('(close - running_high) / nullif(running_high, 0) * 100', 6, 'drawdown')} FROM dd""")
put(
    "price_overview", FLAG, MA,
    f"o AS (SELECT *, {_HIGH} AS running_high FROM ma)",
    select=f"""SELECT series_id, dt, close, volume, ma50, ma200, running_high,
      {r('(close - running_high) / nullif(running_high, 0) * 100', 6, 'drawdown')} FROM o""",
)
LR = f"""lr AS (SELECT series_id, dt, close, CASE WHEN close / nullif(prev, 0) > 0
    THEN ln(close / nullif(prev, 0)) END AS log_return
  FROM (SELECT *, lag(close) OVER {W} AS prev FROM bars))"""
put("log_returns", FLAG, LR, select=f"SELECT series_id, dt, close, {r('log_return')} FROM lr")


def _rv(k: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(log_return) OVER {frame} = {k} "
        f"THEN stddev_samp(log_return) OVER {frame} * sqrt(252.0) * 100 END AS rvol{k}"
    )


VOL = f"vol AS (SELECT *, {_rv(30)}, {_rv(252)} FROM lr)"
for _name, _src in (("realised_vol", FLAG), ("realised_vol_by_supplier", SUPPLIER), ("realised_vol_long", FLAG)):
    put(_name, _src, LR, VOL, select=f"SELECT series_id, dt, close, {r('log_return', 4)}, {r('rvol30', 4)}, {r('rvol252', 4)} FROM vol")
put("vol_summary", SUPPLIER, LR, VOL, select=f"""SELECT series_id, {r('avg(rvol30)', 6, 'mean_vol')},
  {r('arg_max(rvol30, dt) FILTER (WHERE rvol30 IS NOT NULL)', 6, 'current_vol')} FROM vol GROUP BY series_id""")
CROSS = f"""both_ma AS (SELECT * FROM ma WHERE ma50 IS NOT NULL AND ma200 IS NOT NULL),
  seen AS (SELECT *, lag(ma50) OVER {W} AS p50, lag(ma200) OVER {W} AS p200 FROM both_ma),
  crossed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dt DESC) AS back
    FROM seen WHERE p50 < p200 AND ma50 >= ma200)"""
for _name, _src in (("golden_cross", FLAG), ("golden_cross_by_supplier", SUPPLIER), ("golden_cross_long", FLAG)):
    put(_name, _src, MA, CROSS, select="SELECT series_id, dt, close, ma50, ma200 FROM crossed WHERE back <= 2")
put("updown_volume", FLAG, select="""SELECT series_id, dt, open, close, volume,
  CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM bars""")
for _name, _src in (("close_quantile", SUPPLIER), ("close_quantile_long", FLAG)):
    put(_name, _src, select=f"""SELECT series_id, {r('quantile_cont(close, 0.7)', 6, 'close_quantile')}
      FROM bars GROUP BY series_id""")
put("row_at_fraction", SUPPLIER, NUMBERED,
    select="SELECT series_id, dt, close, rn, n FROM numbered WHERE rn = CAST(floor(n * 0.15) AS BIGINT) + 1")

# --- summaries and returns ----------------------------------------------------------------
for _name, _src in (("series_summary", SUPPLIER), ("series_summary_orders", ORDERS)):
    put(_name, _src, select="""SELECT series_id, arg_max(close, dt) AS latest_close, max(dt) AS latest_date,
      max(close) AS all_time_high, arg_min(dt, row(-close, dt)) AS all_time_high_date
      FROM bars GROUP BY series_id""")
YEARS = """years AS (SELECT series_id, CAST(year(dt) AS INTEGER) AS year, arg_min(close, dt) AS first_close,
    arg_max(close, dt) AS last_close, count(*) AS n_days FROM bars GROUP BY ALL)"""
put("ytd_return", SUPPLIER, YEARS, select=f"""SELECT series_id, year, first_close AS year_start,
  last_close AS latest_close,
  {r('coalesce((last_close - first_close) / nullif(first_close, 0) * 100, 0)', 6, 'ytd_return')}
  FROM years y WHERE year = (SELECT max(z.year) FROM years z WHERE z.series_id = y.series_id)""")


def _base(year: int, horizon: int) -> str:
    return f"""SELECT series_id, latest_close, base_close, {r('base_return')},
      {r(f'(pow(1 + base_return / 100, 1.0 / {horizon}) - 1) * 100', 6, 'annualised')}
      FROM (SELECT *, coalesce((latest_close - base_close) / nullif(base_close, 0) * 100, 0) AS base_return
        FROM (SELECT series_id, arg_max(close, dt) AS latest_close,
          arg_min(close, dt) FILTER (WHERE year(dt) = {year}) AS base_close FROM bars GROUP BY series_id))"""


put("base_year_return", SUPPLIER, select=_base(fx.BASE_YEAR, fx.BASE_HORIZON))
put("base_year_absent", FLAG, select=_base(2015, 10))
_periods = ", ".join(f"({a}, {b})" for a, b in fx.PERIODS)
put("period_returns", SUPPLIER, YEARS, select=f"""SELECT a.series_id, p.s AS start_year, p.e AS end_year,
  a.first_close AS start_close, b.last_close AS end_close,
  {r('(b.last_close - a.first_close) / nullif(a.first_close, 0) * 100', 6, 'period_return')}
  FROM (VALUES {_periods}) p(s, e) JOIN years a ON a.year = p.s
  JOIN years b ON b.year = p.e AND b.series_id = a.series_id""")
ANNUAL = """annual AS (SELECT series_id, year, n_days,
    (last_close - first_close) / nullif(first_close, 0) * 100 AS annual_return
    FROM years WHERE n_days >= 2)"""
_annual_cols = f"""SELECT series_id, year, n_days, {r('annual_return')},
  {r('abs(annual_return) / nullif(max(abs(annual_return)) OVER (PARTITION BY series_id), 0)', 6, 'magnitude')}
  FROM annual"""
put("annual_returns", SUPPLIER, YEARS, ANNUAL, select=_annual_cols)
put("annual_returns_prev_close", FLAG, YEARS, """annual AS (SELECT y.series_id, y.year, y.n_days,
    (y.last_close - z.last_close) / nullif(z.last_close, 0) * 100 AS annual_return
    FROM years y JOIN years z ON z.series_id = y.series_id AND z.year = y.year - 1
    WHERE y.n_days >= 2)""", select=_annual_cols)
put("annual_summary", SUPPLIER, YEARS, ANNUAL, select=f"""SELECT series_id,
  arg_min(year, row(-annual_return, year)) AS best_year, {r('max(annual_return)', 6, 'best_return')},
  arg_min(year, row(annual_return, year)) AS worst_year, {r('min(annual_return)', 6, 'worst_return')},
  count(*) FILTER (WHERE annual_return > 0) AS positive_years, count(*) AS n_years,
  {r('count(*) FILTER (WHERE annual_return > 0) / count(*) * 100', 6, 'hit_rate')}
  FROM annual GROUP BY series_id""")
GROWTH = f"""growth AS (SELECT series_id, dt, close,
    close / nullif(first_value(close) OVER {W}, 0) * 1000 AS portfolio,
    1000 * pow(1.06, (dt - first_value(dt) OVER {W}) / 365.25) AS risk_free FROM bars)"""
put("growth_1000", FLAG, GROWTH, select=f"SELECT series_id, dt, close, {r('portfolio')}, {r('risk_free')} FROM growth")
put("growth_summary", SUPPLIER, """ends AS (SELECT series_id, arg_min(close, dt) AS c0, arg_max(close, dt) AS c1,
    CAST(max(dt) - min(dt) AS INTEGER) AS n_days FROM bars GROUP BY series_id)""",
    """fin AS (SELECT *, c1 / nullif(c0, 0) * 1000 AS final_portfolio,
    1000 * pow(1.06, n_days / 365.25) AS final_risk_free FROM ends)""",
    select=f"""SELECT series_id, n_days, {r('final_portfolio')}, {r('final_risk_free')},
    {r('final_portfolio / final_risk_free', 6, 'outperformance')},
    {r('(pow(final_portfolio / 1000, 1.0 / nullif(n_days / 365.25, 0)) - 1) * 100', 6, 'cagr')} FROM fin""")

# --- lookup -------------------------------------------------------------------------------
_events = "events_list AS (SELECT CAST(d AS DATE) AS event_date, label FROM (VALUES " + ", ".join(
    f"('{d}', '{x}')" for d, x in fx.EVENTS) + ") v(d, label))"


def _asof(source: str, value: str, digits: int | None = None) -> str:
    out = r(value, digits) if digits else value
    return f"""SELECT series_id, event_date, label, dt, {out} FROM (
      SELECT s.series_id, e.event_date, e.label, s.dt, s.{value},
        row_number() OVER (PARTITION BY s.series_id, e.event_date ORDER BY s.dt) AS k
      FROM {source} s JOIN events_list e ON s.dt >= e.event_date) WHERE k = 1"""


put("event_asof_price", SUPPLIER, _events, select=_asof("bars", "close"))
put("event_asof_vol", FLAG, LR, VOL, _events, select=_asof("vol", "rvol30", 6))
put("event_asof_growth", FLAG, GROWTH, _events, select=_asof("growth", "portfolio", 6))
put("event_table_asof", SUPPLIER, """arrivals AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
    CAST(l_shipdate AS DATE) + 1 AS event_date, l_orderkey FROM lineitem)""",
    select="""SELECT a.series_id, a.event_date, a.l_orderkey, b.dt, b.close
    FROM arrivals a ASOF JOIN bars b ON a.series_id = b.series_id AND b.dt >= a.event_date""")
_regimes = ", ".join(
    f"('{a}', {repr(b) if b else 'NULL'}, '{x}')" for a, b, x in fx.REGIMES)
put("regime_tag", FLAG, select=f"""SELECT series_id, dt, close, g.label AS regime FROM bars
  JOIN (VALUES {_regimes}) g(a, b, label)
  ON dt >= CAST(g.a AS DATE) AND (g.b IS NULL OR dt < CAST(g.b AS DATE))""")
put("regime_table_join", FLAG, """seasons AS (SELECT CAST(min(o_orderdate) AS DATE) AS "start",
    CAST(max(o_orderdate) AS DATE) + 90 AS "end", CAST(year(o_orderdate) AS VARCHAR) AS label
    FROM orders GROUP BY year(o_orderdate))""",
    select="""SELECT series_id, dt, close, "start", "end", label FROM bars
    JOIN seasons ON dt >= "start" AND dt < "end" """)
put("kll_quantile_bounds", "ticks AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS dt FROM lineitem)", f"""levels AS (
    SELECT series_id, 'month' AS level, CAST(date_trunc('month', dt) AS DATE) AS period FROM ticks
    UNION ALL SELECT series_id, 'year', CAST(date_trunc('year', dt) AS DATE) FROM ticks UNION ALL SELECT series_id, 'all', NULL FROM ticks)""",
    select=f"""SELECT series_id, level, period, q, count(*) AS n, TRUE AS within_bound
    FROM levels CROSS JOIN (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in fx.SKETCHED)}]) AS q) GROUP BY ALL""")
put("open_intervals_by_bar", SUPPLIER, f"""spans AS (SELECT CAST(o_custkey % {fx.SPAN_SERIES} + 1 AS VARCHAR) AS series_id,
    CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INTEGER) END AS b,
    o_orderkey AS label FROM orders)""", select="""SELECT series_id, dt, count(*) AS n_open, min(label) AS first_label,
    CAST(sum(label) AS BIGINT) AS label_sum FROM bars JOIN spans USING (series_id) WHERE dt >= a AND (b IS NULL OR dt < b) GROUP BY ALL""")
_pens = ", ".join(f"(CAST({p} AS DOUBLE))" for p in fx.PENALTIES)
_feats = ", ".join(f"('{f}')" for f in fx.GRID_FEATURES)
put("param_grid", SUPPLIER, select=f"""SELECT DISTINCT series_id AS model, f AS param_feature, p AS param_penalty
  FROM bars CROSS JOIN (VALUES {_feats}) a(f) CROSS JOIN (VALUES {_pens}) b(p)""")


# --- preprocessing ------------------------------------------------------------------------
def _params(source: str) -> str:
    parts = [
        f"""SELECT series_id, '{f}' AS feature, min({f}) AS data_min, max({f}) AS data_max,
        1 / CASE WHEN max({f}) = min({f}) THEN 1.0::DOUBLE ELSE max({f}) - min({f}) END AS scale
        FROM {source} GROUP BY series_id"""
        for f in FEATURES
    ]
    return "params AS (SELECT *, -data_min * scale AS \"offset\" FROM (" + " UNION ALL ".join(parts) + "))"


_param_cols = f"""SELECT series_id, feature, {r('data_min')}, {r('data_max')}, {r('scale', 12)},
  {r('"offset"', 6, '"offset"')} FROM params"""
put("minmax_params", SUPPLIER, _params("bars"), select=_param_cols)
SPLIT = """split AS (SELECT *, CAST(round_even(n * 0.8, 0) AS BIGINT) AS split_at,
    rn <= round_even(n * 0.8, 0) AS is_train FROM numbered)"""
put("minmax_params_train", FLAG, NUMBERED, SPLIT, "tr AS (SELECT * FROM split WHERE is_train)", _params("tr"), select=_param_cols)
_scaled_cols = ", ".join(
    f"({f} * (1 / CASE WHEN hi_{f} = lo_{f} THEN 1.0::DOUBLE ELSE hi_{f} - lo_{f} END)"
    f" + -lo_{f} * (1 / CASE WHEN hi_{f} = lo_{f} THEN 1.0::DOUBLE ELSE hi_{f} - lo_{f} END)) AS {f}"
    for f in FEATURES
)
SCALED = f"""ranges AS (SELECT series_id, {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in FEATURES)}
    FROM bars GROUP BY series_id),
  scaled AS (SELECT series_id, dt, {_scaled_cols} FROM bars JOIN ranges USING (series_id))"""
put("minmax_scaled", SUPPLIER, SCALED, select="SELECT series_id, dt, " + ", ".join(r(f, 9) for f in FEATURES) + " FROM scaled")
put("minmax_roundtrip", FLAG, select="SELECT series_id, dt, " + ", ".join(r(f, 4) for f in FEATURES) + " FROM bars")
for _name, _src in (("chrono_split", SUPPLIER), ("chrono_split_long", FLAG)):
    put(_name, _src, NUMBERED, SPLIT, select="""SELECT series_id, min(dt) FILTER (WHERE NOT is_train) AS split_date,
      count(*) FILTER (WHERE is_train) AS n_train, count(*) FILTER (WHERE NOT is_train) AS n_test
      FROM split GROUP BY series_id""")


def _windows(n_in: int, n_pred: int, feats: tuple[str, ...]) -> str:
    past = f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN {n_in} PRECEDING AND 1 PRECEDING)"
    ahead = f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN CURRENT ROW AND {n_pred - 1} FOLLOWING)"
    return f"""SELECT series_id, dt, CAST(len(x) AS INTEGER) AS n_inputs, CAST(len(flat) AS INTEGER) AS n_values,
      {r('flat[1]', 6, 'x_first')}, {r('flat[len(flat)]', 6, 'x_last')},
      {r('list_sum(list_transform(flat, lambda v, i: v * i))', 6, 'x_digest')},
      {r('y[1]', 6, 'y_first')}, {r('y[len(y)]', 6, 'y_last')}, y_dt[len(y_dt)] AS last_dt
      FROM (SELECT *, flatten(x) AS flat FROM (
        SELECT series_id, dt, list([{', '.join(feats)}]) OVER {past} AS x,
          list(close) OVER {ahead} AS y, list(dt) OVER {ahead} AS y_dt FROM scaled))
      WHERE len(x) = {n_in} AND len(y) = {n_pred}"""


for _name, _src, _shape in (
    ("seq_windows", FLAG, (10, 1, FEATURES)),
    ("seq_windows_by_supplier", SUPPLIER, (15, 1, FEATURES)),
    ("seq_windows_long", FLAG, (10, 1, FEATURES)),
    ("seq_five_features", FLAG, (10, 1, FEATURES[:5])),
    ("seq_close_only", FLAG, (10, 1, ("close",))),
    ("seq_targets_2", FLAG, (7, 2, FEATURES)),
):
    put(_name, _src, SCALED, select=_windows(*_shape))
put("seq_all_shapes", FLAG, SCALED, select=" UNION ALL ".join(
    f"SELECT '{s.key}' AS spec, * FROM ({_windows(s.n_inputs, s.n_predictions, ('close',) if s.close_only else FEATURES[:s.n_features])})"
    for s in REGISTRY.values()
))
put("tail_validation", SUPPLIER, NUMBERED, """samples AS (SELECT series_id, dt,
    rn - 10 > floor((n - 10) * 0.8) AS is_validation FROM numbered WHERE rn > 10)""",
    select="""SELECT series_id, is_validation, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt
    FROM samples GROUP BY ALL""")
put("kfold_assign", SUPPLIER, NUMBERED, select=f"""SELECT series_id, dt, CAST(ntile(3) OVER {W} - 1 AS INTEGER) AS fold
  FROM numbered WHERE rn > 15""")
put("latest_window", SUPPLIER, NUMBERED, select=f"""SELECT series_id, max(dt) OVER (PARTITION BY series_id) AS dt,
  CAST(rn - (n - 7) - 1 AS INTEGER) AS pos, open, high, low, close, {r('adj_close')}, {r('volume')}
  FROM numbered WHERE rn > n - 7 AND n >= 7""")


# --- forecasts ----------------------------------------------------------------------------
def _fc(warm: bool = False) -> str:
    def x(h: int) -> str:
        if warm:
            return f"lag(close, {h}) OVER {W} AS x{h}"
        return f"CASE WHEN lag(is_train, {h}) OVER {W} = is_train THEN lag(close, {h}) OVER {W} END AS x{h}"

    arms = " UNION ALL ".join(
        f"SELECT series_id, dt, 'naive' AS model, {h} AS horizon, close AS y_true, x{h} AS y_pred FROM tests"
        f" UNION ALL SELECT series_id, dt, 'ar1', {h}, close, a{h} + b{h} * x{h} FROM tests"
        for h in (1, 2)
    )
    fits = ", ".join(
        f"regr_slope(close, x{h}) FILTER (WHERE is_train) AS b{h}, "
        f"regr_intercept(close, x{h}) FILTER (WHERE is_train) AS a{h}"
        for h in (1, 2)
    )
    return f"""pairs AS (SELECT series_id, dt, close, is_train, {x(1)}, {x(2)} FROM split),
  coef AS (SELECT series_id, {fits} FROM pairs GROUP BY series_id),
  tests AS (SELECT * FROM pairs JOIN coef USING (series_id) WHERE NOT is_train),
  fc AS (SELECT * FROM ({arms}) WHERE y_pred IS NOT NULL)"""


FC = (NUMBERED, SPLIT, _fc())
G = "series_id, model, horizon"
GW = f"(PARTITION BY {G} ORDER BY dt)"
E = "(y_true - y_pred)"
_fc_cols = f"SELECT series_id, dt, model, horizon, y_true, {r('y_pred', 4)} FROM fc"
put("forecast_one_lag", SUPPLIER, *FC, select=_fc_cols)
put("forecast_one_lag_long", FLAG, *FC, select=_fc_cols)
put("forecast_warm_start", FLAG, NUMBERED, SPLIT, _fc(True), select=_fc_cols)



def _ar(p: int) -> str:
    """Normal equations of p lags, solved by Cramer's rule on population covariances."""
    lags = ", ".join(f"lag(close, {i}) OVER {W} AS x{i}" for i in range(1, p + 1))
    train = f"FILTER (WHERE is_train AND rn > {p})"
    c = {(i, j): f"(covar_pop(x{i}, x{j}) {train})" for i in range(1, p + 1) for j in range(1, p + 1)}
    rhs = {i: f"(covar_pop(close, x{i}) {train})" for i in range(1, p + 1)}

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        minors = [[row[:j] + row[j + 1 :] for row in m[1:]] for j in range(len(m))]
        return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {det(minors[j])}" for j in range(len(m))) + ")"

    whole = [[c[i, j] for j in range(1, p + 1)] for i in range(1, p + 1)]
    swapped = lambda k: [[rhs[i] if j == k else c[i, j] for j in range(1, p + 1)] for i in range(1, p + 1)]
    fits = ", ".join(f"{det(swapped(k))} / {det(whole)} AS a{k}, avg(x{k}) {train} AS m{k}" for k in range(1, p + 1))
    pred = "m0 + " + " + ".join(f"a{k} * (x{k} - m{k})" for k in range(1, p + 1))
    return f"""lagged AS (SELECT series_id, dt, close, rn, split_at, is_train, {lags} FROM split),
  fits AS (SELECT series_id, avg(close) {train} AS m0, {fits} FROM lagged GROUP BY series_id),
  fc AS (SELECT series_id, dt, 'ar{p}' AS model, 1 AS horizon, close AS y_true, {pred} AS y_pred
    FROM lagged JOIN fits USING (series_id) WHERE rn - {p} > split_at)"""


put("ar2_forecasts", SUPPLIER, NUMBERED, SPLIT, _ar(2), select=_fc_cols)
put("ar3_forecasts", SUPPLIER, NUMBERED, SPLIT, _ar(3), select=_fc_cols)
put("ar3_forecasts_long", FLAG, NUMBERED, SPLIT, _ar(3), select=_fc_cols)

# --- evaluation ---------------------------------------------------------------------------
put("fc_metrics", SUPPLIER, *FC, select=f"""SELECT {G}, {r(f'avg({E} * {E})', 1, 'mse')},
  {r(f'sqrt(avg({E} * {E}))', 3, 'rmse')}, {r(f'avg(abs({E} / (abs(y_true) + 1e-8))) * 100', 3, 'mape')},
  count(*) AS n FROM fc GROUP BY {G}""")
put("fc_logcosh", SUPPLIER, *FC, select=f"""SELECT {G},
  {r(f'avg(abs({E}) + ln(1 + exp(-2 * abs({E}))) - ln(2))', 4, 'log_cosh')} FROM fc GROUP BY {G}""")
put("fc_residuals", SUPPLIER, *FC, select=f"""SELECT {G}, {r(f'avg({E})', 7, 'bias')},
  {r(f'stddev_pop({E})', 4, 'sigma')}, {r(f'-stddev_pop({E})', 4, 'minus_sigma')} FROM fc GROUP BY {G}""")
put("fc_residual_series", FLAG, *FC, select=f"""SELECT series_id, dt, model, horizon, y_true, {r('y_pred', 4)},
  {r(E, 4, 'residual')} FROM fc""")
put("fc_extremes", FLAG, *FC, select=f"""SELECT {G}, {r(f'max(-{E})', 4, 'max_overshoot')},
  arg_max(y_true, dt) AS last_true, {r('arg_max(y_pred, dt)', 4, 'last_pred')},
  {r(f'max(abs({E}))', 4, 'peak_error')}, {r(f'arg_max({E}, dt)', 4, 'last_error')},
  CASE WHEN arg_max({E}, dt) > 0 THEN 'under' ELSE 'over' END AS last_side,
  arg_min(dt, row(-abs({E}), dt)) AS peak_date,
  {r(f'arg_min(y_pred, row(-abs({E}), dt))', 4, 'peak_pred')} FROM fc GROUP BY {G}""")
_OFF = f"abs({E} / nullif(y_true, 0)) * 100"
put("fc_hit_bands", SUPPLIER, *FC, select=f"""SELECT {G},
  {r(f'avg(CASE WHEN {_OFF} < 1 THEN 1.0 ELSE 0.0 END) * 100', 6, 'within_1pct')},
  {r(f'avg(CASE WHEN {_OFF} < 5 THEN 1.0 ELSE 0.0 END) * 100', 6, 'within_5pct')} FROM fc GROUP BY {G}""")
put("fc_direction", SUPPLIER, *FC, f"""steps AS (SELECT {G}, y_true - lag(y_true) OVER {GW} AS dt_true,
    y_pred - lag(y_pred) OVER {GW} AS dt_pred FROM fc)""",
    select=f"""SELECT {G}, {r('avg(CASE WHEN sign(dt_true) = sign(dt_pred) THEN 1.0 ELSE 0.0 END) * 100', 6, 'directional_accuracy')}
    FROM steps WHERE dt_true IS NOT NULL GROUP BY {G}""")
_FR = f"(PARTITION BY {G} ORDER BY dt ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
ROLL = f"""roll AS (SELECT *, CASE WHEN count(*) OVER {_FR} = 30
    THEN sqrt(avg({E} * {E}) OVER {_FR}) END AS rolling_rmse FROM fc)"""
for _name in ("fc_rolling_rmse", "fc_rolling_rmse_long"):
    put(_name, FLAG, *FC, ROLL, select=f"""SELECT series_id, dt, model, horizon, y_true, {r('y_pred', 4)},
      {r('rolling_rmse', 4)} FROM roll""")
put("fc_rolling_rmse_mean", SUPPLIER, *FC, ROLL,
    select=f"SELECT {G}, {r('avg(rolling_rmse)', 4, 'mean_rolling_rmse')} FROM roll GROUP BY {G}")
put("fc_band95", SUPPLIER, *FC, f"sd AS (SELECT {G}, stddev_pop({E}) AS s FROM fc GROUP BY {G})",
    select=f"""SELECT series_id, dt, model, horizon, y_true, {r('y_pred', 4)},
    {r('y_pred - 1.96 * s', 4, 'lower')}, {r('y_pred + 1.96 * s', 4, 'upper')} FROM fc JOIN sd USING ({G})""")
put("fc_moments", SUPPLIER, *FC, select=f"""SELECT {G}, {r(f'skewness({E})', 6, 'skewness')},
  {r(f'kurtosis({E})', 6, 'kurtosis')} FROM fc GROUP BY {G}""")
put("fc_histogram", FLAG, *FC, f"ends AS (SELECT {G}, min({E}) AS lo, max({E}) AS hi FROM fc GROUP BY {G})",
    f"""counts AS (SELECT {G}, CAST(least(floor(({E} - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n
    FROM fc JOIN ends USING ({G}) GROUP BY ALL)""",
    select=f"""SELECT {G}, b.bin, {r('lo + b.bin * ((hi - lo) / 40)', 4, 'bin_start')},
    {r('lo + (b.bin + 1) * ((hi - lo) / 40)', 4, 'bin_end')}, coalesce(c.n, 0) AS n
    FROM ends CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b
    LEFT JOIN counts c USING ({G}, bin)""")
put("fc_normal_curve", FLAG, *FC, f"""fit AS (SELECT {G}, avg({E}) AS mu, stddev_pop({E}) AS sigma, count(*) AS n,
    max({E}) - min({E}) AS w FROM fc GROUP BY {G})""",
    f"""pts AS (SELECT *, mu + sigma * (-4 + point * (8.0::DOUBLE / 199)) AS x
    FROM fit CROSS JOIN (SELECT CAST(range AS INTEGER) AS point FROM range(200)))""",
    select=f"""SELECT {G}, point, {r('x', 4)},
    {r('exp(-0.5 * pow((x - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())) * n * w / 40', 6, 'density')} FROM pts""")
put("fc_corridor", FLAG, *FC, select=f"""SELECT series_id, dt, model, horizon, y_true, {r('y_pred', 4)},
  {r('y_true * 0.95', 4, '"floor"')}, {r('y_true * 1.05', 4, '"ceiling"')},
  y_pred BETWEEN y_true * 0.95 AND y_true * 1.05 AS inside FROM fc""")


def _card(source: str) -> str:
    g, p = "series_id, horizon", "(PARTITION BY series_id, horizon)"
    marks = ", ".join(
        f"{c} = min({c}) OVER {p} AS {c}_is_min, {c} = max({c}) OVER {p} AS {c}_is_max" for c in ("mse", "rmse", "mape")
    )
    return f"""raw_card AS (SELECT {g}, model, {r(f'avg({E} * {E})', 1, 'mse')}, {r(f'sqrt(avg({E} * {E}))', 1, 'rmse')},
    {r(f'avg(abs({E} / (abs(y_true) + 1e-8))) * 100', 1, 'mape')} FROM {source} GROUP BY {g}, model),
  card AS (SELECT *, CAST(floor(rank() OVER (PARTITION BY series_id, horizon ORDER BY rmse)
      + (count(*) OVER (PARTITION BY series_id, horizon, rmse) - 1) / 2.0) AS INTEGER) AS rmse_rank, {marks},
      max(rmse) OVER {p} / nullif(min(rmse) OVER {p}, 0) AS worst_over_best,
      CASE WHEN mape > 2 THEN 'trend only' ELSE 'close' END AS fit FROM raw_card)"""


_card_cols = f"""SELECT series_id, horizon, model, mse, rmse, mape, rmse_rank,
  mse_is_min, mse_is_max, rmse_is_min, rmse_is_max, mape_is_min, mape_is_max, {r('worst_over_best')}, fit FROM card"""
put("fc_scorecard", SUPPLIER, *FC, """common AS (SELECT * FROM fc WHERE (series_id, horizon, dt) IN
    (SELECT (series_id, horizon, dt) FROM fc GROUP BY series_id, horizon, dt HAVING count(DISTINCT model) = 2))""",
    _card("common"), select=_card_cols)
put("fc_scorecard_sorted", FLAG, *FC, _card("fc"), select=_card_cols + " ORDER BY mape")
put("fc_best_worst", SUPPLIER, *FC, _card("fc"), select=f"""SELECT series_id, horizon,
  arg_min(model, row(rmse, model)) AS best_model, min(rmse) AS best_rmse,
  arg_min(mape, row(rmse, model)) AS best_mape,
  arg_max(model, row(rmse, model)) AS worst_model, max(rmse) AS worst_rmse,
  arg_max(mape, row(rmse, model)) AS worst_mape,
  {r('max(rmse) / nullif(min(rmse), 0)', 6, 'worst_over_best')} FROM card GROUP BY series_id, horizon""")
put("fc_scaled_mse", SUPPLIER, *FC,
    "rng AS (SELECT series_id, 1 / (max(close) - min(close)) AS s FROM bars GROUP BY series_id)",
    select=f"""SELECT model, horizon, {r(f'avg(({E} * s) * ({E} * s))', 8, 'mse')}
    FROM fc JOIN rng USING (series_id) GROUP BY model, horizon""")

# --- training logs ------------------------------------------------------------------------
_rates = ", ".join(f"({x}::DOUBLE)" for x in fx.RATES)
LOG = f"""rng AS (SELECT series_id, min(close) AS lo, 1 / CASE WHEN max(close) = min(close) THEN 1.0::DOUBLE
      ELSE max(close) - min(close) END AS s FROM bars GROUP BY series_id),
  tp AS (SELECT series_id, rn - 1 > floor((split_at - 1) * 0.8) AS late, y,
      lag(y) OVER (PARTITION BY series_id ORDER BY dt) AS x, is_train, rn, dt
    FROM (SELECT *, close * s + -lo * s AS y FROM split JOIN rng USING (series_id))),
  st AS (SELECT series_id, {', '.join(
      f"avg({t}) FILTER (WHERE {c}) AS {p}_{k}"
      for p, c in (('t', 'NOT late'), ('v', 'late'))
      for k, t in (('x', 'x'), ('y', 'y'), ('xx', 'x * x'), ('xy', 'x * y'), ('yy', 'y * y'))
  )} FROM tp WHERE is_train AND x IS NOT NULL GROUP BY series_id),
  gd AS (SELECT series_id, rate, -1 AS epoch, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
    FROM st CROSS JOIN (VALUES {_rates}) q(rate)
    UNION ALL SELECT gd.series_id, rate, epoch + 1,
      a - rate * (2 * (a * t_xx + b * t_x - t_xy)), b - rate * (2 * (a * t_x + b - t_y))
    FROM gd JOIN st ON st.series_id = gd.series_id WHERE epoch < {fx.EPOCHS - 1}),
  log AS (SELECT series_id, 'gd_' || CAST(rate AS VARCHAR) AS model, epoch,
      t_yy - 2 * a * t_xy - 2 * b * t_y + a * a * t_xx + 2 * a * b * t_x + b * b AS loss,
      v_yy - 2 * a * v_xy - 2 * b * v_y + a * a * v_xx + 2 * a * b * v_x + b * b AS val_loss
    FROM gd JOIN st USING (series_id) WHERE epoch >= 0),
  rlog AS (SELECT series_id, model, epoch, round(loss, 7) AS loss, round(val_loss, 7) AS val_loss FROM log)"""


def put_log(name: str, source: str, *ctes: str, select: str) -> None:
    _SQL[name] = "WITH RECURSIVE " + ",\n".join((source, NUMBERED, SPLIT, LOG, *ctes)) + "\n" + select


put_log("hist_log", SUPPLIER, select=f"""SELECT series_id, model, epoch, {r('loss', 9)}, {r('loss', 9, 'mse')},
  {r('val_loss', 9)}, {r('val_loss', 9, 'val_mse')} FROM log""")
BEST = """best AS (SELECT series_id, model, count(*) AS epochs, arg_min(epoch, row(val_loss, epoch)) AS best_epoch,
    min(val_loss) AS best_loss, arg_max(val_loss - loss, epoch) AS final_gap FROM rlog GROUP BY series_id, model)"""
put_log("hist_best_epoch", SUPPLIER, BEST,
        select=f"SELECT series_id, model, epochs, best_epoch, best_loss, {r('final_gap', 9)} FROM best")
put_log("hist_overfit", FLAG, BEST, select="""SELECT series_id, model, epoch, best_epoch
  FROM rlog JOIN best USING (series_id, model) WHERE epoch > best_epoch""")
put_log("hist_converge", FLAG, """moved AS (SELECT *, abs(loss - lag(loss) OVER
    (PARTITION BY series_id, model ORDER BY epoch)) AS ch FROM rlog)""",
    "bar AS (SELECT series_id, model, quantile_cont(ch, 0.1) AS q FROM moved GROUP BY series_id, model)",
    select="""SELECT series_id, model, coalesce(min(epoch) FILTER (WHERE ch < q), 0) AS converge_epoch
    FROM moved JOIN bar USING (series_id, model) GROUP BY series_id, model""")
put_log("hist_early_stop", SUPPLIER, """mins AS (SELECT *, min(val_loss) OVER (PARTITION BY series_id, model
      ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rlog)""",
    """tracked AS (SELECT *, max(CASE WHEN m IS NULL OR val_loss < m THEN epoch END) OVER
      (PARTITION BY series_id, model ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS lb FROM mins)""",
    """ended AS (SELECT series_id, model, min(epoch) FILTER (WHERE epoch - lb >= 5) AS stop_epoch
      FROM tracked GROUP BY series_id, model)""",
    select="""SELECT series_id, model, stop_epoch, max(lb) AS kept_epoch FROM tracked JOIN ended USING (series_id, model)
      WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY series_id, model, stop_epoch""")
put_log("hist_by_model", FLAG, select=f"""SELECT series_id || '/' || m AS model, epoch, {r('loss', 9)}, {r('val_loss', 9)}
  FROM log CROSS JOIN (VALUES ('base'), ('grid')) v(m) WHERE model = 'gd_0.5'""")

# --- grid and look-back tables ------------------------------------------------------------
_xf = ", ".join(f"lag({f}) OVER {W} AS x_{f}" for f in fx.GRID_FEATURES)
_long = " UNION ALL ".join(
    f"SELECT series_id, fold, '{f}' AS param_feature, x_{f} AS x, close AS y FROM folds" for f in fx.GRID_FEATURES)
GRID = f"""gs AS (SELECT s.series_id, s.dt, s.close, rn, split_at, {', '.join(f'x_{f}' for f in fx.GRID_FEATURES)}
    FROM (SELECT *, {_xf} FROM scaled) s JOIN split p ON p.series_id = s.series_id AND p.dt = s.dt WHERE is_train),
  folds AS (SELECT *, ntile(2) OVER {W} - 1 AS fold FROM gs WHERE rn > 1),
  lng AS ({_long}),
  train_test AS (SELECT t.fold AS held, l.* FROM (VALUES (0), (1)) t(fold) CROSS JOIN lng l),
  mom AS (SELECT series_id, param_feature, held, covar_pop(y, x) AS cov, var_pop(x) AS var, avg(x) AS mx, avg(y) AS my
    FROM train_test WHERE fold <> held GROUP BY ALL),
  fit AS (SELECT *, cov / (var + p) AS a, my - cov / (var + p) * mx AS b FROM mom CROSS JOIN (VALUES {_pens}) q(p)),
  err AS (SELECT f.series_id, f.param_feature, f.p, f.held, avg(pow(l.y - (a * l.x + b), 2)) AS mse
    FROM fit f JOIN lng l ON l.series_id = f.series_id AND l.param_feature = f.param_feature AND l.fold = f.held
    GROUP BY ALL),
  scores AS (SELECT series_id AS model, param_feature, p AS param_penalty, round(-avg(mse), 9) AS mean_test_score
    FROM err GROUP BY ALL)"""


def put_grid(name: str, select: str) -> None:
    put(name, SUPPLIER, NUMBERED, SPLIT, SCALED, GRID, select=select)


put_grid("grid_scores", "SELECT * FROM scores")
put_grid("grid_best", """SELECT model, param_feature, param_penalty, mean_test_score FROM (SELECT *, row_number() OVER
  (PARTITION BY model ORDER BY -mean_test_score, param_feature, param_penalty) AS k FROM scores) WHERE k = 1""")
put_grid("grid_pivot", "SELECT model, param_penalty, " + ", ".join(
    f"-avg(mean_test_score) FILTER (WHERE param_feature = '{f}') AS \"{f}\"" for f in fx.GRID_FEATURES
) + " FROM scores GROUP BY model, param_penalty")
put_grid("grid_best_cell", f"""SELECT model, param_penalty, param_feature, -mean_test_score AS error FROM (SELECT *,
  row_number() OVER (PARTITION BY model ORDER BY -mean_test_score, param_penalty, param_feature) AS k FROM scores) WHERE k = 1""")
put_grid("grid_lift", f"SELECT model, {r('min(mean_test_score) / max(mean_test_score)', 6, 'lift')} FROM scores GROUP BY model")
put_grid("grid_by_feature", f"SELECT model, param_feature, {r('avg(mean_test_score)', 12, 'mean_score')} FROM scores GROUP BY ALL")

_past = ", ".join(
    f"""CASE WHEN rn > {k} THEN CAST(sum(CAST(close AS DECIMAL(18,2))) OVER (PARTITION BY series_id ORDER BY dt
      ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS DOUBLE) / {k} END AS past{k}""" for k in LOOKBACKS)
_arms = " UNION ALL ".join(
    f"""SELECT series_id, {k} AS inputs, past{k} AS x, close AS y,
      rn - {k} > floor((split_at - {k}) * 0.8) AS late FROM pm WHERE past{k} IS NOT NULL""" for k in LOOKBACKS)
SWEEP = f"""pm AS (SELECT *, {_past} FROM split WHERE is_train),
  sp AS ({_arms}),
  sfit AS (SELECT series_id, inputs, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM sp WHERE NOT late GROUP BY ALL),
  sweep AS (SELECT series_id, inputs, round(avg(pow(y - (a * x + b), 2)), 2) AS val_loss
    FROM sp JOIN sfit USING (series_id, inputs) WHERE late GROUP BY series_id, inputs)"""


def _ridge2(where: str) -> str:
    """Ridge of two standardised lags; the penalty is divided by the target's deviation."""
    stats = {"y": "close", "x1": "x1", "x2": "x2"}
    means = ", ".join(f"avg({v}) FILTER ({where}) AS m_{k}, stddev_pop({v}) FILTER ({where}) AS s_{k}" for k, v in stats.items())
    cov = ", ".join(f"covar_pop({a}, {b}) FILTER ({where}) AS c_{a}_{n}" for a, b, n in (("x1", "x2", "x2"), ("x1", "close", "y"), ("x2", "close", "y")))
    return f"{means}, {cov}"


_BETA = """SELECT *, (d * r1 - c * r2) / (d * d - c * c) * s_y / s_x1 AS a1, (d * r2 - c * r1) / (d * d - c * c) * s_y / s_x2 AS a2 FROM (
    SELECT *, 1 + p / s_y AS d, c_x1_x2 / (s_x1 * s_x2) AS c, c_x1_y / (s_x1 * s_y) AS r1, c_x2_y / (s_x2 * s_y) AS r2
    FROM {} CROSS JOIN (SELECT unnest([{}]) AS p))"""
_PENALTY_LIST = ", ".join(f"{p}::DOUBLE" for p in fx.GRAM_PENALTIES)
GRAM_GRID = f"""pairs AS (
    SELECT series_id, dt, rn, split_at, lo, hi, (close - lo) / (hi - lo) AS close, (lag(close, 1) OVER {W} - lo) / (hi - lo) AS x1,
      (lag(close, 2) OVER {W} - lo) / (hi - lo) AS x2
    FROM split JOIN (SELECT series_id, min(close) AS lo, max(close) AS hi FROM bars GROUP BY series_id) USING (series_id)),
  folded AS (SELECT *, ntile(2) OVER {W} AS fold FROM pairs WHERE rn > 2 AND rn <= split_at),
  moments AS (SELECT series_id, f, {_ridge2("fold <> f")} FROM folded CROSS JOIN (SELECT unnest([1, 2]) AS f) GROUP BY series_id, f),
  fits AS ({_BETA.format("moments", _PENALTY_LIST)}),
  scores AS (
    SELECT series_id, p, -avg(mse) AS score FROM (
      SELECT series_id, p, f, avg(pow(close - m_y - a1 * (x1 - m_x1) - a2 * (x2 - m_x2), 2)) AS mse
      FROM folded JOIN fits USING (series_id) WHERE fold = f GROUP BY ALL)
    GROUP BY ALL),
  cells AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, p) = 1 AS is_best FROM scores),
  refits AS ({_BETA.format(f"(SELECT series_id, {_ridge2('TRUE')} FROM folded GROUP BY series_id)", _PENALTY_LIST)})"""
put("gram_grid_scores", SUPPLIER, NUMBERED, SPLIT, GRAM_GRID,
    select=f"SELECT series_id, p AS param_reg, {r('score', 9, 'mean_test_score')}, is_best FROM cells")
put("gram_grid_refit", SUPPLIER, NUMBERED, SPLIT, GRAM_GRID, select=f"""SELECT series_id, dt, 1 AS horizon,
    {r('lo + (hi - lo) * close', 4, 'y_true')}, {r('lo + (hi - lo) * (m_y + a1 * (x1 - m_x1) + a2 * (x2 - m_x2))', 4, 'y_pred')}
  FROM pairs JOIN refits USING (series_id) JOIN cells USING (series_id, p) WHERE is_best AND rn - 2 > split_at""")


def put_sweep(name: str, select: str) -> None:
    put(name, SUPPLIER, NUMBERED, SPLIT, SWEEP, select=select)


put_sweep("sweep_scores", "SELECT series_id, inputs, val_loss FROM sweep")
put_sweep("tuner_best", f"""SELECT series_id, arg_min(inputs, row(val_loss, inputs)) AS best_inputs, min(val_loss) AS best_loss,
  arg_min(inputs, row(-val_loss, inputs)) AS worst_inputs, max(val_loss) AS worst_loss,
  {r('(max(val_loss) - min(val_loss)) / max(val_loss) * 100', 6, 'improvement')} FROM sweep GROUP BY series_id""")
_SW = "OVER (PARTITION BY series_id)"
put_sweep("tuner_norm", f"""SELECT series_id, inputs, val_loss,
  {r(f'(val_loss - min(val_loss) {_SW}) / (max(val_loss) {_SW} - min(val_loss) {_SW} + 1e-10)', 6, 'norm_loss')} FROM sweep""")
put_sweep("tuner_top_row", "SELECT series_id, inputs, val_loss FROM sweep ORDER BY val_loss, series_id, inputs LIMIT 1")



# --- tournament -----------------------------------------------------------------------------
def _rung(r: int) -> str:
    """Losses and promotions of a rung: entrants of the bracket that starts here, and whom the rung below promoted."""
    plan = fx.TOURNAMENT
    keep = "1" if r + 1 == plan.rungs else f"greatest(1, count(*) OVER (PARTITION BY series_id, bracket) // {plan.eta})"
    before = f" UNION ALL SELECT series_id, bracket, inputs, penalty FROM rung{r - 1} WHERE promoted" if r else ""
    return f"""tried{r} AS (SELECT series_id, bracket, inputs, penalty FROM (SELECT DISTINCT series_id FROM cells) CROSS JOIN entrants WHERE starts = {r}{before}),
  fits{r} AS (SELECT series_id, inputs, count(*) AS n_train, covar_pop(y, x) / var_pop(x) AS slope, avg(x) AS mx, avg(y) AS my
    FROM cells WHERE NOT late AND h < '{plan.limits()[r]}' GROUP BY ALL),
  loss{r} AS (SELECT series_id, bracket, inputs, penalty, any_value(n_train) AS n_train,
      round(avg(pow(y - my - coalesce(slope, 0) / (1 + penalty) * (x - mx), 2)), 0) AS val_loss
    FROM tried{r} JOIN fits{r} USING (series_id, inputs) JOIN cells USING (series_id, inputs) WHERE late GROUP BY ALL),
  rung{r} AS (SELECT *, {r} AS rung, round({plan.budgets()[r]!r}::DOUBLE, 9) AS budget,
      row_number() OVER (PARTITION BY series_id, bracket ORDER BY val_loss, inputs, penalty) <= {keep} AS promoted FROM loss{r})"""


def put_tournament(name: str, select: str) -> None:
    plan = fx.TOURNAMENT
    entrants = ", ".join(f"({b}, {s}, {k}, {p}::DOUBLE)" for b, s, k, p in plan.entrants())
    frame = lambda k: f"(PARTITION BY series_id ORDER BY dt ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    past = ", ".join(
        f"CASE WHEN count(*) OVER {frame(k)} = {k} THEN CAST(sum(CAST(close AS DECIMAL(18,2))) OVER {frame(k)} AS DOUBLE) / {k} END AS p{k}"
        for k in plan.sizes
    )
    cells = " UNION ALL ".join(
        f"""SELECT series_id, {k} AS inputs, close AS y, p{k} AS x, rn - {k} > floor((split_at - {k}) * 0.8::DOUBLE) AS late,
      substr(md5(series_id || '/' || CAST(dt AS VARCHAR)), 1, 8) AS h FROM wide WHERE p{k} IS NOT NULL"""
        for k in plan.sizes
    )
    whole = " UNION ALL ".join(
        f"SELECT series_id, bracket, rung, inputs, penalty, budget, n_train, val_loss, promoted FROM rung{r}" for r in range(plan.rungs)
    )
    put(
        name, SUPPLIER, NUMBERED, SPLIT, f"entrants(bracket, starts, inputs, penalty) AS (VALUES {entrants})",
        f"wide AS (SELECT series_id, dt, close, rn, split_at, {past} FROM split WHERE is_train)", f"cells AS ({cells})",
        *[_rung(r) for r in range(plan.rungs)], f"results AS ({whole})", select=select,
    )


put_tournament("tournament_rungs", "SELECT * FROM results")
put_tournament("tournament_winners", """SELECT series_id, inputs, penalty, val_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY val_loss, inputs, penalty) AS place FROM results
    WHERE promoted AND rung = (SELECT max(rung) FROM results)) WHERE place = 1""")
put_tournament("tournament_costs", """SELECT bracket, rung, count(*) AS configs, count(*) FILTER (WHERE promoted) AS promotions,
    CAST(sum(n_train) AS BIGINT) AS samples FROM results GROUP BY ALL""")


def statements() -> dict[str, str]:
    return dict(_SQL)
