"""Indicator queries over daily bars (from lineitem) and hourly bars (from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..sources import bars as B
from . import fixtures as X
from .registry import query, with_ctes


def sql(body: str, **kw) -> str:
    return with_ctes(X.CTES, body, **kw)


def r4(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def r8(df, *cols):
    """Raw prices: quantities up to 50 leave at most 7 exact decimals, so 8 cannot tie."""
    return df.withColumns({c: F.round(c, 8) for c in cols})


def big(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("t_bars_daily", "S10 T-bars", sql("""
    SELECT symbol, interval, ts, round(open,8) AS open, round(high,8) AS high, round(low,8) AS low,
           round(close,8) AS close, volume FROM bars"""))
def t_bars_daily(spark, sf):
    return r8(X.daily_bars(spark, sf), "open", "high", "low", "close")


@query("t_bars_hourly", "S10 T-bars", sql("""
    SELECT symbol, interval, bts AS ts, round(open,4) AS open, round(high,4) AS high,
           round(low,4) AS low, round(close,4) AS close, volume FROM hbars"""))
def t_bars_hourly(spark, sf):
    return r4(X.hourly_bars(spark, sf), "open", "high", "low", "close")


def _full(fn, col, n):
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {w} = {n} THEN {fn}({col}) OVER {w} END"


@query("w01_sma", "W1", sql(f"""
    SELECT symbol, ts, round({_full('avg', 'close', 20)},4) AS sma20, round({_full('avg', 'close', 50)},4) AS sma50,
           round({_full('avg', 'close', 200)},4) AS sma200 FROM bars"""))
def w01_sma(spark, sf):
    cols = ["sma20", "sma50", "sma200"]
    return r4(I.with_sma(X.daily_bars(spark, sf)), *cols).select("symbol", "ts", *cols)


@query("w02_bollinger_bands", "W2 W3", sql(f"""
    SELECT symbol, ts, round(m,4) AS bb_mid, round(s,4) AS bb_std, round(m+2*s,4) AS bb_upper, round(m-2*s,4) AS bb_lower,
           CASE WHEN m <> 0 THEN round(((m+2*s)-(m-2*s))/m,4) END AS bandwidth,
           CASE WHEN (m+2*s)-(m-2*s) <> 0 THEN round((close-(m-2*s))/((m+2*s)-(m-2*s)),4) END AS pct_b
    FROM (SELECT symbol, ts, close, {_full('avg', 'close', 20)} AS m, {_full('stddev_pop', 'close', 20)} AS s FROM bars)"""))
def w02_bollinger(spark, sf):
    cols = ["bb_mid", "bb_std", "bb_upper", "bb_lower", "bandwidth", "pct_b"]
    return r4(I.with_bollinger(X.daily_bars(spark, sf)), *cols).select("symbol", "ts", *cols)


@query("w03_bollinger_scan", "W3", sql(f"""
    SELECT symbol, '1d' AS interval, max(ts) AS "asof", count(*) AS "rows",
           arg_max(ev, ts) FILTER (WHERE ev IS NOT NULL) AS last_event,
           CAST(max(ts) FILTER (WHERE ev IS NOT NULL) AS DATE) AS last_event_date,
           round(arg_max_null(bw, ts),4) AS bandwidth, round(arg_max_null(pb, ts),4) AS pct_b
    FROM (SELECT *, CASE WHEN rn <= 30 AND close < lo THEN 'lower_breakout' WHEN rn <= 30 AND close > up THEN 'upper_breakout' END AS ev,
                 CASE WHEN m <> 0 THEN (up-lo)/m END AS bw, CASE WHEN up-lo <> 0 THEN (close-lo)/(up-lo) END AS pb
          FROM (SELECT *, m+2*s AS up, m-2*s AS lo FROM (
            SELECT *, {_full('avg', 'close', 20)} AS m, {_full('stddev_pop', 'close', 20)} AS s FROM ordbars WHERE rn <= 55)))
    GROUP BY symbol"""))
def w03_bollinger_scan(spark, sf):
    return r4(I.bollinger_scan(X.daily_bars(spark, sf)), "bandwidth", "pct_b")


def _ema_sql(alpha):
    return f"""WITH RECURSIVE e AS (
        SELECT symbol, ord, ts, close AS v FROM ordbars WHERE ord = 0
        UNION ALL
        SELECT b.symbol, b.ord, b.ts, {alpha}*b.close + (1-{alpha})*e.v FROM e JOIN ordbars b ON b.symbol = e.symbol AND b.ord = e.ord + 1)"""


@query("w04_ema", "W4", sql(_ema_sql("(2.0::DOUBLE/21)") + " SELECT symbol, ts, round(v,4) AS ema20 FROM e"))
def w04_ema(spark, sf):
    return r4(I.ema_series(X.daily_bars(spark, sf), 20), "ema20").select("symbol", "ts", "ema20")


MACD_SQL = """WITH RECURSIVE e AS (
        SELECT symbol, ord, ts, close AS f, close AS s, 0.0::DOUBLE AS g FROM ordbars WHERE ord = 0
        UNION ALL
        SELECT symbol, ord, ts, f, s, 0.2::DOUBLE*(f-s) + 0.8::DOUBLE*g AS g FROM (
          SELECT b.symbol, b.ord, b.ts, (2.0::DOUBLE/13)*b.close + (1-2.0::DOUBLE/13)*e.f AS f,
                 (2.0::DOUBLE/27)*b.close + (1-2.0::DOUBLE/27)*e.s AS s, e.g AS g
          FROM e JOIN ordbars b ON b.symbol = e.symbol AND b.ord = e.ord + 1))"""


@query("w05_macd", "W5", sql(MACD_SQL + """
    SELECT symbol, ts, round(f-s,4) AS macd_line, round(g,4) AS macd_signal, round(f-s-g,4) AS macd_hist FROM e"""))
def w05_macd(spark, sf):
    from ..operators import segments as S

    df = S.own_rows(I.add_macd(I.segmented(X.daily_bars(spark, sf))))
    cols = ["macd_line", "macd_signal", "macd_hist"]
    return r4(df, *cols).select("symbol", "ts", *cols)


RSI_SQL = """
    WITH RECURSIVE d AS (SELECT symbol, ord, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ord) AS c FROM ordbars),
    e AS (SELECT symbol, ord, ts, greatest(c,0) AS u, greatest(-c,0) AS d FROM d WHERE ord = 1
      UNION ALL SELECT x.symbol, x.ord, x.ts, greatest(x.c,0)/14.0::DOUBLE + (1-1.0::DOUBLE/14)*e.u, greatest(-x.c,0)/14.0::DOUBLE + (1-1.0::DOUBLE/14)*e.d
      FROM e JOIN d x ON x.symbol = e.symbol AND x.ord = e.ord + 1)
    SELECT b.symbol, b.ts, round(CASE WHEN e.ord < 14 THEN NULL WHEN e.d = 0 AND e.u > 0 THEN 100 WHEN e.d = 0 THEN NULL
           ELSE 100 - 100/(1 + e.u/e.d) END,4) AS rsi14 FROM ordbars b LEFT JOIN e ON e.symbol = b.symbol AND e.ord = b.ord"""


@query("w06_rsi", "W6", sql(RSI_SQL))
def w06_rsi(spark, sf):
    from ..operators import segments as S

    df = S.own_rows(I.add_rsi(I.segmented(X.daily_bars(spark, sf))))
    return r4(df, "rsi14").select("symbol", "ts", "rsi14")


@query("w07_rsi_mean_seed", "W7", sql("""
    WITH RECURSIVE d AS (SELECT symbol, ord, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ord) AS c FROM ordbars),
    s AS (SELECT *, avg(greatest(c,0)) OVER w AS u0, avg(greatest(-c,0)) OVER w AS d0 FROM d
          WINDOW w AS (PARTITION BY symbol ORDER BY ord ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
    e AS (SELECT symbol, ord, ts, u0 AS u, d0 AS d FROM s WHERE ord = 14
      UNION ALL SELECT x.symbol, x.ord, x.ts, (greatest(x.c,0) + 13*e.u)/14, (greatest(-x.c,0) + 13*e.d)/14
      FROM e JOIN d x ON x.symbol = e.symbol AND x.ord = e.ord + 1)
    SELECT b.symbol, b.ts, round(CASE WHEN e.ord IS NULL THEN NULL WHEN e.d = 0 THEN 100 ELSE 100 - 100/(1 + e.u/e.d) END,4) AS rsi14
    FROM ordbars b LEFT JOIN e ON e.symbol = b.symbol AND e.ord = b.ord"""))
def w07_rsi_mean_seed(spark, sf):
    from ..operators import segments as S

    df = S.own_rows(I.add_rsi(I.segmented(X.daily_bars(spark, sf)), seed="mean"))
    return r4(df, "rsi14").select("symbol", "ts", "rsi14")


def _mfi_sql(value):
    w = "(PARTITION BY symbol ORDER BY ord ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    return sql(f"""
    SELECT symbol, ts, round({value},4) AS mfi FROM (
      SELECT symbol, ts, ord, CASE WHEN count(*) OVER {w} = 14 THEN sum(p) OVER {w} END AS p, CASE WHEN count(*) OVER {w} = 14 THEN sum(n) OVER {w} END AS n
      FROM (SELECT symbol, ts, ord, CASE WHEN tp > q THEN tp*volume ELSE 0 END AS p, CASE WHEN tp < q THEN tp*volume ELSE 0 END AS n
            FROM (SELECT *, (high+low+close)/3.0 AS tp, lag((high+low+close)/3.0) OVER (PARTITION BY symbol ORDER BY ord) AS q FROM ordbars)))""")


@query("w08_money_flow", "W8", _mfi_sql("CASE WHEN n <> 0 THEN 100 - 100/(1+p/n) END"))
def w08_money_flow(spark, sf):
    return r4(I.money_flow(X.daily_bars(spark, sf)), "mfi").select("symbol", "ts", "mfi")


@query("w09_money_flow_capped", "W9", _mfi_sql(
    "CASE WHEN ord < 14 THEN NULL WHEN p = 0 AND n = 0 THEN 50 WHEN n = 0 THEN 100 ELSE 100 - 100/(1+p/n) END"))
def w09_money_flow_capped(spark, sf):
    return r4(I.money_flow(X.daily_bars(spark, sf), zero="cap"), "mfi").select("symbol", "ts", "mfi")


@query("w10_obv", "W10", sql("""
    SELECT symbol, ts, round(sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),4) AS obv
    FROM (SELECT symbol, ts, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)),0) * volume AS sv FROM bars)"""))
def w10_obv(spark, sf):
    return r4(I.on_balance_volume(X.daily_bars(spark, sf)), "obv").select("symbol", "ts", "obv")


@query("w11_obv_trend", "W11", sql("""
    SELECT symbol, '1d' AS interval, "asof", "rows", CASE WHEN "rows" >= 15 THEN CASE WHEN s > 0 THEN 'up' WHEN s < 0 THEN 'down' ELSE 'flat' END END AS trend,
      CASE WHEN "rows" >= 15 THEN round(s,4) END AS slope, CASE WHEN "rows" >= 15 THEN round(r,4) END AS r2, CASE WHEN "rows" >= 15 THEN 'ok' ELSE 'insufficient_data' END AS status
    FROM (SELECT symbol, max(ts) AS "asof", count(*) AS "rows", regr_slope(obv, -rn) FILTER (WHERE rn <= 30) AS s,
      CASE WHEN regr_syy(obv, -rn) FILTER (WHERE rn <= 30) > 0 THEN regr_r2(obv, -rn) FILTER (WHERE rn <= 30) ELSE 0 END AS r
      FROM (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM (
        SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)),0)*volume AS sv FROM ordbars WHERE rn <= 35))
      GROUP BY symbol)"""))
def w11_obv_trend(spark, sf):
    return r4(I.obv_trend(X.daily_bars(spark, sf)), "slope", "r2")


@query("w12_trend_strength", "W12", sql("""
    SELECT symbol, '1d' AS interval, "asof", "rows", round(r,4) AS r2, CASE WHEN p > 0 THEN 'up' WHEN p < 0 THEN 'down' WHEN p IS NOT NULL THEN 'flat' END AS direction,
      CAST(CASE WHEN "rows" < 15 THEN NULL WHEN abs(p) >= 0.30 AND r >= 0.40 THEN 3 WHEN abs(p) >= 0.15 AND r >= 0.25 THEN 2 WHEN abs(p) >= 0.05 AND r >= 0.10 THEN 1 ELSE 0 END AS BIGINT) AS strength,
      round(p,4) AS slope_pct_per_day, CASE WHEN "rows" >= 15 THEN 'ok' ELSE 'insufficient_data' END AS status
    FROM (SELECT symbol, max(ts) AS "asof", count(*) AS "rows",
      CASE WHEN count(*) >= 15 THEN (exp(regr_slope(ln(close), -rn) FILTER (WHERE rn <= 30)) - 1)*100 END AS p,
      CASE WHEN count(*) >= 15 THEN CASE WHEN regr_syy(ln(close), -rn) FILTER (WHERE rn <= 30) > 0 THEN regr_r2(ln(close), -rn) FILTER (WHERE rn <= 30) ELSE 0 END END AS r
      FROM ordbars WHERE rn <= 35 GROUP BY symbol)"""))
def w12_trend_strength(spark, sf):
    return big(r4(I.trend_strength(X.daily_bars(spark, sf)), "r2", "slope_pct_per_day"), "strength")


@query("w13_volatility_state", "W13", sql("""
    SELECT symbol, '1d' AS interval, "asof", "rows", round(c,4) AS realized_vol_pct, round(b,4) AS baseline_vol_pct, round(q,4) AS vol_ratio,
      CASE WHEN q >= 1.2 THEN 'elevated' WHEN q <= 0.8 THEN 'compressed' WHEN q IS NOT NULL THEN 'normal' END AS vol_state,
      CASE WHEN "rows" >= 50 THEN 'ok' ELSE 'insufficient_data' END AS status
    FROM (SELECT *, CASE WHEN c <> 0 AND b <> 0 THEN c/b END AS q FROM (
      SELECT symbol, max(ts) AS "asof", count(*) AS "rows",
       CASE WHEN count(*) >= 50 AND count(r) FILTER (WHERE rn <= 20) > 1 THEN stddev_pop(r) FILTER (WHERE rn <= 20) * sqrt(252)*100 END AS c,
       CASE WHEN count(*) >= 50 AND count(r) >= 80 THEN stddev_pop(r) FILTER (WHERE rn > 20 AND rn <= 80) * sqrt(252)*100 END AS b
      FROM (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM ordbars WHERE rn <= 85) GROUP BY symbol))"""))
def w13_volatility_state(spark, sf):
    return r4(I.volatility_state(X.daily_bars(spark, sf)), "realized_vol_pct", "baseline_vol_pct", "vol_ratio")


@query("w14_local_extrema", "W14", sql("""
    SELECT symbol, interval, ts, round(CASE WHEN high = hi THEN high END,8) AS resistance, round(CASE WHEN low = lo THEN low END,8) AS support
    FROM (SELECT *, count(*) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo FROM bars
          WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7 AND (high = hi OR low = lo)"""))
def w14_local_extrema(spark, sf):
    return r8(I.local_extrema(X.daily_bars(spark, sf)), "resistance", "support")


@query("w15_support_resistance", "W15", sql("""
    SELECT symbol, '1d' AS interval, "asof", round(last_close,8) AS last_close, round(s,8) AS nearest_support, round(r,8) AS nearest_resistance,
      round((last_close-s)*100/last_close,4) AS distance_to_support_pct, round((r-last_close)*100/last_close,4) AS distance_to_resistance_pct
    FROM (SELECT symbol, max(ts) AS "asof", arg_max(close, ts) AS last_close, max(CASE WHEN n=7 AND low=lo AND low<=last THEN low END) AS s,
            min(CASE WHEN n=7 AND high=hi AND high>=last THEN high END) AS r
      FROM (SELECT *, count(*) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo, first(close) OVER (PARTITION BY symbol ORDER BY rn) AS last FROM ordbars WHERE rn <= 90
          WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) GROUP BY symbol)"""))
def w15_support_resistance(spark, sf):
    df = r4(I.support_resistance(X.daily_bars(spark, sf)), "distance_to_support_pct", "distance_to_resistance_pct")
    return r8(df, "last_close", "nearest_support", "nearest_resistance")


SNAP_COLS = ["close", "rsi14", "macd_line", "macd_signal", "macd_hist", "sma20", "sma50", "sma200"]


@query("w16_indicator_snapshot", "W16", sql("""
    WITH RECURSIVE d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ord) AS c FROM ordbars),
    e AS (
      SELECT symbol, ord, close AS f, close AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS u, 0.0::DOUBLE AS dn FROM d WHERE ord = 0
      UNION ALL
      SELECT symbol, ord, f, s, 0.2::DOUBLE*(f-s)+0.8::DOUBLE*g, u, dn FROM (
        SELECT b.symbol, b.ord, (2.0::DOUBLE/13)*b.close + (1-2.0::DOUBLE/13)*e.f AS f, (2.0::DOUBLE/27)*b.close + (1-2.0::DOUBLE/27)*e.s AS s, e.g AS g,
          CASE WHEN b.ord = 1 THEN greatest(b.c,0) ELSE greatest(b.c,0)/14.0::DOUBLE + (1-1.0::DOUBLE/14)*e.u END AS u,
          CASE WHEN b.ord = 1 THEN greatest(-b.c,0) ELSE greatest(-b.c,0)/14.0::DOUBLE + (1-1.0::DOUBLE/14)*e.dn END AS dn
        FROM e JOIN d b ON b.symbol = e.symbol AND b.ord = e.ord + 1)),
    m AS (SELECT symbol, max(ts) AS "asof", arg_max(close, ts) AS close, CASE WHEN count(*) FILTER (WHERE rn<=20)=20 THEN avg(close) FILTER (WHERE rn<=20) END AS sma20,
      CASE WHEN count(*) FILTER (WHERE rn<=50)=50 THEN avg(close) FILTER (WHERE rn<=50) END AS sma50, CASE WHEN count(*) FILTER (WHERE rn<=200)=200 THEN avg(close) FILTER (WHERE rn<=200) END AS sma200,
      max(ord) AS ord FROM ordbars GROUP BY symbol)
    SELECT m.symbol, '1d' AS interval, "asof", round(close,8) AS close,
      round(CASE WHEN m.ord < 14 THEN NULL WHEN dn = 0 AND u > 0 THEN 100 WHEN dn = 0 THEN NULL ELSE 100-100/(1+u/dn) END,4) AS rsi14,
      round(f-s,4) AS macd_line, round(g,4) AS macd_signal, round(f-s-g,4) AS macd_hist, round(sma20,4) AS sma20, round(sma50,4) AS sma50, round(sma200,4) AS sma200,
      coalesce(sma50>sma200,false) AS golden_cross, coalesce(close>sma20,false) AS price_above_sma20, coalesce(close>sma50,false) AS price_above_sma50, coalesce(close>sma200,false) AS price_above_sma200
    FROM m JOIN e ON e.symbol = m.symbol AND e.ord = m.ord"""))
def w16_indicator_snapshot(spark, sf):
    return r8(r4(I.indicator_snapshot(X.daily_bars(spark, sf)), *SNAP_COLS[1:]), "close")


@query("w17_indicator_series", "W17 W1 W4 W5 W6", sql(f"""
    SELECT a.*, rsi14, macd_line, macd_signal, macd_hist
    FROM (SELECT symbol, ts, round({_full('avg', 'close', 20)},4) AS sma20, round({_full('avg', 'close', 50)},4) AS sma50, round({_full('avg', 'close', 200)},4) AS sma200 FROM bars) a
    JOIN ({MACD_SQL} SELECT symbol, ts, round(f-s,4) AS macd_line, round(g,4) AS macd_signal, round(f-s-g,4) AS macd_hist FROM e) m ON m.symbol = a.symbol AND m.ts = a.ts
    JOIN ({RSI_SQL}) r ON r.symbol = a.symbol AND r.ts = a.ts"""))
def w17_indicator_series(spark, sf):
    cols = ["sma20", "sma50", "sma200", "rsi14", "macd_line", "macd_signal", "macd_hist"]
    return r4(I.indicator_series(X.daily_bars(spark, sf)), *cols).select("symbol", "ts", *cols)


@query("w18_atr", "W18", sql("""
    SELECT symbol, ts, round(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END,4) AS atr FROM (
      SELECT symbol, ts, CASE WHEN p IS NOT NULL THEN greatest(high-low, abs(high-p), abs(low-p)) END AS tr
      FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars))
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""))
def w18_atr(spark, sf):
    return r4(I.true_range_average(X.daily_bars(spark, sf)), "atr").select("symbol", "ts", "atr")


@query("w19_returns", "W19", sql("""
    SELECT symbol, ts, round(r*100,4) AS ret1d_pct, round((close/p5-1)*100,4) AS ret5d_pct,
      round(CASE WHEN count(r) OVER w >= 20 THEN stddev_pop(r) OVER w * 100 END,4) AS ret_std_pct
    FROM (SELECT symbol, ts, close, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS r, lag(close,5) OVER (PARTITION BY symbol ORDER BY ts) AS p5 FROM bars)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))
def w19_returns(spark, sf):
    cols = ["ret1d_pct", "ret5d_pct", "ret_std_pct"]
    return r4(I.returns(X.daily_bars(spark, sf)), *cols).select("symbol", "ts", *cols)


@query("w20_window_returns", "W20", sql("""
    SELECT symbol, '1d' AS interval, round(lc,8) AS last_close, round(CASE WHEN v <> 0 THEN v*lc END,4) AS adv_value, round(lc/c63-1,4) AS ret_63, round(lc/c126-1,4) AS ret_126, round(lc/c252-1,4) AS ret_252
    FROM (SELECT symbol, max(CASE WHEN rn=1 THEN close END) AS lc, CASE WHEN count(*) FILTER (WHERE rn<=20) = 20 THEN avg(volume) FILTER (WHERE rn<=20) END AS v,
      max(CASE WHEN rn=64 THEN close END) AS c63, max(CASE WHEN rn=127 THEN close END) AS c126, max(CASE WHEN rn=253 THEN close END) AS c252 FROM ordbars GROUP BY symbol)"""))
def w20_window_returns(spark, sf):
    return r8(r4(I.window_returns(X.daily_bars(spark, sf)), "adv_value", "ret_63", "ret_126", "ret_252"), "last_close")


@query("w21_annual_volatility", "W21", sql("""
    SELECT symbol, '1d' AS interval, round(stddev_pop(r)*sqrt(252),4) AS ann_vol FROM (
      SELECT symbol, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS r FROM bars) GROUP BY symbol"""))
def w21_annual_volatility(spark, sf):
    return r4(I.annual_volatility(X.daily_bars(spark, sf)), "ann_vol")


@query("a29_window_change", "A29 W31", sql("""
    SELECT symbol, interval, round(arg_min(close, ts),8) AS first_close, round(arg_max(close, ts),8) AS last_close, count(*) AS "rows",
      CASE WHEN count(*) >= 2 THEN round((arg_max(close,ts)-arg_min(close,ts))*100/arg_min(close,ts),4) END AS change_pct FROM bars GROUP BY symbol, interval"""))
def a29_window_change(spark, sf):
    return r8(r4(I.window_change(X.daily_bars(spark, sf)), "change_pct"), "first_close", "last_close")


@query("c01_technical_snapshot", "C1 W3 W8 W11 W12 W13 W15 W16 W19", sql("""
    WITH t AS (SELECT symbol, CASE WHEN count(*) >= 15 THEN (exp(regr_slope(ln(close), -rn)) - 1)*100 END AS p, CASE WHEN count(*) >= 15 THEN CASE WHEN regr_syy(ln(close), -rn) > 0 THEN regr_r2(ln(close), -rn) ELSE 0 END END AS r FROM ordbars WHERE rn <= 30 GROUP BY symbol),
    v AS (SELECT symbol, CASE WHEN count(*) >= 50 THEN stddev_pop(r) FILTER (WHERE rn <= 20)*sqrt(252)*100 END AS c, CASE WHEN count(*) >= 50 AND count(r) >= 80 THEN stddev_pop(r) FILTER (WHERE rn > 20 AND rn <= 80)*sqrt(252)*100 END AS b
          FROM (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM ordbars WHERE rn <= 85) GROUP BY symbol),
    s AS (SELECT symbol, max(CASE WHEN n=7 AND low=lo AND low<=last THEN low END) AS sup, min(CASE WHEN n=7 AND high=hi AND high>=last THEN high END) AS res FROM (
          SELECT *, count(*) OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo, first(close) OVER (PARTITION BY symbol ORDER BY rn) AS last FROM ordbars WHERE rn <= 90
          WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) GROUP BY symbol),
    m AS (SELECT symbol, max(ts) AS last_ts, arg_max(close, ts) AS close, CASE WHEN count(*) FILTER (WHERE rn<=20)=20 THEN avg(close) FILTER (WHERE rn<=20) END AS sma20, CASE WHEN count(*) FILTER (WHERE rn<=50)=50 THEN avg(close) FILTER (WHERE rn<=50) END AS sma50,
          CASE WHEN count(*) FILTER (WHERE rn<=200)=200 THEN avg(close) FILTER (WHERE rn<=200) END AS sma200 FROM ordbars GROUP BY symbol)
    SELECT m.symbol, last_ts AS "asof", round(close,8) AS close, round(sma20,4) AS sma20, round(sma50,4) AS sma50, round(sma200,4) AS sma200, coalesce(sma50 > sma200, false) AS golden_cross,
      CASE WHEN p > 0 THEN 'up' WHEN p < 0 THEN 'down' WHEN p IS NOT NULL THEN 'flat' END AS trend_direction, round(p,4) AS slope_pct_per_day, round(r,4) AS trend_r2,
      round(c,4) AS realized_vol_pct, round(CASE WHEN c <> 0 AND b <> 0 THEN c/b END,4) AS vol_ratio, round(sup,8) AS nearest_support, round(res,8) AS nearest_resistance
    FROM m JOIN t USING (symbol) JOIN v USING (symbol) JOIN s USING (symbol)"""))
def c01_technical_snapshot(spark, sf):
    from ..plans.snapshot import technical_snapshot

    df = technical_snapshot(X.daily_bars(spark, sf))
    df = r4(df, "sma20", "sma50", "sma200", "slope_pct_per_day", "trend_r2", "realized_vol_pct", "vol_ratio")
    return r8(df, "close", "nearest_support", "nearest_resistance").select(
        "symbol", "asof", "close", "sma20", "sma50", "sma200", "golden_cross", "trend_direction", "slope_pct_per_day",
        "trend_r2", "realized_vol_pct", "vol_ratio", "nearest_support", "nearest_resistance")


@query("c01_snapshot_all_tools", "C1 W3 W8 W11 W19")
def c01_all(spark, sf):
    from ..plans.snapshot import technical_snapshot

    return technical_snapshot(X.daily_bars(spark, sf))
