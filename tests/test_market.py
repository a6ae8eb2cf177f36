"""Indicators, joins and running totals against plain pandas on small but many-segment series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdtape.operators import asof as A
from crowdtape.operators import indicators as I
from crowdtape.operators import segments as S
from crowdtape.operators import trading as T
from crowdtape.operators.ranking import min_ranks
from crowdtape.operators.scan import running


def series(closes, symbol="A", start="2024-01-01", freq="1min"):
    c = np.asarray(closes, dtype=float)
    ts = pd.date_range(start, periods=len(c), freq=freq)
    return pd.DataFrame({"symbol": symbol, "interval": "1m", "ts": ts, "open": c, "high": c + 1, "low": c - 1, "close": c, "volume": 10.0})


@pytest.fixture(scope="module")
def hot(spark):
    """One symbol with most rows, one short one."""
    rng = np.random.default_rng(3)
    pdf = pd.concat([series(100 + np.cumsum(rng.normal(0, 1, 15000))), series([5, 6, 7, 6, 5, 4], "B")])
    return pdf, spark.createDataFrame(pdf)


SEG = {"target_rows": 5000, "bucket": "hour"}


def joined(pdf, df, cols):
    got = df.select("symbol", "ts", *cols).toPandas()
    return pdf.merge(got, on=["symbol", "ts"], suffixes=("", "_got")).sort_values(["symbol", "ts"])


def test_series_are_cut_into_segments(hot):
    n = I.segmented(hot[1], **SEG).select("symbol", S.SEG).distinct().count()
    assert n >= 4


def test_macd_and_rsi_across_segments_equal_recursion(hot):
    pdf, bars = hot
    out = joined(pdf, I.indicator_series(bars, **SEG), ["macd_line", "macd_signal", "rsi14", "sma200"])
    assert len(out) == len(pdf)
    for _, g in out.groupby("symbol"):
        c = g["close"]
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        d = c.diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        dn = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        np.testing.assert_allclose(g["macd_line"], line, rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(g["macd_signal"], line.ewm(span=9, adjust=False).mean(), rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(g["rsi14"].astype(float), 100 - 100 / (1 + up / dn), rtol=1e-8)
        np.testing.assert_allclose(g["sma200"].astype(float), c.rolling(200).mean(), rtol=1e-9)


def test_obv_carries_over_segments(hot):
    pdf, bars = hot
    out = joined(pdf, I.on_balance_volume(bars, **SEG), ["obv"])
    for _, g in out.groupby("symbol"):
        np.testing.assert_allclose(g["obv"], (np.sign(g["close"].diff().fillna(0)) * g["volume"]).cumsum())


def test_smoothing_outside_block_range_is_refused(hot):
    with pytest.raises(ValueError):
        I.ema_series(hot[1], 500)


def test_sma_small_series(spark):
    df = spark.createDataFrame(series([1, 2, 4, 7, 11]))
    got = [r[0] for r in I.with_sma(df, (3,)).orderBy("ts").select("sma3").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([7 / 3, 13 / 3, 22 / 3])


def test_constant_and_rising_series(spark):
    flat = spark.createDataFrame(series([5.0] * 30))
    row = I.trend_strength(flat).first()
    assert (row["r2"], row["direction"], row["strength"]) == (0.0, "flat", 0)
    assert I.indicator_series(flat).filter("rsi14 is not null").count() == 0
    assert I.bollinger_scan(flat).first()["pct_b"] is None
    up = spark.createDataFrame(series(range(1, 21)))
    rsi = [r[0] for r in I.indicator_series(up).orderBy("ts").select("rsi14").collect()]
    assert rsi[:14] == [None] * 14 and rsi[14:] == [100.0] * 6
    short = spark.createDataFrame(series(range(1, 20)))
    assert I.volatility_state(short).first()["status"] == "insufficient_data"


def test_lower_breakout_wins_on_the_same_bar(spark):
    df = spark.createDataFrame(series([10.0] * 25 + [1.0]))
    assert I.bollinger_scan(df).first()["last_event"] == "lower_breakout"


def test_asof_ties_and_directions(spark):
    bars = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(["2024-01-01", "2024-02-15", "2024-06-01"]), "px": [1.0, 2.0, 3.0]})
    ev = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(["2023-12-31", "2024-01-01", "2024-02-14", "2024-05-30", "2024-06-01", "2024-09-09"]), "id": range(6)})
    b, e = spark.createDataFrame(bars.rename(columns={"ts": "bts"})), spark.createDataFrame(ev)

    def run(**kw):
        return [r[0] for r in A.asof_join(e, b, ["symbol"], right_ts="bts", **kw).orderBy("id").select("asof.px").collect()]

    assert run() == [None, 1.0, 1.0, 2.0, 3.0, 3.0]
    assert run(direction="forward") == [1.0, 1.0, 2.0, 3.0, 3.0, None]
    assert run(direction="forward", strict=True) == [1.0, 2.0, 2.0, 3.0, None, None]
    assert run(strict=True) == [None, None, 1.0, 2.0, 2.0, 3.0]
    assert run(tolerance=F.expr("INTERVAL 10 DAYS")) == [None, 1.0, None, None, 3.0, None]


def test_running_totals_over_buckets(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": "x", "n": range(500), "v": rng.normal(size=500)})
    out = running(spark.createDataFrame(pdf), ["k"], F.floor(F.col("n") / 37), ["n"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).toPandas().sort_values("n")
    np.testing.assert_allclose(out["s"], pdf["v"].cumsum())
    np.testing.assert_allclose(out["m"], pdf["v"].cummax())


def test_min_ranks_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "id": range(300), "v": np.round(rng.normal(0, 50, 300))})
    out = min_ranks(spark.createDataFrame(pdf), ["g"], {"v": F.col("v")}, ["id"]).toPandas().sort_values("id")
    want = pdf.groupby("g")["v"].rank(ascending=False, method="min")
    assert out["rank_v"].tolist() == want.astype(int).tolist()


# ---- trades -------------------------------------------------------------------------------------
def brute_exit(bars, pos, side, k):
    """One bar after the other, as an account would see it."""
    long_ = side == "long"
    e, sg = bars["open"][pos], 1 if long_ else -1
    stop, target = e * (1 - sg * k["stop_loss_pct"]), e * (1 + sg * k["take_profit_pct"])
    anchor, part = e, False
    for i in range(pos, len(bars)):
        h, lo, c = bars["high"][i], bars["low"][i], bars["close"][i]
        anchor = max(anchor, c) if long_ else min(anchor, c)
        trail = anchor * (1 - sg * k["trailing_stop_pct"])
        eff = max(stop, trail) if long_ else min(stop, trail)
        level = e * (1 + sg * k["partial_take_profit_at"])
        part = part or (h >= level if long_ else lo <= level)
        rsi, line, sig, avg = (bars[n][i] for n in ("rsi14", "macd_line", "macd_signal", "sma20"))
        if pd.notna(rsi) and (rsi >= k["rsi_exit_overbought"] if long_ else rsi <= k["rsi_exit_oversold"]):
            return i, c, "rsi", part
        if (line < sig) if long_ else (line > sig):
            return i, c, "macd", part
        if pd.notna(avg) and ((c < avg) if long_ else (c > avg)):
            return i, c, "sma", part
        if (lo <= eff) if long_ else (h >= eff):
            return i, eff, "stop", part
        if (h >= target) if long_ else (lo <= target):
            return i, target, "target", part
        if i - pos + 1 >= k["time_stop_bars"]:
            return i, c, "bars", part
    return len(bars) - 1, bars["close"].iloc[-1], "end", part


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    frames = []
    for s in ("A", "B"):
        c = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 220)))
        f = series(c, s, freq="1D")
        f["open"] = c * (1 + rng.normal(0, 0.01, 220))
        f["high"], f["low"] = np.maximum(f["open"], c) * 1.02, np.minimum(f["open"], c) * 0.98
        frames.append(f)
    bars = pd.concat(frames)
    n = 240
    sig = pd.DataFrame({
        "signal_id": range(n), "symbol": rng.choice(["A", "B"], n), "interval": "1m",
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 218 * 24, n), "h"), "side": rng.choice(["long", "short"], n), "run_id": 0,
    })
    numbered = T.number_bars(spark.createDataFrame(bars)).cache()
    return numbered, spark.createDataFrame(sig), numbered.toPandas(), sig


@pytest.mark.parametrize("momentum", [True, False])
def test_exits_match_a_bar_by_bar_walk(market, momentum):
    numbered, sdf, bars, sig = market
    k = {**T.DEFAULT_RULES, "use_rsi_exit": momentum, "use_macd_exit": momentum, "use_sma_exit": momentum}
    knobs = T.rules(**{n: k[n] for n in ("use_rsi_exit", "use_macd_exit", "use_sma_exit")})
    out = T.barrier_exit(T.signal_paths(sdf, numbered, 15), knobs).toPandas().set_index("signal_id")
    walk = bars if momentum else bars.assign(rsi14=np.nan, macd_line=np.nan, macd_signal=np.nan, sma20=np.nan)
    for r in sig.itertuples():
        b = walk[walk.symbol == r.symbol].sort_values("ts").reset_index(drop=True)
        pos = int((b["ts"] <= r.ts).sum())
        i, px, why, part = brute_exit(b, pos, r.side, k)
        got = out.loc[r.signal_id]
        assert (got.exit_time, got.exit_reason, bool(got.partial)) == (b["ts"][i], why, part)
        assert got.exit_price == pytest.approx(px)


def test_one_position_equals_sequential_choice(market):
    numbered, sdf, _, _ = market
    trades = T.barrier_exit(T.signal_paths(sdf, numbered, 15), T.rules()).select("run_id", "signal_id", "symbol", "interval", "ts", "side", "entry_time", "exit_time").cache()
    got = sorted(r[0] for r in T.one_position(trades).select("signal_id").collect())
    want = []
    for _, g in trades.toPandas().groupby("symbol"):
        until = None
        for r in g.sort_values(["ts", "signal_id"]).itertuples():
            if until is None or r.ts > until:
                want.append(r.signal_id)
                until = r.exit_time
    assert got == sorted(want)


def test_account_replay_equals_loop(market, spark):
    numbered, sdf, _, _ = market
    k = T.rules(fees_per_trade=1.5)
    t = T.barrier_exit(T.signal_paths(sdf, numbered, 15), k).withColumn("ann_vol", F.lit(None).cast("double"))
    got = T.replay_account(t, k, 10000.0).toPandas().sort_values("trade_no")
    eq = 10000.0
    for r in got.itertuples():
        px = r.snap["open"]
        stop = px * (0.92 if r.side == "long" else 1.08)
        shares = eq * 0.005 / max(abs(px - stop), 0.01)
        pnl = (r.pnl_per_share - px * 0.001) * shares - 1.5
        eq += pnl
        assert r.equity_after == pytest.approx(eq) and r.pnl == pytest.approx(pnl) and r.shares == pytest.approx(shares)
    m = T.run_metrics(got_frame(spark, got), 10000.0).first()
    curve = np.concatenate([[10000.0], got["equity_after"]])
    peak = np.maximum.accumulate(curve)
    assert m["max_dd"] == pytest.approx(((peak - curve) / peak).max()) and 0 <= m["max_dd"] <= 1


def got_frame(spark, got):
    return spark.createDataFrame(got[["run_id", "trade_no", "entry_time", "exit_time", "pnl", "equity_after", "equity_before"]]).withColumns(
        {"pretrade_score": F.lit(1.0), "watchout_hit": F.lit(False)})


def test_stricter_gates_never_let_more_through(spark):
    from crowdtape.queries import trading as Q

    v = Q.verdicts(spark, "/root/testdata/sf0.001")

    def kept(x):
        d = T.decide(T.rules(gate_min_conviction=x))
        return v.select(d.alias("d")).filter("d.gated").count()

    counts = [kept(x) for x in (0.0, 40.0, 80.0)]
    assert counts == sorted(counts, reverse=True) and counts[0] > 0
