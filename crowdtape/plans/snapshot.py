"""One row per symbol with everything the technical tools report at its last bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import indicators as I
from ..operators import segments as S
from ..session import stored


#: Bars before a look-back that averages need: the longest moving average and its own past.
WARM_UP = 400
#: Bars of the bands, and of the returns whose spread is reported.
BANDS, RETURNS = 20, 60


def technical_snapshot(
    bars: DataFrame, *, as_of: Column | None = None, trend_days: int = 30, vol_days: int = 20, vol_base: int = 60,
    sr_days: int = 90, boll_days: int = 30, obv_days: int = 30, depth: int = 1000,
) -> DataFrame:
    """All of W3, W8, W11-W16 and W19 from one pass over the last ``depth`` bars of each series (more, if
    a look-back asks for more).

    The tail is cut with a group limit before the only shuffle; every indicator is then a window over
    the same partitioning, and one aggregation per symbol reads the newest values.  Averages that reach far
    back are summed once per series, at its newest bar.  Frames that slide cost their length at every bar, so
    only the bars that a look-back reads get them.
    """
    if as_of is not None:
        bars = bars.filter(F.col("ts") <= as_of)
    keys = list(I.KEYS)
    depth = max(depth, *(n + WARM_UP for n in (trend_days, vol_days, vol_base, sr_days, boll_days, obv_days)))
    df = _newest_averages(S.tail_rows(bars, keys, depth), keys)
    df = df.filter(F.col("_rn") <= max(trend_days, vol_days + vol_base + 5, sr_days, boll_days + BANDS, obv_days + 5, RETURNS + 1))
    df = df.withColumn(S.ORD, (F.col("_size") - F.col("_rn")).cast("long")).withColumns(
        {S.SEG: F.lit(0), S.OWN: F.lit(True), S.BLK: F.floor(F.col(S.ORD) / S.EMA_BLOCK)}
    )
    return _report(df, keys, trend_days, vol_days, vol_base, sr_days, boll_days, obv_days).drop("_n")


def _newest_averages(tail: DataFrame, keys: list[str]) -> DataFrame:
    """W1, W5 and W6 at the newest bar of each series, on all rows of ``tail`` with the series' length.

    An average smoothed by ``a`` is at the newest bar ``a`` times the sum of the values, each times (1 - a) to
    the power of its age, and what the first value weighs beyond that.  An average of averages is the
    difference of two such sums, so the whole report needs one sum for each factor.
    """
    rn, close, n = F.col("_rn"), F.col("close"), F.col("_size")
    newest_first = W.partitionBy(*keys).orderBy(F.col("ts").desc())
    whole = newest_first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    factors = {"fast": 2.0 / 13, "slow": 2.0 / 27, "signal": 2.0 / 10}
    sig, gain = factors["signal"], 1.0 / 14
    chg = close - F.lead("close").over(newest_first)
    change = lambda c: F.when(F.col("_chg").isNotNull(), F.greatest(c, F.lit(0.0)))
    df = tail.withColumn("_chg", chg).withColumns({"_up": change(F.col("_chg")), "_dn": change(-F.col("_chg"))})
    sums = {"_size": F.max("_rn").over(whole), "_first": F.last("close").over(whole)}
    for name, a in factors.items():
        sums[f"_t_{name}"] = F.sum(F.pow(F.lit(1.0 - a), rn) * close).over(whole)
    for c in ("_up", "_dn"):
        sums[f"_t{c}"] = F.sum(F.pow(F.lit(1.0 - gain), rn - 1) * F.col(c)).over(whole)
        sums[f"_first{c}"] = F.last(c, ignorenulls=True).over(whole)
    for k in (20, 50, 200):
        c = F.when(rn <= k, close)
        sums[f"sma{k}"] = F.when(F.count(c).over(whole) == k, F.avg(c).over(whole))
    df = df.withColumns(sums)
    power = lambda a, k: F.pow(F.lit(1.0 - a), k)

    def average(name):
        a = factors[name]
        return F.col(f"_t_{name}") * (a / (1.0 - a)) + F.col("_first") * power(a, n)

    def average_again(name):
        a = factors[name]
        both = (F.col("_t_signal") - F.col(f"_t_{name}")) * a + F.col("_first") * (power(sig, n) - power(a, n)) * (1.0 - a)
        return both * (sig / (a - sig))

    smooth = lambda c: F.col(f"_t{c}") * gain + F.col(f"_first{c}") * (1.0 - gain) * power(gain, n - 2)
    df = df.withColumns(
        {
            "macd_line": average("fast") - average("slow"), "macd_signal": average_again("fast") - average_again("slow"),
            "rsi14": F.when(n > 14, I.rsi_value(smooth("_up"), smooth("_dn"))),
        }
    ).withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
    return df.drop("_chg", "_up", "_dn", *[k for k in sums if k[:3] != "sma" and k != "_size"])


def _report(df, keys, trend_days, vol_days, vol_base, sr_days, boll_days, obv_days) -> DataFrame:
    w = S.seg_window(keys)
    rn = F.col("_rn")
    df = I.add_returns(I.add_bollinger(I.add_money_flow(df), w, BANDS), w, RETURNS)
    prev = F.when(F.col(S.ORD) > 0, F.lag("close").over(w))
    df = df.withColumns(
        {
            "_r": F.try_divide(F.col("close"), prev) - 1.0,
            "_sv": F.when(rn < obv_days + 5, F.coalesce(F.signum(F.col("close") - prev), F.lit(0.0)) * F.col("volume")).otherwise(0.0),
            "_hi7": F.max("high").over(w.rowsBetween(-3, 3)), "_lo7": F.min("low").over(w.rowsBetween(-3, 3)),
            "_last": F.last("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )
    df = df.withColumn("_obv", F.sum("_sv").over(w.rowsBetween(W.unboundedPreceding, 0)))
    # a pivot needs three bars on both sides inside the looked-at days
    inner = (rn > 3) & (rn <= F.least(F.lit(sr_days), F.col("_size")) - 3)
    sup = F.when(inner & (F.col("low") == F.col("_lo7")), F.col("low"))
    res = F.when(inner & (F.col("high") == F.col("_hi7")), F.col("high"))
    event = F.when((rn <= boll_days) & (F.col("close") < F.col("bb_lower")), "lower_breakout").when(
        (rn <= boll_days) & (F.col("close") > F.col("bb_upper")), "upper_breakout")
    df = df.withColumns({"_sup": sup, "_res": res, "_ev": event})
    newest = ["close", "rsi14", "macd_line", "macd_signal", "macd_hist", "sma20", "sma50", "sma200", "mfi",
              "bandwidth", "pct_b", "ret1d_pct", "ret5d_pct", "ret_std_pct"]
    at_event = F.when(F.col("_ev").isNotNull(), F.col("ts"))
    in_trend, in_obv = rn <= trend_days, rn <= obv_days
    x = -rn.cast("double")

    def line(y, cond):
        yy, xx = F.when(cond, y), F.when(cond, x)
        return F.regr_slope(yy, xx), F.when(F.regr_syy(yy, xx) > 0, F.regr_r2(yy, xx)).otherwise(0.0)

    t_slope, t_r2 = line(F.ln("close"), in_trend)
    o_slope, o_r2 = line(F.col("_obv"), in_obv)
    seen = F.when(rn <= vol_days + vol_base + 4, F.col("_r"))
    cur = F.when(rn <= vol_days, F.col("_r"))
    base = F.when((rn > vol_days) & (rn <= vol_days + vol_base), F.col("_r"))
    out = df.groupBy(*keys).agg(
        F.max("ts").alias("asof"), F.max("_size").cast("long").alias("_n"),
        F.max_by(F.struct(*newest), "ts").alias("now"),
        F.max_by("_ev", at_event).alias("last_event"), F.max(at_event).cast("date").alias("last_event_date"),
        t_slope.alias("_slope"), t_r2.alias("r2"), o_slope.alias("obv_slope"), o_r2.alias("obv_r2"),
        F.count(seen).alias("_nr"), F.count(cur).alias("_nc"), F.stddev_pop(cur).alias("_sc"),
        F.count(base).alias("_nb"), F.stddev_pop(base).alias("_sb"),
        F.max(F.when(F.col("_sup") <= F.col("_last"), F.col("_sup"))).alias("nearest_support"),
        F.min(F.when(F.col("_res") >= F.col("_last"), F.col("_res"))).alias("nearest_resistance"),
    )
    out = out.select("*", "now.*").drop("now")
    out = out.withColumn("rows", F.least(F.col("_n"), F.lit(trend_days + 5)))
    out = I.grade_trend(out, max(trend_days // 2, 10)).withColumnsRenamed(
        {"r2": "trend_r2", "direction": "trend_direction", "strength": "trend_strength", "status": "trend_status"})
    out = out.withColumn("rows", F.least(F.col("_n"), F.lit(vol_days + vol_base + 5)))
    out = I.grade_volatility(out, vol_days, vol_base, max(vol_days + vol_base // 2, 20)).withColumnRenamed("status", "vol_status")
    last = F.col("close")
    out = out.withColumn("obv_slope", I.level(F.col("obv_slope"), F.col("obv_r2")))
    obv_ok = F.col("_n") >= max(obv_days // 2, 10)
    out = out.withColumns(
        {
            "distance_to_support_pct": F.try_divide((last - F.col("nearest_support")) * 100.0, last),
            "distance_to_resistance_pct": F.try_divide((F.col("nearest_resistance") - last) * 100.0, last),
            "obv_trend": F.when(obv_ok, F.when(F.col("obv_slope") > 0, "up").when(F.col("obv_slope") < 0, "down").otherwise("flat")),
            "mfi": F.when(F.col("_n") >= 19, F.col("mfi")),
        }
    )
    out = out.withColumn("mfi_state", I.money_flow_state(F.col("mfi")))
    return I.with_cross_flags(out).drop("rows")


#: What :func:`_trailing` adds as numbers.
FRAMES = ["sma20", "sma50", "sma200", "bb_upper", "bb_lower", "ret_std_pct", "_slope", "trend_r2", "obv_slope", "obv_r2",
          "_sc", "_sb", "nearest_support", "nearest_resistance"]


def _trailing(trend_days: int, vol_days: int, vol_base: int, sr_days: int, boll_days: int, obv_days: int):
    """The sliding look-backs at every bar of one segment, as a function of its rows: a look-back is a row of a
    view on the segment's column.  Values are taken relative to the bar's own, so what does not move has a spread
    of exactly zero."""
    order = S.ORD

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        col = lambda c: t[c].to_numpy().astype(float)
        n, close = t.num_rows, col("close")

        def ago(y, first, last):
            """A view of ``y`` at the ages ``first`` to ``last``, a column each; unknown before the segment's first bar."""
            padded = np.concatenate([np.full(last, np.nan), y])
            return sliding_window_view(padded, last + 1)[:, ::-1][:, first:]

        def sums(y, first, last):
            """Which are known, and by how much each differs from the bar's own."""
            d = ago(y, first, last) - np.where(np.isnan(y), 0.0, y)[:, None]
            known = ~np.isnan(d)
            d[~known] = 0.0
            return known, d, known.sum(1), d.sum(1), np.einsum("ij,ij->i", d, d)

        def spread(y, first, last):
            _, _, c, s, q = sums(y, first, last)
            some = np.where(c > 0, c, np.nan)
            return c, np.sqrt(np.maximum(c * q - s * s, 0.0)) / some

        def line(y, days):
            known, d, c, s, q = sums(y, 0, days - 1)
            age = -np.arange(days, dtype=float)
            x, xx, xs = known @ age, known @ (age * age), d @ age
            sxx, syy, sxy = c * xx - x * x, c * q - s * s, c * xs - x * s
            sxx = np.where(sxx > 0, sxx, np.nan)
            return sxy / sxx, np.where(syy > 0, sxy * sxy / (sxx * np.where(syy > 0, syy, 1.0)), 0.0)

        def mean(days):  # one after the other: equal closes give the same bits as an average in Spark
            return sum(ago(close, 0, days - 1).T) / days

        out = {f"sma{d}": mean(d) for d in (20, 50, 200)}
        c, std = spread(close, 0, BANDS - 1)
        std = np.where(c == BANDS, std, np.nan)
        out |= {"bb_upper": out["sma20"] + 2.0 * std, "bb_lower": out["sma20"] - 2.0 * std}
        c, std = spread(col("_ret"), 0, RETURNS - 1)
        out["ret_std_pct"] = np.where(c >= 20, std * 100.0, np.nan)
        (out["_slope"], out["trend_r2"]), (out["obv_slope"], out["obv_r2"]) = line(col("_ln"), trend_days), line(col("_obv"), obv_days)
        nc, out["_sc"] = spread(col("_r"), 0, vol_days - 1)
        nb, out["_sb"] = spread(col("_r"), vol_days, vol_days + vol_base - 1)
        # a pivot has three bars on both sides inside the look-back
        sup, res, now = ago(col("_sup"), 3, sr_days - 4), ago(col("_res"), 3, sr_days - 4), close[:, None]
        low = np.fmax.reduce(np.where(sup <= now, sup, np.nan), axis=1, initial=np.nan)
        high = np.fmin.reduce(np.where(res >= now, res, np.nan), axis=1, initial=np.nan)
        out |= {"nearest_support": low, "nearest_resistance": high}
        event = np.where(close < out["bb_lower"], 1, np.where(close > out["bb_upper"], 2, 0))
        at = np.where(event > 0, np.arange(n), -1)
        at = np.maximum.accumulate(at) if n else at  # the last event so far, if it lies in the look-back
        at = np.where(at > np.arange(n) - boll_days, at, -1)
        picked = pa.array(at, mask=at < 0)
        out = {c: pa.array(out[c], pa.float64(), from_pandas=True) for c in FRAMES} | {"_nc": pa.array(nc.astype("int64")), "_nb": pa.array(nb.astype("int64"))}
        out["last_event"] = pa.array([None, "lower_breakout", "upper_breakout"]).take(pa.array(np.where(at < 0, 0, event[at])))
        out["_ev_ts"] = t["ts"].combine_chunks().take(picked)
        for c, v in out.items():
            t = t.append_column(c, v)
        return t

    return run


def snapshot_series(
    bars: DataFrame, *, trend_days: int = 30, vol_days: int = 20, vol_base: int = 60, sr_days: int = 90,
    boll_days: int = 30, obv_days: int = 30, **seg,
) -> DataFrame:
    """C1 at every bar: the same report with every look-back as a trailing frame.

    Costs a constant number of windows over one segmented shuffle of the bars, however many moments
    are asked for later.  Frames that slide run over a segment's columns (:func:`_trailing`): as windows they
    would be summed anew, row by row, at every bar.
    """
    keys = I.KEYS
    df, w = I.segmented(bars, **seg), S.seg_window(keys)
    ordinal = F.col(S.ORD)
    df = I.add_money_flow(I.add_macd(I.add_rsi(df)))
    change = F.when(ordinal > 0, F.col("close") - F.lag("close").over(w))
    near = w.rowsBetween(-3, 3)
    full = F.count(F.lit(1)).over(near) == 7
    df = df.withColumns(
        {
            "_ret": F.try_divide(F.col("close"), F.when(ordinal > 0, F.lag("close").over(w))) - 1.0,
            "ret5d_pct": (F.try_divide(F.col("close"), F.when(ordinal >= 5, F.lag("close", 5).over(w))) - 1.0) * 100.0,
            "_r": F.try_divide(change, F.col("close") - change), "_ln": F.ln("close"),
            "_obv": F.sum(F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume")).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "_sup": F.when(full & (F.col("low") == F.min("low").over(near)), F.col("low")),
            "_res": F.when(full & (F.col("high") == F.max("high").over(near)), F.col("high")),
        }
    ).withColumn("ret1d_pct", F.col("_ret") * 100.0)
    days = dict(trend_days=trend_days, vol_days=vol_days, vol_base=vol_base, sr_days=sr_days, boll_days=boll_days, obv_days=obv_days)
    added = ", ".join(f"{c} double" for c in FRAMES) + ", _nc long, _nb long, last_event string, _ev_ts timestamp"
    df = df.groupBy(*keys, S.SEG).applyInArrow(_trailing(**days), T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields]))
    df = df.filter(S.OWN).withColumn("_n", ordinal + 1).withColumn("_nr", F.least(ordinal, F.lit(vol_days + vol_base + 4)))
    last = F.col("close")
    width = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns(
        {
            "bandwidth": F.try_divide(width, F.col("sma20")), "pct_b": F.try_divide(last - F.col("bb_lower"), width),
            "last_event_date": F.col("_ev_ts").cast("date"),
            "rows": F.least(F.col("_n"), F.lit(trend_days + 5)), "r2": F.col("trend_r2"),
        }
    )
    df = I.grade_trend(df, max(trend_days // 2, 10)).drop("trend_r2").withColumnsRenamed(
        {"r2": "trend_r2", "direction": "trend_direction", "strength": "trend_strength", "status": "trend_status"})
    df = df.withColumn("rows", F.least(F.col("_n"), F.lit(vol_days + vol_base + 5)))
    df = I.grade_volatility(df, vol_days, vol_base, max(vol_days + vol_base // 2, 20)).withColumnRenamed("status", "vol_status")
    df = df.withColumn("obv_slope", I.level(F.col("obv_slope"), F.col("obv_r2")))
    obv_ok = F.col("_n") >= max(obv_days // 2, 10)
    df = df.withColumns(
        {
            "distance_to_support_pct": F.try_divide((last - F.col("nearest_support")) * 100.0, last),
            "distance_to_resistance_pct": F.try_divide((F.col("nearest_resistance") - last) * 100.0, last),
            "obv_trend": F.when(obv_ok, F.when(F.col("obv_slope") > 0, "up").when(F.col("obv_slope") < 0, "down").otherwise("flat")),
            "mfi": F.when(F.col("_n") >= 19, F.col("mfi")),
        }
    )
    df = I.with_cross_flags(df.withColumn("mfi_state", I.money_flow_state(F.col("mfi"))))
    drop = ["_ret", "_r", "_ln", "_obv", "_sup", "_res", "_ev_ts", "_n", "rows", "open", "high", "low", "volume", "bb_upper", "bb_lower"]
    return S.own_rows(df.withColumnRenamed("ts", "asof")).drop(*drop)


#: A symbol asked for at up to this many bars gets a tail for each of them, one asked more often its series.
FEW = 4


def snapshots_at(bars: DataFrame, requests: DataFrame, **days) -> DataFrame:
    """C1 as of many moments: for each (symbol, as_of) the report at the last bar at or before it, so
    that nothing after the moment is read.

    The series form slides every look-back over every bar; where few bars of a symbol are asked for, the tails
    that end there cost far less. Bars of symbols that nobody asks for are read only to find that out.
    """
    from ..operators.asof import asof_join

    bars = stored(bars, "bars")  # read by the look-up and by both forms
    req = requests.select("symbol", "as_of").distinct()
    req = asof_join(req, bars.select("symbol", "ts"), ["symbol"], left_ts="as_of", right_ts="ts", columns=["ts"], name="_b")
    req = stored(req.filter("_b is not null").select("symbol", "as_of", F.col("_b.ts").alias("asof")), "asked")
    asked = req.select("symbol", "asof").distinct()
    times = asked.groupBy("symbol").agg(F.count(F.lit(1)).alias("_times"))
    most = times.agg(F.max("_times")).first()[0] or 0
    out = None
    if most <= FEW or not times.filter(F.col("_times") <= FEW).isEmpty():
        out = _snapshots_of_tails(bars, asked.join(times.filter(F.col("_times") <= FEW), "symbol", "left_semi"), **days)
    if most > FEW:
        often = snapshot_series(bars.join(times.filter(F.col("_times") > FEW), "symbol", "left_semi"), **days)
        out = often if out is None else often.unionByName(out, allowMissingColumns=True)
    return req.join(out, ["symbol", "asof"])


def _snapshots_of_tails(bars: DataFrame, asked: DataFrame, **days) -> DataFrame:
    """The report at each asked (symbol, asof), from a series of its own that ends there."""
    tails = bars.join(asked, "symbol").filter(F.col("ts") <= F.col("asof"))
    tails = tails.withColumn("symbol", F.struct("symbol", "asof")).drop("asof")
    return technical_snapshot(tails, **days).withColumn("symbol", F.col("symbol.symbol"))
