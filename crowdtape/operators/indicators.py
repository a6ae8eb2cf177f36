"""Technical indicators over bars(symbol, interval, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import segments as S

KEYS = ("symbol", "interval")


# ---- frames -------------------------------------------------------------------------------------
def full_frame(fn, value: Column, n: int, window) -> Column:
    """``fn(value)`` over the last ``n`` rows; NULL until ``n`` values exist."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, fn(value).over(frame))


def sma(value: Column, n: int, window) -> Column:
    return full_frame(F.avg, value, n, window)


def rolling_std(value: Column, n: int, window) -> Column:
    """Population standard deviation over a full window."""
    return full_frame(F.stddev_pop, value, n, window)


# ---- series -------------------------------------------------------------------------------------
def segmented(bars: DataFrame, **kw) -> DataFrame:
    return S.segment_series(bars, KEYS, "ts", **kw)


def with_sma(bars: DataFrame, ns=(20, 50, 200), **seg) -> DataFrame:
    """W1."""
    seg.setdefault("halo", max(ns))
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    return S.own_rows(df.withColumns({f"sma{n}": sma(F.col("close"), n, w) for n in ns}))


def with_bollinger(bars: DataFrame, period: int = 20, num_std: float = 2.0, **seg) -> DataFrame:
    """W2 and the band columns of W3."""
    seg.setdefault("halo", period)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    return S.own_rows(add_bollinger(df, w, period, num_std))


def add_bollinger(df: DataFrame, w, period: int = 20, num_std: float = 2.0) -> DataFrame:
    close = F.col("close")
    df = df.withColumns({"bb_mid": sma(close, period, w), "bb_std": rolling_std(close, period, w)})
    df = df.withColumns(
        {
            "bb_upper": F.col("bb_mid") + num_std * F.col("bb_std"),
            "bb_lower": F.col("bb_mid") - num_std * F.col("bb_std"),
        }
    )
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns(
        {
            "bandwidth": F.try_divide(width, F.col("bb_mid")),
            "pct_b": F.try_divide(close - F.col("bb_lower"), width),
        }
    )


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """W5 on a segmented frame: line, its own average, and their difference."""
    close = F.col("close")
    df = S.ewm_columns(
        df, KEYS,
        {"_fast": (close, 2.0 / (fast + 1), 0), "_slow": (close, 2.0 / (slow + 1), 0)},
    )
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = S.ewm_columns(df, KEYS, {"macd_signal": (F.col("macd_line"), 2.0 / (signal + 1), 0)})
    return df.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def rsi_value(gain: Column, loss: Column) -> Column:
    """All-gain runs give 100; no movement at all gives NULL."""
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(
        100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))
    )


def add_rsi(df: DataFrame, n: int = 14, seed: str = "first", name: str = "rsi14") -> DataFrame:
    """W6 (``seed="first"``: smoothing starts at the first change) and W7 (``seed="mean"``: starts
    at the mean of the first ``n`` changes, and no losses at all reads as 100)."""
    w = S.seg_window(KEYS)
    change = F.col("close") - F.lag("close").over(w)
    df = df.withColumn("_chg", F.when(F.col(S.ORD) > 0, change))
    df = df.withColumns(
        {"_up": F.greatest(F.col("_chg"), F.lit(0.0)), "_dn": F.greatest(-F.col("_chg"), F.lit(0.0))}
    )
    up, dn, first = F.col("_up"), F.col("_dn"), 1
    if seed == "mean":
        frame = w.rowsBetween(-(n - 1), 0)
        at_seed = F.col(S.ORD) == n
        df = df.withColumns(
            {
                "_up": F.when(at_seed, F.avg("_up").over(frame)).otherwise(up),
                "_dn": F.when(at_seed, F.avg("_dn").over(frame)).otherwise(dn),
            }
        )
        first = n
    df = S.ewm_columns(df, KEYS, {"_gain": (up, 1.0 / n, first), "_loss": (dn, 1.0 / n, first)})
    value = rsi_value(F.col("_gain"), F.col("_loss"))
    if seed == "mean":
        value = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(value)
    return df.withColumn(name, F.when(F.col(S.ORD) >= n, value)).drop(
        "_chg", "_up", "_dn", "_gain", "_loss"
    )


def indicator_series(bars: DataFrame, **seg) -> DataFrame:
    """SMA20/50/200, RSI14 and MACD(12,26,9) for every bar, in one shuffle of the bars."""
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    df = df.withColumns({f"sma{n}": sma(F.col("close"), n, w) for n in (20, 50, 200)})
    return S.own_rows(add_macd(add_rsi(df)))


def ema_series(bars: DataFrame, span: int, **seg) -> DataFrame:
    """W4."""
    df = segmented(bars, **seg)
    return S.own_rows(S.ewm_columns(df, KEYS, {f"ema{span}": (F.col("close"), 2.0 / (span + 1), 0)}))


def add_money_flow(df: DataFrame, n: int = 14, zero: str = "null", name: str = "mfi") -> DataFrame:
    """W8 (``zero="null"``: no negative flow gives NULL) and W9 (``zero="cap"``: 100, or 50 when
    there is no flow at all, and the first value appears one row later)."""
    w = S.seg_window(KEYS)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    df = df.withColumn("_tp", typical)
    df = df.withColumn("_ptp", F.when(F.col(S.ORD) > 0, F.lag("_tp").over(w)))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns(
        {
            "_pos": F.when(F.col("_tp") > F.col("_ptp"), flow).otherwise(0.0),
            "_neg": F.when(F.col("_tp") < F.col("_ptp"), flow).otherwise(0.0),
        }
    )
    pos, neg = (full_frame(F.sum, F.col(c), n, w) for c in ("_pos", "_neg"))
    df = df.withColumns({"_pn": pos, "_nn": neg})
    ratio = 100.0 - 100.0 / (1.0 + F.try_divide(F.col("_pn"), F.col("_nn")))
    if zero == "cap":
        value = (
            F.when((F.col("_pn") == 0) & (F.col("_nn") == 0), F.lit(50.0))
            .when(F.col("_nn") == 0, F.lit(100.0))
            .otherwise(ratio)
        )
        value = F.when(F.col(S.ORD) >= n, value)
    else:
        value = ratio
    return df.withColumn(name, value).drop("_tp", "_ptp", "_pos", "_neg", "_pn", "_nn")


def money_flow(bars: DataFrame, n: int = 14, zero: str = "null", **seg) -> DataFrame:
    seg.setdefault("halo", n + 1)
    return S.own_rows(add_money_flow(segmented(bars, **seg), n, zero))


def money_flow_state(mfi: Column) -> Column:
    return F.when(mfi >= 80, "overbought").when(mfi <= 20, "oversold").when(
        mfi.isNotNull(), "neutral"
    )


def on_balance_volume(bars: DataFrame, **seg) -> DataFrame:
    """A running total over the whole series, computed as a running total inside each segment
    plus the sum of the segments before it."""
    seg.setdefault("halo", 1)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    change = F.when(F.col(S.ORD) > 0, F.col("close") - F.lag("close").over(w))
    df = df.withColumn("_sv", F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume"))
    df = df.filter(F.col(S.OWN))
    totals = df.groupBy(*KEYS, S.SEG).agg(F.sum("_sv").alias("_tot"))
    before = W.partitionBy(*KEYS).orderBy(S.SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *KEYS, S.SEG, F.coalesce(F.sum("_tot").over(before), F.lit(0.0)).alias("_carry")
    )
    running = F.sum("_sv").over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("obv", running).join(carry, [*KEYS, S.SEG])
    return S.own_rows(df.withColumn("obv", F.col("obv") + F.col("_carry")).drop("_carry", "_sv"))


def true_range_average(bars: DataFrame, n: int = 14, **seg) -> DataFrame:
    """Mean true range over ``n`` bars; the first bar has none."""
    seg.setdefault("halo", n + 1)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    return S.own_rows(add_true_range(df, w, n))


def add_true_range(df: DataFrame, w, n: int = 14) -> DataFrame:
    prev = F.when(F.col(S.ORD) > 0, F.lag("close").over(w))
    rng = F.when(
        prev.isNotNull(),
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        ),
    )
    df = df.withColumn("_tr", rng)
    return df.withColumn("atr", full_frame(F.avg, F.col("_tr"), n, w)).drop("_tr")


def local_extrema(bars: DataFrame, k: int = 3, **seg) -> DataFrame:
    """Bars whose high (low) is the extreme of the ``2k+1`` bars centred on them.

    Looked at from ``k`` bars later, so only a trailing halo is needed.
    """
    n = 2 * k + 1
    seg.setdefault("halo", n)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(frame) == n
    mid = F.lag(F.struct("ts", "high", "low"), k).over(w)
    df = df.withColumns(
        {
            "_mid": mid, "_full": full,
            "_hi": F.max("high").over(frame), "_lo": F.min("low").over(frame),
        }
    )
    df = S.own_rows(df).filter(F.col("_full"))
    return df.select(
        *KEYS,
        F.col("_mid.ts").alias("ts"),
        F.when(F.col("_mid.high") == F.col("_hi"), F.col("_mid.high")).alias("resistance"),
        F.when(F.col("_mid.low") == F.col("_lo"), F.col("_mid.low")).alias("support"),
    ).filter(F.col("resistance").isNotNull() | F.col("support").isNotNull())


def returns(bars: DataFrame, std_window: int = 60, std_min: int = 20, **seg) -> DataFrame:
    """1-bar and 5-bar returns and the population deviation of 1-bar returns, in percent."""
    seg.setdefault("halo", std_window + 6)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    return S.own_rows(add_returns(df, w, std_window, std_min))


def add_returns(df: DataFrame, w, std_window: int = 60, std_min: int = 20) -> DataFrame:
    def back(n):
        return F.when(F.col(S.ORD) >= n, F.lag("close", n).over(w))

    df = df.withColumn("_r", F.try_divide(F.col("close"), back(1)) - 1.0)
    frame = w.rowsBetween(-(std_window - 1), 0)
    enough = F.count("_r").over(frame) >= std_min
    return df.withColumns(
        {
            "ret1d_pct": F.col("_r") * 100.0,
            "ret5d_pct": (F.try_divide(F.col("close"), back(5)) - 1.0) * 100.0,
            "ret_std_pct": F.when(enough, F.stddev_pop("_r").over(frame) * 100.0),
        }
    ).drop("_r")


def window_returns(bars: DataFrame, spans=(63, 126, 252), adv: int = 20) -> DataFrame:
    """Trailing total returns and average traded value at the last bar of each series."""
    tail = S.tail_rows(bars, KEYS, max(spans) + 1)

    def close_at(n):
        return F.max(F.when(F.col("_rn") == n + 1, F.col("close")))

    last = F.max_by("close", "ts")
    adv_vol = F.avg(F.when(F.col("_rn") <= adv, F.col("volume")))
    full = F.count_if(F.col("_rn") <= adv) == adv
    out = tail.groupBy(*KEYS).agg(
        last.alias("last_close"),
        F.when(full, adv_vol).alias("_adv"),
        *[close_at(n).alias(f"_c{n}") for n in spans],
    )
    return out.select(
        *KEYS, "last_close",
        F.when(F.col("_adv") != 0, F.col("_adv") * F.col("last_close")).alias("adv_value"),
        *[
            (F.try_divide(F.col("last_close"), F.col(f"_c{n}")) - 1.0).alias(f"ret_{n}")
            for n in spans
        ],
    )


def annual_volatility(bars: DataFrame, **seg) -> DataFrame:
    """Population deviation of all 1-bar returns of a series, annualised."""
    seg.setdefault("halo", 1)
    df, w = segmented(bars, **seg), S.seg_window(KEYS)
    prev = F.when(F.col(S.ORD) > 0, F.lag("close").over(w))
    df = df.withColumn("_r", F.try_divide(F.col("close"), prev) - 1.0).filter(F.col(S.OWN))
    return df.groupBy(*KEYS).agg((F.stddev_pop("_r") * F.sqrt(F.lit(252.0))).alias("ann_vol"))


# ---- last-bar reports ---------------------------------------------------------------------------
def _line_fit(y: Column, x: Column) -> dict[str, Column]:
    """Slope and R2 of ``y`` on ``x``; R2 of a flat line is 0, not 1."""
    return {
        "_slope": F.regr_slope(y, x),
        "_r2": F.when(F.regr_syy(y, x) > 0, F.regr_r2(y, x)).otherwise(F.lit(0.0)),
    }


def level(slope: Column, r2: Column) -> Column:
    """The slope of a volume balance, zero where it is rounding only: volumes are whole, so that a balance which
    does slope has an R2 above 1e-12, and the last bits depend on the order of the rows."""
    return F.when(slope.isNotNull() & (r2 < 1e-15), 0.0).otherwise(slope)


def trend_strength(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """Log-price trend over the last ``lookback`` bars, graded 0 to 3."""
    tail = S.tail_rows(bars, KEYS, lookback + 5)
    inside = F.col("_rn") <= lookback
    x = F.when(inside, -F.col("_rn").cast("double"))
    y = F.when(inside, F.ln("close"))
    fit = _line_fit(y, x)
    need = max(lookback // 2, 10)
    out = tail.groupBy(*KEYS).agg(
        F.max("ts").alias("asof"), F.count(F.lit(1)).alias("rows"),
        fit["_slope"].alias("_slope"), fit["_r2"].alias("r2"),
    )
    return grade_trend(out, need)


def grade_trend(out: DataFrame, need: int) -> DataFrame:
    ok = F.col("rows") >= need
    pct = (F.exp("_slope") - 1.0) * 100.0
    out = out.withColumn("_pct", F.when(ok, pct)).withColumn("r2", F.when(ok, F.col("r2")))
    size = F.abs("_pct")
    strength = (
        F.when((size >= 0.30) & (F.col("r2") >= 0.40), 3)
        .when((size >= 0.15) & (F.col("r2") >= 0.25), 2)
        .when((size >= 0.05) & (F.col("r2") >= 0.10), 1)
        .otherwise(0)
    )
    return out.withColumns(
        {
            "direction": F.when(F.col("_pct") > 0, "up").when(F.col("_pct") < 0, "down").when(
                ok, "flat"
            ),
            "strength": F.when(ok, strength),
            "slope_pct_per_day": F.col("_pct"),
            "status": F.when(ok, "ok").otherwise("insufficient_data"),
        }
    ).drop("_slope", "_pct")


def obv_trend(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """Trend of the running volume balance over the last ``lookback`` bars.  The slope does not
    depend on where the balance starts, so only the tail of each series is read."""
    tail = S.tail_rows(bars, KEYS, lookback + 5)
    w = W.partitionBy(*KEYS).orderBy("ts")
    change = F.col("close") - F.lag("close").over(w)
    tail = tail.withColumn("_sv", F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume"))
    tail = tail.withColumn("_obv", F.sum("_sv").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = F.col("_rn") <= lookback
    fit = _line_fit(F.when(inside, F.col("_obv")), F.when(inside, -F.col("_rn").cast("double")))
    out = tail.groupBy(*KEYS).agg(
        F.max("ts").alias("asof"), F.count(F.lit(1)).alias("rows"),
        fit["_slope"].alias("slope"), fit["_r2"].alias("r2"),
    )
    out = out.withColumn("slope", level(F.col("slope"), F.col("r2")))
    ok = F.col("rows") >= max(lookback // 2, 10)
    slope = F.col("slope")
    return out.withColumns(
        {
            "trend": F.when(ok, F.when(slope > 0, "up").when(slope < 0, "down").otherwise("flat")),
            "slope": F.when(ok, slope),
            "r2": F.when(ok, F.col("r2")),
            "status": F.when(ok, "ok").otherwise("insufficient_data"),
        }
    )


def volatility_state(bars: DataFrame, days: int = 20, baseline: int = 60) -> DataFrame:
    """Annualised deviation of the last ``days`` returns against the ``baseline`` before."""
    need = max(days + baseline // 2, 20)
    tail = S.tail_rows(bars, KEYS, days + baseline + 5)
    w = W.partitionBy(*KEYS).orderBy("ts")
    tail = tail.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0)
    return grade_volatility(
        tail.groupBy(*KEYS).agg(*volatility_aggregates(days, baseline)), days, baseline, need
    )


def volatility_aggregates(days: int, baseline: int) -> list[Column]:
    cur = F.when(F.col("_rn") <= days, F.col("_r"))
    base = F.when((F.col("_rn") > days) & (F.col("_rn") <= days + baseline), F.col("_r"))
    return [
        F.max("ts").alias("asof"), F.count(F.lit(1)).alias("rows"), F.count("_r").alias("_nr"),
        F.count(cur).alias("_nc"), F.stddev_pop(cur).alias("_sc"),
        F.count(base).alias("_nb"), F.stddev_pop(base).alias("_sb"),
    ]


def grade_volatility(out: DataFrame, days: int, baseline: int, need: int) -> DataFrame:
    ok = F.col("rows") >= need
    scale = F.sqrt(F.lit(252.0)) * 100.0
    have_base = (F.col("_nr") >= days + baseline) & (F.col("_nb") > 1)
    out = out.withColumns(
        {
            "realized_vol_pct": F.when(ok & (F.col("_nc") > 1), F.col("_sc") * scale),
            "baseline_vol_pct": F.when(ok & have_base, F.col("_sb") * scale),
        }
    )
    # zero on either side leaves the ratio undefined
    ratio = F.try_divide(F.nullif("realized_vol_pct", F.lit(0.0)), F.nullif("baseline_vol_pct", F.lit(0.0)))
    out = out.withColumn("vol_ratio", ratio)
    state = (
        F.when(F.col("vol_ratio") >= 1.2, "elevated")
        .when(F.col("vol_ratio") <= 0.8, "compressed")
        .when(F.col("vol_ratio").isNotNull(), "normal")
    )
    return out.withColumns(
        {"vol_state": state, "status": F.when(ok, "ok").otherwise("insufficient_data")}
    ).drop("_nr", "_nc", "_sc", "_nb", "_sb")


def support_resistance(bars: DataFrame, days: int = 90, k: int = 3) -> DataFrame:
    """Nearest pivot below and above the last close, with distances in percent."""
    tail = S.tail_rows(bars, KEYS, days)
    w = W.partitionBy(*KEYS).orderBy("ts")
    frame, n = w.rowsBetween(-k, k), 2 * k + 1
    full = F.count(F.lit(1)).over(frame) == n
    tail = tail.withColumns(
        {
            "_res": F.when(full & (F.col("high") == F.max("high").over(frame)), F.col("high")),
            "_sup": F.when(full & (F.col("low") == F.min("low").over(frame)), F.col("low")),
            "_last": F.last("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )
    out = tail.groupBy(*KEYS).agg(
        F.max("ts").alias("asof"), F.max_by("close", "ts").alias("last_close"),
        F.max(F.when(F.col("_sup") <= F.col("_last"), F.col("_sup"))).alias("nearest_support"),
        F.min(F.when(F.col("_res") >= F.col("_last"), F.col("_res"))).alias("nearest_resistance"),
    )
    last = F.col("last_close")
    return out.withColumns(
        {
            "distance_to_support_pct": F.try_divide((last - F.col("nearest_support")) * 100.0, last),
            "distance_to_resistance_pct": F.try_divide(
                (F.col("nearest_resistance") - last) * 100.0, last
            ),
        }
    )


def bollinger_scan(bars: DataFrame, days: int = 30, period: int = 20, num_std: float = 2.0) -> DataFrame:
    """Last breakout in the last ``days`` bars, and band position at the last bar.  A lower
    breakout wins when both fall on the same bar."""
    tail = S.tail_rows(bars, KEYS, days + period + 5)
    tail = add_bollinger(tail, W.partitionBy(*KEYS).orderBy("ts"), period, num_std)
    recent = F.col("_rn") <= days
    event = F.when(recent & (F.col("close") < F.col("bb_lower")), F.lit("lower_breakout")).when(
        recent & (F.col("close") > F.col("bb_upper")), F.lit("upper_breakout")
    )
    tail = tail.withColumn("_ev", event)
    when_event = F.when(F.col("_ev").isNotNull(), F.col("ts"))
    return tail.groupBy(*KEYS).agg(
        F.max("ts").alias("asof"), F.count(F.lit(1)).alias("rows"),
        F.max_by("_ev", when_event).alias("last_event"),
        F.max(when_event).cast("date").alias("last_event_date"),
        F.max_by("bandwidth", "ts").alias("bandwidth"),
        F.max_by("pct_b", "ts").alias("pct_b"),
    )


def indicator_snapshot(bars: DataFrame, depth: int = 1000) -> DataFrame:
    """The indicators at the last bar of each series with moving-average flags.

    Reads only the last ``depth`` bars of a series: enough for SMA200, and an average that starts
    ``depth`` bars earlier weighs the part it misses by less than 1e-30.
    """
    tail = S.tail_rows(bars, KEYS, depth)
    size = F.max("_rn").over(W.partitionBy(*KEYS))
    df = tail.withColumn(S.ORD, (size - F.col("_rn")).cast("long")).withColumns(
        {S.SEG: F.lit(0), S.OWN: F.lit(True), S.BLK: F.floor(F.col(S.ORD) / S.EMA_BLOCK)}
    )
    w = S.seg_window(KEYS)
    df = df.withColumns({f"sma{n}": sma(F.col("close"), n, w) for n in (20, 50, 200)})
    df = add_macd(add_rsi(df))
    cols = ["close", "rsi14", "macd_line", "macd_signal", "macd_hist", "sma20", "sma50", "sma200"]
    out = S.own_rows(df.filter(F.col("_rn") == 1)).select(
        *KEYS, F.col("ts").alias("asof"), *cols
    )
    return with_cross_flags(out)


def with_cross_flags(df: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns(
        {
            "golden_cross": flag(F.col("sma50") > F.col("sma200")),
            **{
                f"price_above_sma{n}": flag(F.col("close") > F.col(f"sma{n}"))
                for n in (20, 50, 200)
            },
        }
    )


def window_change(bars: DataFrame) -> DataFrame:
    """First-to-last close change per series in percent."""
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    out = bars.groupBy(*KEYS).agg(
        first.alias("first_close"), last.alias("last_close"), F.count(F.lit(1)).alias("rows")
    )
    pct = F.try_divide((F.col("last_close") - F.col("first_close")) * 100.0, F.col("first_close"))
    return out.withColumn("change_pct", F.when(F.col("rows") >= 2, pct))
