"""Interest scores, verdict inputs and repair, research texts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..functions import text as T
from ..operators import evidence as E
from ..operators import posts as PO
from ..session import stored
from . import snapshot as S

SUMMARY = "summariser"


# ---- interest -----------------------------------------------------------------------------------
def unit_from_z(value: Column, std: Column, cap: float = 3.0) -> Column:
    """H-M2."""
    z = F.abs(F.try_divide(value, std))
    return F.when(value.isNotNull() & (std > 0), F.least(F.lit(cap), z) / cap).otherwise(0.0)


def distance_interest(pct: Column) -> Column:
    return F.when(pct.isNotNull(), F.exp(-0.5 * F.greatest(F.lit(0.0), pct) / 5.0)).otherwise(0.0)


def unit(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)


def best_ticker(tickers: DataFrame) -> DataFrame:
    """The surest ticker of a post, ties by name."""
    t = tickers.filter(F.trim("ticker") != "")
    return t.groupBy("post_id").agg(F.min_by(F.trim("ticker"), F.struct(-F.col("confidence"), F.col("ticker"))).alias("ticker"))


def interest_points(df: DataFrame, mover: Column | None = None) -> DataFrame:
    """C2, the arithmetic: ``df`` has the snapshot columns, ``summ`` (normalised summary), ``novelty``,
    ``platform_name``, and ``title`` and ``text`` unless ``mover`` says what they tell."""
    c = F.col
    r1, r5, sd = c("ret1d_pct"), c("ret5d_pct"), c("ret_std_pct")
    has = lambda r: r.isNotNull() & F.coalesce(sd != 0, F.lit(False))
    parts = has(r1).cast("int") + has(r5).cast("int")
    z = F.when(has(r1), unit_from_z(r1, sd)).otherwise(0.0) + F.when(has(r5), unit_from_z(r5, sd * F.sqrt(F.lit(5.0)))).otherwise(0.0)
    ret_u = F.when(parts > 0, z / parts).otherwise(0.0)
    vol_u = unit((c("vol_ratio") - 1.0) / 1.5)
    strength = F.coalesce("trend_strength", F.lit(0))
    slope_u, r2 = unit(F.abs("slope_pct_per_day") / 0.8), unit(c("trend_r2"))
    trend_u = F.greatest(strength / 3.0, 0.5 * slope_u + 0.5 * r2)
    dist_u = F.greatest(distance_interest(c("distance_to_support_pct")), distance_interest(c("distance_to_resistance_pct")))
    event = F.coalesce("golden_cross", F.lit(False)) | F.coalesce((c("rsi14") >= 70) | (c("rsi14") <= 30), F.lit(False))
    tech = 10 * ret_u + 10 * vol_u + 10 * trend_u + 10 * dist_u + F.when(event, 5.0).otherwise(0.0)

    summ = c("summ")
    big_move = F.coalesce(F.abs(r1) >= 10.0, F.lit(False))
    mover = (T.is_mover_post(c("title"), c("text")) if mover is None else mover) | big_move
    said_yes = F.exists(summ["catalysts"], lambda x: F.lower(F.trim(x)).isin("yes", "y"))
    cats = F.when(mover & said_yes, F.greatest(F.size(summ["catalysts"]), F.lit(2))).otherwise(F.size(summ["catalysts"]))
    stance_u = T.stance_value(summ["stance"])
    f = summ["flags"]
    pen = F.when(f["repetition_or_template"], 3).otherwise(0) + F.when(f["vague_claims"], 3).otherwise(0) + F.when(f["mentions_spread_or_liquidity"], 2).otherwise(0)
    pen = F.least(pen, F.when(mover, 3).otherwise(8))
    raw_text = 10 * F.least(cats, F.lit(4)) / 4.0 + 5 * F.least(F.size(summ["numbers"]), F.lit(5)) / 5.0 + 10 * stance_u - pen
    text_pts = F.least(F.lit(35.0), F.greatest(F.lit(0.0), raw_text))
    nov = F.coalesce("novelty", F.lit(0.7))
    fresh = F.least(F.lit(10.0), 10.0 * nov) + T.source_score(c("platform_name"))
    spam = F.least(F.lit(100), F.greatest(F.lit(0), summ["spam_pct"]))
    damped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (tech + text_pts + fresh) * (1.0 - 0.7 * spam / 100.0)))
    size = F.coalesce(F.abs(r1), F.lit(0.0))
    floor = F.when(size >= 20.0, 55.0).when(size >= 10.0, 40.0).when(event & (strength >= 2) & (size >= 7.0), 40.0).otherwise(0.0)
    score = F.bround(F.greatest(damped, floor)).cast("int")
    notes = F.array_compact(F.array(
        F.when((ret_u > 0.66) | (vol_u > 0.66), F.lit("abnormal price/volatility")), F.when(event, F.lit("technical event (RSI/cross)")),
        F.when(cats >= 2, F.lit("multiple catalysts")), F.when(spam >= 20, F.concat(spam.cast("string"), F.lit("% spam dampened"))),
        F.when(nov >= 0.8, F.lit("high novelty")), F.when(mover, F.lit("mover heuristics")),
    ))
    notes = F.when(F.size(notes) > 0, F.array_sort(notes)).otherwise(F.array(F.lit("baseline factors")))
    df = df.withColumns({"tech_points": tech, "text_points": text_pts, "novelty_source_points": fresh.cast("double"), "interest_score": score, "interest_why": F.array_join(notes, ", ")})
    s = c("interest_score")
    return df.withColumns(
        {
            "interest_label": T.interest_label(s),
            "council_recommended": (s >= 65) | F.lower(F.coalesce("platform_name", F.lit(""))).isin("sec", "sedar", "edgar"),
            "council_priority": F.when(s >= 85, "urgent").otherwise("normal"),
        }
    )


def interest_scores(posts: DataFrame, stages: DataFrame, tickers: DataFrame, bars: DataFrame, novelty: DataFrame | None = None) -> DataFrame:
    """C2 for every post: newest summary, best ticker, snapshot as of the post's time, novelty; a row
    that cannot be scored says why instead of failing.

    Snapshots are taken per distinct (ticker, moment); all joins are equality joins.  A post's text is searched
    once, where it is read, and goes through none of them.
    """
    # parsed in a step of its own: once per row, not once per field
    summ = PO.latest_stage_columns(stages, [SUMMARY]).withColumn("_v", P.load(F.col(SUMMARY))).withColumn("summ", P.summary(F.col("_v")))
    summ = summ.withColumn("_has_summary", F.lit(True)).drop(SUMMARY, "_v")
    read = posts.withColumns({"at": PO.event_time(), "_mover": T.is_mover_post(F.col("title"), F.col("text"))})
    df = read.drop("title", "text").join(summ, "post_id", "left").join(best_ticker(tickers), "post_id", "left")
    fallback = F.try_element_at(F.array_compact(F.transform(F.col("summ")["assets"], lambda a: a["ticker"])), F.lit(1))
    df = df.withColumn("symbol", F.coalesce("ticker", fallback))
    # asked for moments and scored: thin rows, read twice
    read_of = F.when(F.col("_has_summary"), F.struct(*[F.col("summ")[k].alias(k) for k in ("catalysts", "numbers", "stance", "flags", "spam_pct")]))
    df = stored(df.select("post_id", "at", "source", "platform", "_mover", read_of.alias("summ"), "_has_summary", "symbol"), "to-score")
    day = F.date_trunc("hour", "at")  # bars are no finer, so posts of an hour share a snapshot
    req = df.filter("symbol is not null").select("symbol", day.alias("as_of")).distinct()
    snap = S.snapshots_at(bars, req)
    df = df.withColumn("as_of", day).join(snap, ["symbol", "as_of"], "left")
    if novelty is not None:
        df = df.join(novelty.select("post_id", F.col("ticker").alias("symbol"), "novelty"), ["post_id", "symbol"], "left")
    else:
        df = df.withColumn("novelty", F.lit(0.7))
    df = df.withColumn("platform_name", F.coalesce(F.nullif("source", F.lit("")), F.nullif("platform", F.lit("")), F.lit("reddit")))
    out = interest_points(df, F.col("_mover"))
    error = (
        F.when(F.col("_has_summary").isNull(), "summary_not_found").when(F.col("symbol").isNull(), "no_ticker_detected")
        .when(F.col("close").isNull(), "price_data_unavailable")
    )
    ok = error.isNull()
    keep = ["interest_score", "interest_label", "interest_why", "council_recommended", "council_priority", "tech_points", "text_points", "novelty_source_points"]
    return out.select(
        "post_id", F.col("symbol").alias("ticker"), F.when(ok, "ok").otherwise("error").alias("status"), error.alias("error_code"),
        *[F.when(ok, F.col(k)).alias(k) for k in keep],
    )


# ---- tool lines ---------------------------------------------------------------------------------
def number_text(c: Column, digits: int, signed: bool = False) -> Column:
    body = F.format_string(f"%{'+' if signed else ''}.{digits}f", c.cast("double"))
    return F.when(c.isNotNull(), body)


def tool_lines() -> Column:
    """H-S29/C13: one line per technical report of a snapshot row."""
    c = F.col
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    joined = lambda sep, *xs: F.nullif(F.array_join(F.array_compact(F.array(*xs)), sep), F.lit(""))
    ind = joined("; ", cat("RSI14 ", number_text(c("rsi14"), 1)), cat("MACD hist ", number_text(c("macd_hist"), 2, True)), cat("Close ", number_text(c("close"), 2)))
    trend = joined("; ", cat("Trend ", c("trend_direction")), cat("Strength ", c("trend_strength").cast("string")),
                   cat("Slope ", number_text(c("slope_pct_per_day"), 2, True), "%/day"), cat("R² ", number_text(c("trend_r2"), 2)))
    vol = joined("; ", cat("Vol ", c("vol_state")), cat("Ratio ", number_text(c("vol_ratio"), 2)), cat("RV ", number_text(c("realized_vol_pct"), 2), "%"))
    sr = joined("; ", cat("Support ", number_text(c("nearest_support"), 2), " (", number_text(c("distance_to_support_pct"), 1, True), "%)"),
                cat("Resistance ", number_text(c("nearest_resistance"), 2), " (", number_text(c("distance_to_resistance_pct"), 1, True), "%)"))
    boll = joined(" ", cat("Last ", F.replace(c("last_event"), F.lit("_"), F.lit(" "))), cat("on ", c("last_event_date").cast("string")),
                  cat("%B ", number_text(c("pct_b"), 2)), cat("Bandwidth ", number_text(c("bandwidth"), 3)))
    obv = joined("; ", cat("OBV ", c("obv_trend")), cat("Slope ", number_text(c("obv_slope"), 0, True)), cat("R² ", number_text(c("obv_r2"), 2)))
    mfi = joined(" ", cat("MFI ", number_text(c("mfi"), 0)), c("mfi_state"))
    alt = lambda x, s: F.coalesce(x, F.lit(s))
    return F.array(
        alt(ind, "no indicators"), alt(trend, "Trend strength: no data"), alt(vol, "volatility unavailable"), alt(sr, "no levels"),
        alt(boll, "Bollinger scan: no signal"), alt(obv, "OBV trend: no data"), alt(mfi, "MFI flow: no data"),
    )


def read_back(lines: Column) -> Column:
    """H-S29: numbers parsed back from report lines; the last matching line wins."""
    text = F.array_join(lines, "\n")

    def last(pattern, group=1):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.try_element_at(hits, F.lit(-1))

    num = lambda p: last(p).try_cast("double")
    return F.struct(
        num(r"(?i)Price window close\s+[\d.]+\s+\(([-+]?[\d.]+)%\)").alias("price_window_close_pct"), num(r"(?i)\bRSI\s*14\s+([-\d.]+)").alias("rsi14"),
        num(r"(?i)\bMACD\s*hist\s+([-+\d.]+)").alias("macd_hist"), num(r"(?i)\bClose\s+([-\d.]+)").alias("close"),
        F.lower(last(r"(?i)\bTrend\s+(up|down|flat)\s*;\s*Strength\s+(\d+)")).alias("trend_direction"),
        last(r"(?i)\bTrend\s+(up|down|flat)\s*;\s*Strength\s+(\d+)", 2).try_cast("double").alias("trend_strength"),
    )


def research_text(ticker: Column, at: Column, hypotheses: Column, rationale: Column, lines: Column, sentiment: Column) -> Column:
    """The summary of a research bundle; ``hypotheses`` is an array of struct(text, type)."""
    hyp = F.transform(
        F.filter(hypotheses, lambda h: F.trim(F.coalesce(h["text"], F.lit(""))) != ""),
        lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(F.coalesce(h["type"], F.lit("")) != "", F.concat(F.lit("("), h["type"], F.lit(") "))).otherwise(""), F.trim(h["text"])),
    )
    block = lambda cond, *xs: F.when(cond, F.concat(*xs)).otherwise(F.array().cast("array<string>"))
    said = F.coalesce(rationale, F.lit("")) != ""
    parts = F.concat(
        F.array(F.concat(F.lit("Research focus: "), ticker), F.concat(F.lit("Article time: "), at)),
        block(F.size(hyp) > 0, F.array(F.lit(""), F.lit("Hypotheses:")), hyp),
        block(said, F.array(F.lit(""), F.concat(F.lit("Rationale: "), rationale))),
        block(F.size(lines) > 0, F.array(F.lit(""), F.lit("Technical checks:")), F.transform(lines, lambda x: F.concat(F.lit("- "), x))),
        block(F.coalesce(sentiment, F.lit("")) != "", F.array(F.lit(""), sentiment)),
    )
    return F.array_join(parts, "\n")


def sentiment_line(ticker: Column, days: int, des: Column, n: Column) -> Column:
    """C13."""
    body = F.when(n > 0, F.concat(F.lit("Ticker avg "), number_text(des, 2, True), F.lit(" across "), n.cast("string"), F.lit(" post(s)"))).otherwise("no signal")
    return F.concat(ticker, F.lit(f" sentiment ({days}d): "), body)


def research_bundle(requests: DataFrame, bars: DataFrame, deltas: DataFrame, days: int = 7) -> DataFrame:
    """Technical report, evidence score and text for each (post_id, ticker, as_of)."""
    from ..operators import sentiment as DES

    keys = requests.select(F.col("ticker"), "as_of").distinct()
    snap = S.snapshots_at(bars, keys.select(F.col("ticker").alias("symbol"), "as_of")).withColumnRenamed("symbol", "ticker")
    snap = snap.withColumn("technical_lines", tool_lines())
    des = DES.des_scores(keys, deltas, days, channels=("social",)).drop("channel")
    j = requests.join(snap, ["ticker", "as_of"], "left").join(des, ["ticker", "as_of"], "left")
    lines = F.coalesce("technical_lines", F.array(F.lit("no data")))
    none = F.array().cast("array<struct<text:string,type:string>>")
    n = F.coalesce("n_deltas", F.lit(0))
    sent = sentiment_line(F.col("ticker"), days, F.col("des_raw"), n)
    return j.select(
        "post_id", "ticker", "as_of", lines.alias("technical_lines"), "des_raw", "confidence", n.cast("long").alias("n_deltas"),
        research_text(F.col("ticker"), F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'"), none, F.lit(None).cast("string"), lines, sent).alias("summary_text"),
    )


# ---- verdict input and repair -------------------------------------------------------------------
# fixed values: report fields carried into a verdict
TECHNICAL = [
    "close", "price_window_close_pct", "rsi14", "macd_line", "macd_signal", "macd_hist", "sma20", "sma50", "sma200",
    "trend_strength", "trend_slope_pct_per_day", "trend_r2", "realized_vol_annual_pct", "baseline_vol_annual_pct",
    "vol_ratio", "last_close", "nearest_support", "nearest_resistance", "distance_to_support_pct",
    "distance_to_resistance_pct", "bollinger_bandwidth", "bollinger_pct_b", "obv_slope", "obv_r2", "mfi",
]
TOOL_FIELDS = {
    "compute_indicators": {"close": "close", "rsi14": "rsi14", "macd_line": "macd.line", "macd_signal": "macd.signal", "macd_hist": "macd.hist",
                           "sma20": "sma.sma20", "sma50": "sma.sma50", "sma200": "sma.sma200"},
    "trend_strength": {"trend_strength": "strength", "trend_slope_pct_per_day": "slope_pct_per_day", "trend_r2": "r2"},
    "volatility_state": {"realized_vol_annual_pct": "realized_vol_annual_pct", "baseline_vol_annual_pct": "baseline_vol_annual_pct", "vol_ratio": "ratio"},
    "support_resistance_check": {k: k for k in ("last_close", "nearest_support", "nearest_resistance", "distance_to_support_pct", "distance_to_resistance_pct")},
    "bollinger_breakout_scan": {"bollinger_bandwidth": "bandwidth", "bollinger_pct_b": "['%b']"},
    "obv_trend": {"obv_slope": "slope", "obv_r2": "r2"}, "mfi_flow": {"mfi": "mfi"},
}
TOOL_WORDS = {
    "trend_strength": {"trend_direction": "direction"}, "volatility_state": {"vol_state": "state"},
    "bollinger_breakout_scan": {"bollinger_last_event": "last_event"}, "obv_trend": {"obv_trend": "trend"}, "mfi_flow": {"mfi_state": "state"},
}
CROSSES = ["golden_cross", "price_above_sma20", "price_above_sma50", "price_above_sma200"]


def harvest_technical(block: Column) -> Column:
    """Report fields of one ticker's research block (VARIANT): tool results first, then numbers
    read back from its lines."""
    results = P.items(block, "results")
    named = F.transform(results, lambda r: F.struct(F.coalesce(P.get(r, "result.tool"), P.get(r, "tool")).alias("tool"), P.get(r, "result", "variant").alias("r")))

    def of(tool):
        return F.try_element_at(F.filter(named, lambda x: x["tool"] == tool), F.lit(-1))["r"]

    lines = read_back(P.strings(block, "summary_lines"))
    path = lambda r, p, k: F.try_variant_get(r, "$" + (p if p.startswith("[") else "." + p), k)
    num, word = {}, {}
    for tool, fields in TOOL_FIELDS.items():
        num.update({n: path(of(tool), p, "double") for n, p in fields.items()})
    for tool, fields in TOOL_WORDS.items():
        word.update({n: path(of(tool), p, "string") for n, p in fields.items()})
    rows = P.items(of("price_window"), "data")
    first, last = P.get(F.try_element_at(rows, F.lit(1)), "Close", "double"), P.get(F.try_element_at(rows, F.lit(-1)), "Close", "double")
    pct = F.when(F.size(rows) >= 2, F.round(F.try_divide((last - first) * 100.0, first), 2))
    num["price_window_close_pct"] = F.coalesce(lines["price_window_close_pct"], pct)
    for n in ("rsi14", "macd_hist", "trend_strength"):
        num[n] = F.coalesce(num[n], lines[n])
    num["close"] = F.coalesce(num["close"], last, lines["close"], num["last_close"])
    word["trend_direction"] = F.coalesce(word["trend_direction"], lines["trend_direction"])
    cross = {n: path(of("compute_indicators"), f"crosses.{n}", "boolean") for n in CROSSES}
    return F.struct(*[num[n].alias(n) for n in TECHNICAL], *[c.alias(n) for n, c in {**word, **cross}.items()])


def verdict_input(stage_structs: DataFrame, technical: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The compact input of a verdict per post: first asset, timeframe, strength, technical and
    sentiment of that ticker, catalysts, and watchouts with red flags appended (U4)."""
    c = F.col
    df = stage_structs.withColumn("ticker", F.coalesce(F.try_element_at(c("entity")["assets"], F.lit(1))["ticker"], F.lit("")))
    df = df.join(technical, ["post_id", "ticker"], "left").join(sentiment, ["post_id"], "left")
    return df.select(
        "post_id", "ticker", c("direction")["timeframe"].alias("timeframe"), c("direction")["strength"].alias("direction_strength"), "technical",
        F.struct("des_raw", "idio", "conf", "deltas").alias("sentiment"), c("for")["catalysts"].alias("catalysts"),
        F.array_distinct(F.concat(c("context")["watchouts"], c("against")["red_flags"])).alias("watchouts"),
        c("entity")["uncertainty"].alias("uncertainty"), c("context")["stale_risk"].alias("stale_risk"),
    )


def repaired_verdict(df: DataFrame, raw: str = "result") -> DataFrame:
    """A model's verdict made whole: defaults and clamps, technical and sentiment overwritten by
    what was measured, a risk level from the numbers where none was given, two decimals."""
    v = P.load(F.col(raw))
    df = df.withColumn("_v", v)
    g = lambda p, k="string": P.get(F.col("_v"), f"final_metrics.{p}", k)
    whole = lambda p, default, hi: F.least(F.lit(hi), F.greatest(F.lit(0), F.coalesce(g(p, "double"), default))).cast("int")
    t = F.col("technical")
    tech = {n: F.round(F.coalesce(t[n], g(f"technical.{n}", "double")), 2) for n in TECHNICAL}
    flags = {n: F.coalesce(t[n], g(f"technical.{n}", "boolean")) for n in CROSSES}
    trend = F.lower(F.coalesce(t["trend_direction"], g("technical.trend_direction")))
    risk = F.when(tech["price_window_close_pct"] <= -20, 2).otherwise(0) + F.when(tech["macd_hist"] < 0, 1).otherwise(0) + F.when(trend == "down", 1).otherwise(0)
    level = F.coalesce(g("risk_level"), F.when(risk >= 3, "high").when(risk == 2, "medium").otherwise("low"))
    s = F.col("sentiment")
    listed = lambda p, default: F.coalesce(g(p, "array<string>"), default)
    return df.select(
        "post_id", F.coalesce(g("ticker"), "ticker").alias("ticker"), F.coalesce(g("timeframe"), "timeframe", F.lit("long_term")).alias("timeframe"),
        F.coalesce(g("implied_direction"), F.lit("neutral")).alias("implied_direction"),
        F.coalesce(g("direction_strength", "double").cast("int"), "direction_strength", F.lit(0)).alias("direction_strength"),
        whole("conviction_0to100", F.lit(50.0), 100).alias("conviction"), whole("tradability_score_0to100", F.lit(50.0), 100).alias("tradability"),
        whole("uncertainty_0to3", F.col("uncertainty").cast("double"), 3).alias("uncertainty"), whole("stale_risk_0to3", F.col("stale_risk").cast("double"), 3).alias("stale_risk"),
        level.alias("risk_level"), F.struct(*[x.alias(n) for n, x in {**tech, **flags}.items()], trend.alias("trend_direction")).alias("technical"),
        F.struct(*[F.coalesce(s[k].cast("double"), g(f"sentiment.{k}", "double")).alias(k) for k in ("des_raw", "idio", "conf", "deltas")]).alias("sentiment"),
        listed("catalysts", F.col("catalysts")).alias("catalysts"), listed("watchouts", F.col("watchouts")).alias("watchouts"), next_checks(F.col("_v")).alias("next_checks"),
    )


def next_checks(v: Column) -> Column:
    """Conditions in words become (metric, op, value)."""
    def one(x):
        cond = P.get(x, "condition")
        op = F.regexp_extract(F.coalesce(cond, F.lit("")), r"(?i)(crosses above|crosses below|below|above|reclaims)", 1)
        num = F.regexp_extract(F.coalesce(cond, F.lit("")), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
        words = F.when(op != "", F.replace(F.lower(op), F.lit(" "), F.lit("_"))).otherwise(cond)
        return F.struct(P.get(x, "metric").alias("metric"), F.coalesce(P.get(x, "op"), words).alias("op"), F.coalesce(P.get(x, "value", "double"), F.when(op != "", num)).alias("value"))

    return F.transform(P.items(v, "final_metrics.next_checks"), one)


def plain_english(df: DataFrame) -> Column:
    """H-S30: two sentences about a repaired verdict, at most 240 characters."""
    t, s = F.col("technical"), F.col("sentiment")
    d = F.lower(F.col("implied_direction"))
    phrase = F.when(d == "down", "likely to continue lower").when(d == "up", "likely to push higher").otherwise("likely to chop sideways")
    r1 = lambda c: F.round(c, 1).cast("string")
    below = F.array_compact(F.array(*[F.when(t[f"price_above_sma{n}"] == F.lit(False), F.lit(str(n))) for n in (20, 50, 200)]))
    why = F.array_compact(F.array(
        F.when(t["macd_hist"] < 0, F.lit("negative MACD")), F.when(t["rsi14"] < 45, F.concat(F.lit("RSI "), r1(t["rsi14"]), F.lit(" (weak)"))).when(
            t["rsi14"] > 55, F.concat(F.lit("RSI "), r1(t["rsi14"]), F.lit(" (firm)"))),
        F.when(F.size(below) > 0, F.concat(F.lit("below "), F.array_join(below, "/"), F.lit("-DMA"))),
        F.when(t["trend_direction"].isin("up", "down", "flat") & t["trend_strength"].isNotNull(), F.concat(F.lit("trend "), t["trend_direction"], F.lit(" (strength "), t["trend_strength"].cast("int").cast("string"), F.lit(")"))),
    ))
    one = F.concat(
        F.coalesce(F.nullif("ticker", F.lit("")), F.lit("the stock")), F.lit(" is "), phrase,
        F.when(t["close"].isNotNull(), F.concat(F.lit(" (last ≈ $"), F.round(t["close"], 2).cast("string"), F.lit(")"))).otherwise(""),
        F.when(F.size(why) > 0, F.concat(F.lit(" on "), F.array_join(why, ", "))).otherwise(""), F.lit("."),
    )
    tilt = F.when(s["des_raw"] >= 0.55, "positive").when(s["des_raw"] <= 0.45, "negative").otherwise("mixed")
    two = F.concat(
        F.lit(" Risk "), F.lower("risk_level"),
        F.when(s["des_raw"].isNotNull() & (s["conf"] >= 0.25), F.concat(F.lit("; sentiment social DES "), F.round(s["des_raw"], 2).cast("string"), F.lit(" ("), tilt, F.lit("), conf "), F.round(s["conf"], 2).cast("string"))).otherwise(""),
        F.lit("."),
    )
    full = F.concat(one, two)
    return F.when(F.length(full) > 240, F.concat(F.rtrim(F.substring(full, 1, 237)), F.lit("…"))).otherwise(full)


# ---- listing ------------------------------------------------------------------------------------
def post_list(posts: DataFrame, stages: DataFrame, interest: DataFrame) -> DataFrame:
    """C17: list rows with flags, preview, markets, signal and summary, from one pivot of the stages
    instead of several look-ups per row."""
    names = ["entity", "direction", "moderator", SUMMARY, "chairman"]
    pay = PO.latest_stage_columns(stages, names)
    flags = PO.stage_flags(stages)
    j = posts.join(flags, "post_id", "left").join(pay, "post_id", "left").join(interest.drop("title"), "post_id", "left")
    load = lambda n: P.parse(F.coalesce(F.col(n), F.lit("{}")))
    j = j.withColumns({"_e": P.entity(load("entity")), "_s": P.summary(load(SUMMARY)), "_c": load("chairman")})
    return j.select(
        "post_id", F.coalesce("title", F.lit("")).alias("title"), "platform", "source", "url", "scraped_at", "posted_at",
        PO.preview(F.col("text")).alias("preview"), *[F.coalesce(n, F.lit(False)).alias(n) for n in ("has_summary", "has_analysis")],
        P.markets(F.col("_e")).alias("markets"), P.signal_view(load("direction"), load("moderator")).alias("signal"),
        F.col("_s")["bullets"].alias("summary_bullets"), F.col("_s")["assets"].alias("assets_mentioned"), F.col("_s")["spam_pct"].alias("spam_pct"),
        F.col("_s")["spam_why"].alias("spam_why"), "interest_score", F.col("status").alias("interest_status"),
        F.nullif(P.string(F.col("_c"), "plain_english_result"), F.lit("")).alias("verdict_text"),
        F.nullif(P.string(F.col("_c"), "final_metrics.implied_direction"), F.lit("")).alias("verdict_direction"),
    )


def post_detail(posts: DataFrame, stages: DataFrame, extras: DataFrame, interest: DataFrame) -> DataFrame:
    """C17: a post with its extras and a map of its newest payloads; a payload that does not parse is
    kept as text."""
    latest = PO.latest_payload(stages)
    shown = F.when(F.try_parse_json("payload").isNull(), F.to_json(F.struct(F.col("payload").alias("_raw"), F.lit("json-parse-failed").alias("_error")))).otherwise(F.col("payload"))
    by_stage = latest.groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", shown.alias("p"))))).alias("stages"))
    return posts.join(by_stage, "post_id", "left").join(extras, "post_id", "left").join(interest.drop("title"), "post_id", "left")
