"""Stage payloads, fusion, verdicts, interest and listings over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as PL
from ..functions import text as T
from ..operators import evidence as E
from ..plans import backtest as B
from ..plans import fusion as FU
from ..plans import reports as R
from ..plans import snapshot as S
from . import fixtures as X
from .market import big, r4, sql
from .registry import query

SYMBOLS = 100


def _sym(c):
    """A US-style symbol AA..DV from a number."""
    n = F.pmod(c, F.lit(SYMBOLS))
    return F.concat(F.chr((F.lit(65) + F.floor(n / 26)).cast("long")), F.chr((F.lit(65) + n % 26).cast("long")))


def payload_columns(spark, sf):
    """Posts with one payload text per stage, varied by document number and labels."""
    p = X.posts(spark, sf).withColumn("n", F.col("post_id").cast("long"))
    lb = X.table(spark, sf, "labels").select(F.col("doc_id").alias("n"), "quality", "toxic")
    p = p.join(lb, "n", "left").fillna(0, ["quality", "toxic"])
    n = F.col("n")
    a, b = _sym(n), _sym(n + 7)
    js = lambda *cols: F.to_json(F.struct(*cols))
    asset = lambda t: F.struct(t.alias("ticker"), F.lit("NASDAQ").alias("market"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("Supported", "refuted", "partial", "unknown")]), (n % 4 + 1).cast("int"))
    site = F.when(n % 3 == 0, F.col("url")).otherwise(F.lit("https://news.example.org/a"))
    cite = F.array(F.struct(site.alias("url"), F.lit("rss").alias("source")))
    none = F.array().cast("array<struct<url:string,source:string>>")
    return p.withColumns(
        {
            "text": F.concat(F.when(n % 2 == 0, F.concat(F.lit("$"), a, F.lit(" "))).otherwise(""), F.col("text")),
            "entity": js(F.array(asset(a), asset(b)).alias("Assets"), F.lit("Swing").alias("time_hint"), (n % 5).alias("uncertainty"), F.lit("w").alias("why")),
            "summariser": js(
                F.array(F.lit("point"), F.lit(" ")).alias("summary_bullets"), F.array(F.struct(a.alias("ticker"))).alias("assets_mentioned"),
                F.when(n % 3 == 0, F.array(F.lit("Yes"))).otherwise(F.array(F.lit("fda"), F.lit("deal"))).alias("claimed_catalysts"),
                F.array(F.struct(F.lit("bid").alias("label"), F.lit("1.00").alias("value")), F.struct(F.lit("ask price").alias("label"), (1.0 + (n % 10) / 100.0).cast("string").alias("value"))).alias("numbers_mentioned"),
                F.when(n % 2 == 0, "Bullish").otherwise("neutral").alias("author_stance"), F.concat((n % 100).cast("string"), F.lit("%")).alias("spam_likelihood_pct"),
                F.lit("w").alias("why")),
            "claims": js(F.array(F.struct(F.lit("c1").alias("id"), F.concat(a, F.lit(" will rise")).alias("text"), F.array(a).alias("entity"), F.lit("w").alias("why"))).alias("claims")),
            "verifier": js(F.array(
                F.struct(F.lit("c1").alias("id"), status.alias("status"), F.lit(0.5).alias("confidence"), F.when(n % 5 == 0, none).otherwise(cite).alias("citations"), F.lit("w").alias("why")),
                F.struct(F.lit("c2").alias("id"), F.lit("mixed/partial").alias("status"), F.lit(2.0).alias("confidence"), cite.alias("citations"), F.lit("").alias("why"))).alias("verdicts")),
            "context": js((n % 4).alias("stale_risk_level"), F.array(F.lit("Watch volume")).alias("watchouts"), F.lit("w").alias("why")),
            "for": js(F.array(F.struct(F.lit("Strong demand").alias("claim"), F.lit("orders").alias("why"))).alias("bull_points"), F.struct((n % 4).alias("timeliness"), (n % 3 + 1).alias("evidence_specificity")).alias("setup_quality")),
            "against": js(F.array(F.lit("Debt")).alias("bear_points"), F.array(F.lit("Watch volume"), F.lit("dilution")).alias("red_flags")),
            "direction": js(F.when(n % 4 == 3, "unknown").when(n % 2 == 0, "bullish").otherwise("down").alias("implied_direction"), (n % 6).alias("strength")),
        }
    )


def council(spark, sf):
    return PL.normalised(payload_columns(spark, sf))


SYM = "chr(CAST(65 + ({x} % 100) // 26 AS INTEGER)) || chr(CAST(65 + ({x} % 100) % 26 AS INTEGER))"
BASE = f"""SELECT post_id, url, CAST(post_id AS BIGINT) AS n, {SYM.format(x='CAST(post_id AS BIGINT)')} AS a, {SYM.format(x='(CAST(post_id AS BIGINT) + 7)')} AS b FROM posts"""


@query("hj3_entities", "H-J3 H-J1 H-J2 H-S9 H-S12", sql(f"""
    WITH p AS ({BASE}) SELECT post_id, a || ',' || b AS tickers, 'NASDAQ,NASDAQ' AS markets, 'swing_days' AS time_hint, CAST(least(3, n % 5) AS BIGINT) AS uncertainty FROM p"""))
def hj3(spark, sf):
    e = council(spark, sf).select("post_id", "entity.*")
    return e.select("post_id", F.array_join(F.transform("assets", lambda x: x["ticker"]), ",").alias("tickers"),
                    F.array_join(F.transform("assets", lambda x: x["market"]), ",").alias("markets"), "time_hint", F.col("uncertainty").cast("long").alias("uncertainty"))


@query("hs26_spam", "H-S26 H-J3", sql(f"WITH p AS ({BASE}) SELECT post_id, n % 100 AS spam_pct, CASE WHEN n % 2 = 0 THEN 'bullish' ELSE 'neutral' END AS stance, 1 AS bullets FROM p".replace("1 AS bullets", "CAST(1 AS BIGINT) AS bullets")))
def hs26(spark, sf):
    s = council(spark, sf).select("post_id", "summariser.*")
    return s.select("post_id", F.col("spam_pct").cast("long").alias("spam_pct"), "stance", F.size("bullets").cast("long").alias("bullets"))


@query("a18_evidence_strength", "A18 J26 J23", sql(f"""
    WITH p AS ({BASE}), q AS (SELECT *, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 3 = 0 THEN 0 ELSE 1 END AS ext1, CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS ext2,
       CASE n % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'mixed' ELSE 'insufficient' END AS st FROM p)
    SELECT post_id, CAST(round_even(100*(0.8::DOUBLE*((CASE WHEN ext1=1 AND st <> 'insufficient' THEN 1 ELSE 0 END) + ext2)/2.0 + 0.2::DOUBLE*((CASE WHEN ext1=0 AND st IN ('supported','mixed') THEN 1 ELSE 0 END) + (1-ext2))/2.0), 0) AS BIGINT) AS strength,
      CAST((st = 'supported')::INT AS BIGINT) AS supported, CAST((st = 'mixed')::INT + 1 AS BIGINT) AS mixed, CAST((n % 5 = 0)::INT AS BIGINT) AS uncited FROM q"""))
def a18(spark, sf):
    df = council(spark, sf)
    ev = FU.evidence_counts(F.col("verifier"), F.col("url"))
    return df.select("post_id", *[ev[k].cast("long").alias(k) for k in ("strength", "supported", "mixed", "uncited")])


@query("a20_quoted_spread", "A20 H-S11", sql(f"WITH p AS ({BASE}) SELECT post_id, CASE WHEN n % 10 = 0 THEN 0.0::DOUBLE ELSE round(((1.0 + (n % 10)/100.0) - 1.0::DOUBLE) / (((1.0 + (n % 10)/100.0) + 1.0::DOUBLE)/2.0), 4) END AS spread FROM p"))
def a20(spark, sf):
    return council(spark, sf).select("post_id", FU.spread_share(F.col("summariser.numbers")).alias("spread"))


@query("c11_signal_fusion", "C11 A18 A19 A20 A21 J23 J26 J29 H-S3 H-S4 H-S5 H-S25")
def c11(spark, sf):
    return FU.fuse(council(spark, sf))


@query("a19_quality_scores", "A19 C11", sql(f"""
    WITH p AS ({BASE}) SELECT post_id, CAST(CASE WHEN help THEN 0 ELSE 30 END AS BIGINT) AS information_quality, CAST(CASE WHEN help THEN 0 ELSE 20 END AS BIGINT) AS trade_clarity
    FROM (SELECT p.*, regexp_matches(lower(x.text), 'what happened|can someone explain|i don.t understand|why did|how did|what did i do wrong|help|confused') AS help FROM p JOIN posts x USING (post_id))"""))
def a19(spark, sf):
    return big(FU.fuse(council(spark, sf)).select("post_id", "information_quality", "trade_clarity"), "information_quality", "trade_clarity")


@query("a21_primary_tickers", "A21 H-J6", sql(f"""
    WITH p AS ({BASE}), t AS (SELECT p.post_id, regexp_extract_all(CASE WHEN n % 2 = 0 THEN '$' || a || ' ' ELSE '' END || q.text, '\\$([A-Za-z]{{1,5}})(?:[^A-Za-z0-9]|$)', 1) AS tags FROM p JOIN posts q USING (post_id))
    SELECT post_id, upper(tags[1]) AS ticker FROM t WHERE len(tags) = 1"""))
def a21(spark, sf):
    """Posts with exactly one cashtag are about it."""
    df = council(spark, sf)
    one = df.filter(F.size(T.cashtags(F.col("text"))) == 1)
    return FU.fuse(one).select("post_id", "ticker")


def verdict_stages(spark, sf):
    """Verdict payload rows for the typed view."""
    p = payload_columns(spark, sf)
    n = F.col("n")
    body = F.to_json(F.struct(F.lit("text").alias("plain_english_result"), F.struct(
        _sym(n).alias("ticker"), F.lit("swing_days").alias("timeframe"), F.when(n % 2 == 0, "up").otherwise("down").alias("implied_direction"),
        (n % 4).alias("direction_strength"), (n % 101).alias("conviction_0to100"), F.lit("low").alias("risk_level"),
        F.struct((n % 90).alias("rsi14"), (n % 2 == 0).alias("price_above_sma20"), F.lit("up").alias("trend_direction")).alias("technical"),
        F.struct(F.lit(0.25).alias("des_raw")).alias("sentiment"), F.array(F.lit("fda")).alias("catalysts")).alias("final_metrics")))
    return p.select("post_id", F.lit("chairman").alias("stage"), F.col("scraped_at").alias("created_at"), body.alias("payload"))


@query("p01_verdict_rows", "P1 J1 P5", sql(f"""
    WITH p AS ({BASE}) SELECT post_id, (SELECT posted_at FROM posts q WHERE q.post_id = p.post_id) AS article_date, a AS ticker, CASE WHEN n % 2 = 0 THEN 'up' ELSE 'down' END AS implied_direction, CAST(n % 101 AS DOUBLE) AS conviction,
      CAST(n % 90 AS DOUBLE) AS rsi14, n % 2 = 0 AS price_above_sma20, 0.25::DOUBLE AS des_raw FROM p"""))
def p01(spark, sf):
    v = B.verdict_rows(verdict_stages(spark, sf), X.posts(spark, sf))
    return v.select("post_id", "article_date", "ticker", "implied_direction", "conviction", "rsi14", "price_above_sma20", "des_raw")


@query("c12_repaired_verdicts", "C12 U4 A26 H-J7 H-S30")
def c12(spark, sf):
    df = council(spark, sf)
    tech_raw = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.lit("compute_indicators").alias("tool"), (F.col("n") % 80).alias("rsi14"), F.struct((-F.col("n") % 7).alias("hist")).alias("macd"))).alias("result")).alias("results"),
        F.array(F.lit("Price window close 12.5 (-25.0%)"), F.lit("Trend down; Strength 2")).alias("summary_lines")))
    src = payload_columns(spark, sf).withColumn("b", PL.parse(tech_raw)).select("post_id", _sym(F.col("n")).alias("ticker"), R.harvest_technical(F.col("b")).alias("technical"))
    sent = payload_columns(spark, sf).select("post_id", PL.parse(F.to_json(F.struct(F.struct(((F.col("n") % 11) / 10.0).alias("des"), F.lit(0.4).alias("conf")).alias("s")))).alias("v"))
    best = PL.best_sentiment(PL.sentiment_nodes(sent, "post_id", "v"), "post_id")
    compact = R.verdict_input(df, src, best)
    out = R.repaired_verdict(compact.withColumn("result", F.lit('{"final_metrics":{"implied_direction":"down","conviction_0to100":150}}')))
    return out.withColumn("plain", R.plain_english(out)).select("post_id", "ticker", "conviction", "risk_level", "plain")


@query("c12_risk_levels", "C12 H-M1", sql("""
    WITH v AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, CAST(doc_id AS BIGINT) AS n, CASE doc_id % 3 WHEN 0 THEN -25.0 WHEN 1 THEN -20.0 ELSE 3.5 END AS pct, doc_id % 7 - 3 AS hist, doc_id % 2 = 0 AS down FROM documents),
    r AS (SELECT *, CASE WHEN pct <= -20 THEN 2 ELSE 0 END + CASE WHEN hist < 0 THEN 1 ELSE 0 END + CASE WHEN down THEN 1 ELSE 0 END AS risk FROM v)
    SELECT post_id, CASE WHEN n % 11 = 0 THEN 'medium' WHEN risk >= 3 THEN 'high' WHEN risk = 2 THEN 'medium' ELSE 'low' END AS risk_level,
      CASE WHEN n % 40 = 0 THEN 50 ELSE least(100, greatest(0, (n % 40) * 5 - 50)) END AS conviction, CASE WHEN n % 2 = 0 THEN 33 ELSE 50 END AS tradability, CASE WHEN n % 5 = 0 THEN 'up' ELSE 'neutral' END AS implied_direction,
      round(CAST(pct AS DOUBLE), 2) AS pct, round(CAST(hist AS DOUBLE), 2) AS macd_hist, CASE WHEN down THEN 'down' ELSE 'up' END AS trend FROM r"""))
def c12_risk(spark, sf):
    """Every branch of the repair: values given, missing and out of range, and risk from what was measured."""
    p, n = payload_columns(spark, sf), F.col("n")
    pct = F.when(n % 3 == 0, "-25.0").when(n % 3 == 1, "-20.0").otherwise("3.5")
    tool = lambda name, *cols: F.struct(F.struct(F.lit(name).alias("tool"), *cols).alias("result"))
    results = F.to_json(F.struct(
        F.array(F.to_json(tool("compute_indicators", F.struct((n % 7 - 3).alias("hist")).alias("macd"))), F.to_json(tool("trend_strength", F.when(n % 2 == 0, "Down").otherwise("up").alias("direction")))).alias("results"),
        F.array(F.concat(F.lit("Price window close 12.5 ("), pct, F.lit("%)"))).alias("summary_lines")))
    # the tools' results differ in their fields, so they are put together as text
    results = F.regexp_replace(F.replace(F.replace(F.replace(results, F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}")), "$", "")
    technical = p.select("post_id", _sym(n).alias("ticker"), R.harvest_technical(PL.parse(results)).alias("technical"))
    none = p.select("post_id", PL.parse(F.lit("{}")).alias("v"))
    compact = R.verdict_input(council(spark, sf), technical, PL.best_sentiment(PL.sentiment_nodes(none, "post_id", "v"), "post_id")).withColumn("n", F.col("post_id").cast("long"))
    said = F.to_json(F.struct(F.struct(
        F.when(n % 11 == 0, "medium").alias("risk_level"), F.when(n % 40 != 0, n % 40 * 5 - 50).alias("conviction_0to100"),
        F.when(n % 2 == 0, 33.7).alias("tradability_score_0to100"), F.when(n % 5 == 0, "up").alias("implied_direction")).alias("final_metrics")))
    out = R.repaired_verdict(compact.withColumn("result", said))
    t = F.col("technical")
    return big(out.select("post_id", "risk_level", "conviction", "tradability", "implied_direction", t["price_window_close_pct"].alias("pct"),
                          t["macd_hist"].alias("macd_hist"), t["trend_direction"].alias("trend")), "conviction", "tradability")


def market_symbols(spark, sf):
    """Daily bars renamed to the symbols used by the payloads."""
    b = X.daily_bars(spark, sf)
    return b.withColumn("symbol", _sym(F.regexp_extract("symbol", r"(\d+)", 1).cast("long"))).groupBy("symbol", "interval", "ts").agg(
        F.min_by("open", "close").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.sum("volume").alias("volume"))


def stage_rows(spark, sf):
    p = payload_columns(spark, sf).filter(F.col("quality") == 1)
    return p.select("post_id", F.lit("summariser").alias("stage"), F.col("scraped_at").alias("created_at"), F.col("summariser").alias("payload"))


@query("c02_interest_scores", "C2 C3 L9 H-M2 P20")
def c02(spark, sf):
    posts = payload_columns(spark, sf).drop("entity", "summariser", "claims", "verifier", "context", "for", "against", "direction", "quality", "toxic")
    # prices lie years before the posts: move them next to each other
    posts = posts.withColumn("posted_at", F.col("posted_at") - F.expr("INTERVAL 25 YEARS")).withColumn("scraped_at", F.col("scraped_at") - F.expr("INTERVAL 25 YEARS"))
    tick = posts.select("post_id", _sym(F.col("n")).alias("ticker"), F.lit(0.9).alias("confidence"))
    nov = E.novelty(posts.select(_sym(F.col("n")).alias("ticker"), "post_id", F.col("posted_at").alias("at"), "text"))
    return R.interest_scores(posts, stage_rows(spark, sf), tick, market_symbols(spark, sf), nov)


@query("c02_interest_errors", "C2 L9", sql("""
    SELECT status, error_code, count(*) AS posts FROM (SELECT CASE WHEN coalesce(quality, 0) = 1 THEN 'ok' ELSE 'error' END AS status, CASE WHEN coalesce(quality, 0) <> 1 THEN 'summary_not_found' END AS error_code FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL"""))
def c02_errors(spark, sf):
    return c02(spark, sf).groupBy("status", "error_code").agg(F.count(F.lit(1)).alias("posts"))


@query("c01_snapshots_as_of", "C1 J15 D10", sql("""
    WITH q AS (SELECT DISTINCT s.symbol, CAST(s.ts AS TIMESTAMP) AS as_of FROM signals s),
    r AS (SELECT q.as_of, b.*, row_number() OVER (PARTITION BY q.symbol, q.as_of ORDER BY b.ts DESC) AS k FROM q JOIN bars b ON b.symbol = q.symbol AND b.ts <= q.as_of)
    SELECT symbol, as_of, max(ts) AS "asof", round(arg_max(close, ts),8) AS close, round(CASE WHEN count(*) FILTER (WHERE k <= 20) = 20 THEN avg(close) FILTER (WHERE k <= 20) END,4) AS sma20,
      round(CASE WHEN count(*) FILTER (WHERE k <= 50) = 50 THEN avg(close) FILTER (WHERE k <= 50) END,4) AS sma50 FROM r GROUP BY symbol, as_of"""))
def c01_as_of(spark, sf):
    from .market import r8

    req = X.signals(spark, sf).select("symbol", F.col("ts").alias("as_of")).distinct()
    out = S.snapshots_at(X.daily_bars(spark, sf), req)
    return r8(r4(out.select("symbol", "as_of", "asof", "close", "sma20", "sma50"), "sma20", "sma50"), "close")


@query("c01_series_equals_tail", "C1", sql("""
    SELECT 'same' AS outcome, count(DISTINCT symbol) AS symbols FROM bars"""))
def c01_series(spark, sf):
    """The report of the series form at each last bar against the tail form."""
    bars = X.daily_bars(spark, sf)
    cols = ["trend_strength", "trend_direction", "vol_state", "last_event", "last_event_date", "obv_trend", "mfi_state", "golden_cross",
            "rsi14", "macd_hist", "mfi", "trend_r2", "vol_ratio", "nearest_support", "nearest_resistance", "pct_b", "ret5d_pct", "ret_std_pct", "obv_r2"]
    a = S.technical_snapshot(bars).select("symbol", "asof", F.struct(*cols).alias("a"))
    b = S.snapshot_series(bars).select("symbol", "asof", F.struct(*cols).alias("b"))
    diff = F.lit(False)
    for i, c in enumerate(cols):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        diff = diff | (~x.eqNullSafe(y) if i < 8 else ~F.round(x, 5).eqNullSafe(F.round(y, 5)))
    return a.join(b, ["symbol", "asof"]).groupBy(F.when(diff, "differs").otherwise("same").alias("outcome")).agg(F.count(F.lit(1)).alias("symbols"))


@query("c13_research_bundles", "C13 H-S29 A29")
def c13(spark, sf):
    req = X.signals(spark, sf).groupBy("symbol").agg(F.max("ts").alias("as_of")).select(F.concat(F.lit("p"), "symbol").alias("post_id"), F.col("symbol").alias("ticker"), "as_of")
    return R.research_bundle(req, X.daily_bars(spark, sf), X.deltas(spark, sf))


@query("c17_post_list", "C17 J2 J3 W23 H-J9 H-S26", sql("""
    SELECT p.post_id, substr(replace(replace(p.text, chr(10), ' '), chr(13), ' '), 1, 400) AS preview, EXISTS (SELECT 1 FROM stages s WHERE s.post_id = p.post_id AND s.stage = 'summariser') AS has_summary,
      EXISTS (SELECT 1 FROM stages s WHERE s.post_id = p.post_id AND s.stage = 'chairman') AS has_analysis, i.interest_score, i.status AS interest_status FROM posts p LEFT JOIN interest i USING (post_id)"""))
def c17(spark, sf):
    out = R.post_list(X.posts(spark, sf), X.stages(spark, sf), X.interest(spark, sf))
    return out.select("post_id", "preview", "has_summary", "has_analysis", "interest_score", "interest_status")


@query("c17_post_detail", "C17 W23", sql("""
    SELECT p.post_id, CAST(count(DISTINCT s.stage) AS BIGINT) AS n_stages FROM posts p LEFT JOIN stages s USING (post_id) GROUP BY p.post_id"""))
def c17_detail(spark, sf):
    extras = X.posts(spark, sf).select("post_id", F.lit("{}").alias("payload_json")).limit(0)
    out = R.post_detail(X.posts(spark, sf), X.stages(spark, sf), extras, X.interest(spark, sf))
    return out.select("post_id", F.coalesce(F.size("stages"), F.lit(0)).cast("long").alias("n_stages")).withColumn("n_stages", F.greatest("n_stages", F.lit(0).cast("long")))


#: Two counts that vary apart, and a duration of both: the fit solves the normal equations of sums.
DURATIONS = "SELECT lang, doc_id, n_chars / 4.0::DOUBLE AS x, (doc_id % 37) * 3.0::DOUBLE AS z, 3.0::DOUBLE + 0.5 * (n_chars / 4.0) + 2.0 * ((doc_id % 37) * 3.0) + (doc_id % 5) AS d FROM documents"
FIT = """count(*) AS n, regr_sxx(d, x) AS sxx, regr_sxx(d, z) AS szz, regr_sxy(x, z) AS sxz, regr_sxy(d, x) AS sxd, regr_sxy(d, z) AS szd, avg(x) AS mx, avg(z) AS mz, avg(d) AS md"""


def durations(docs):
    x, z = F.col("n_chars") / 4.0, (F.col("doc_id") % 37) * 3.0
    return docs.select("lang", "doc_id", x.alias("article_tokens"), z.alias("summary_tokens"), (3.0 + 0.5 * x + 2.0 * z + (F.col("doc_id") % 5)).alias("duration"))


@query("a22_duration_model", "A22 H-S24", sql(f"""
    WITH f AS (SELECT {FIT} FROM ({DURATIONS})), b AS (SELECT *, (sxd * szz - szd * sxz) / (sxx * szz - sxz * sxz) AS b1, (szd * sxx - sxd * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM f)
    SELECT round(b1, 4) AS token_slope, round(b2, 4) AS summary_slope, round(md - b1 * mx - b2 * mz, 4) AS intercept, n FROM b"""))
def a22(spark, sf):
    from ..operators.timing import duration_state, duration_model

    m = duration_model(duration_state(durations(X.table(spark, sf, "documents"))))
    return m.select(F.round("article_coefficient", 4).alias("token_slope"), F.round("summary_coefficient", 4).alias("summary_slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("a22_predicted_durations", "A22", sql(f"""
    WITH d AS ({DURATIONS}), f AS (SELECT lang, {FIT} FROM d GROUP BY lang),
    b AS (SELECT *, (sxd * szz - szd * sxz) / (sxx * szz - sxz * sxz) AS b1, (szd * sxx - sxd * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM f)
    SELECT doc_id, round(md - b1 * mx - b2 * mz + b1 * x + b2 * z, 4) AS expected FROM d JOIN b USING (lang)"""))
def a22_predicted(spark, sf):
    """Each document's expected time by the model of its language."""
    from ..operators.timing import duration_state, duration_model, predicted_duration

    d = durations(X.table(spark, sf, "documents"))
    both = d.join(duration_model(duration_state(d, ["lang"])), "lang")
    return both.select("doc_id", F.round(predicted_duration(F.col("article_tokens"), F.col("summary_tokens")), 4).alias("expected"))
