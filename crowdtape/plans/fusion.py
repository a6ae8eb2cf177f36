"""C11: one trade signal per post from its normalised stages, and the checks behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NO_TICKER = "No clear tradable US ticker; treat as avoid."


def spread_share(numbers: Column) -> Column:
    """Quoted spread from labelled numbers; the last bid and ask count."""
    def last(pattern):
        ok = F.filter(numbers, lambda n: F.lower(n["label"]).rlike(pattern) & n["value"].try_cast("double").isNotNull())
        return F.try_element_at(ok, F.lit(-1))["value"].try_cast("double")

    bid, ask = last("bid"), last("ask|offer")
    mid = (bid + ask) / 2.0
    return F.when((ask > 0) & (mid > 0), F.round((ask - bid) / mid, 4))


def is_self_citation(url: Column, source_url: Column) -> Column:
    """J26."""
    a, b = T.domain(url), T.domain(source_url)
    return (a != "") & (a == b)


def evidence_counts(verdicts: Column, source_url: Column) -> dict[str, Column]:
    """Verdicts by status, and evidence strength with outside sources weighing 0.8."""
    def count(f):
        return F.size(F.filter(verdicts, f))

    def outside(v):
        return F.exists(v["citations"], lambda c: ~is_self_citation(c["url"], source_url))

    n = F.greatest(F.lit(1), F.size(verdicts))
    ext = count(lambda v: outside(v) & v["status"].isin("supported", "mixed", "refuted")) / n
    own = count(lambda v: ~outside(v) & v["status"].isin("supported", "mixed")) / n
    strength = F.when(F.size(verdicts) > 0, F.bround(100.0 * (0.8 * ext + 0.2 * own))).otherwise(0).cast("int")
    def with_status(s):
        return count(lambda v: v["status"] == s)

    by = {s: with_status(s) for s in T.VERDICT_VALUES}
    return {"strength": strength, "uncited": count(lambda v: F.size(v["citations"]) == 0), **by}


def ticker_scores(text: Column, tickers: Column, claims: Column, assets: Column) -> Column:
    """Salience of each ticker: cashtags count twice, words once, claims about it and in it, and
    a bonus for being listed as an asset.  Sorted best first."""
    def hits(pattern, where):
        return F.size(F.regexp_extract_all(where, pattern, F.lit(0)))

    def one(t):
        q = F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
        word = F.concat(F.lit(r"\b"), q, F.lit(r"\b"))
        s = F.when(T.looks_us_equity(t), 1.0).otherwise(0.0)
        s = s + 2.0 * hits(F.concat(F.lit(r"\$"), q, F.lit(r"(?![A-Za-z0-9])")), text) + 1.0 * hits(word, text)
        s = s + 2.0 * F.size(F.filter(claims, lambda c: F.lower(F.trim(F.coalesce(c["entity"], F.lit("")))) == F.lower(t)))
        s = s + 1.0 * F.size(F.filter(claims, lambda c: F.regexp_count(c["text"], word) > 0))
        s = s + 1.0 * F.size(F.filter(assets, lambda a: F.upper(a["ticker"]) == t))
        return F.struct(s.alias("score"), t.alias("ticker"))

    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["ticker"] < b["ticker"], -1).when(a["ticker"] > b["ticker"], 1).otherwise(0)
    return F.array_sort(F.transform(tickers, one), order)


def penalised(base: Column, *cuts: Column) -> Column:
    """A19."""
    out = base
    for c in cuts:
        out = out - c
    return F.least(F.lit(100), F.greatest(F.lit(0), out)).cast("int")


def missing_whys(items: Column) -> Column:
    """List entries without a reason of their own."""
    return F.size(F.filter(items, lambda x: x["why"].startswith("auto-fixed")))


def fuse(posts: DataFrame) -> DataFrame:
    """C11.  ``posts`` carries post_id, text, url, platform and the normalised stage structs entity,
    summariser, claims, verifier, context, for, against, direction.

    Everything is an expression over one row: no shuffle, no loop over claims or tickers outside it.
    """
    c = F.col
    text = F.coalesce(c("text"), F.lit(""))
    summ, ent, ctx, bull, bear, dirn = (c(n) for n in ("summariser", "entity", "context", "for", "against", "direction"))
    us_markets = ["US", "NASDAQ", "NYSE", "OTC"]
    from_entity = F.transform(F.filter(ent["assets"], lambda a: T.looks_us_equity(a["ticker"]) & (a["market"].isNull() | a["market"].isin(us_markets))), lambda a: a["ticker"])
    from_summary = F.transform(F.filter(summ["assets"], lambda a: a["ticker"].isNotNull() & T.looks_us_equity(a["ticker"])), lambda a: a["ticker"])
    df = posts.withColumns(
        {
            "_tickers": F.array_sort(F.array_distinct(F.concat(from_entity, from_summary))), "_cash": T.cashtags(text),
            "_isins": T.isins(text), "_lev": T.leverage(text), "_spread": spread_share(summ["numbers"]),
        }
    )
    df = df.withColumn("_scores", ticker_scores(text, c("_tickers"), c("claims"), summ["assets"]))
    n = F.size("_tickers")
    first, second = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))
    clear = (first["score"] >= 1.5 * second["score"]) | (first["score"] - second["score"] >= 3.0)
    lead = F.when(n == 1, F.get("_tickers", F.lit(0))).when((n > 1) & clear, first["ticker"])
    listed = F.exists(summ["assets"], lambda a: F.upper(a["ticker"]) == lead)
    tags = F.size(F.filter("_cash", lambda t: t == lead))
    weak = (n > 1) & lead.rlike("^[A-Z]{1,2}$") & (tags < 2) & ~F.coalesce(listed, F.lit(False))
    lead = F.when(F.coalesce(weak, F.lit(False)), F.lit(None).cast("string")).otherwise(lead)
    overlap = F.filter("_cash", lambda t: F.array_contains(c("_tickers"), t))
    lead = F.when(F.size("_cash") == 1, F.get("_cash", F.lit(0))).when((F.size("_cash") > 1) & (F.size(overlap) == 1), F.get(overlap, F.lit(0))).otherwise(lead)
    df = df.withColumn("ticker", lead)
    pool = F.filter("_tickers", lambda t: ~t.eqNullSafe(c("ticker")))
    df = df.withColumn("_basket", F.when(F.size(pool) >= 2, F.slice(pool, 1, 10)).otherwise(F.array().cast("array<string>")))
    market = F.try_element_at(F.filter(ent["assets"], lambda a: F.upper(a["ticker"]) == c("ticker")), F.lit(1))["market"]
    ev = evidence_counts(c("verifier"), c("url"))
    df = df.withColumns({"market": market, "_ev": ev["strength"], "_sup": ev["supported"], "_ref": ev["refuted"], "_ins": ev["insufficient"], "_nocite": ev["uncited"]})

    basket, spread, lev = c("_basket"), c("_spread"), c("_lev")
    watching = c("ticker").isNull() & (F.size(basket) > 0)
    unproven = F.forall(c("verifier"), lambda v: v["status"] == "insufficient")
    poll = T.asks_poll(text) & (n >= 2) & (F.size(summ["catalysts"]) == 0) & unproven
    is_poll, is_help = (c("_ev") == 0) & poll, T.is_help_post(text)
    df = df.withColumns({"_poll": is_poll, "_help": is_help, "_forced": is_poll | is_help})
    when_list = lambda cond, s: F.when(cond, F.array(F.lit(s) if isinstance(s, str) else s)).otherwise(F.array().cast("array<string>"))
    unmapped = when_list(c("ticker").isNull() & (F.size(basket) == 0), "Multiple/unspecified instruments; mapping may be non-equity (fx/futures/krx)")
    reasons = F.concat(
        unmapped, when_list(c("_poll"), "Speculative poll / no thesis and no verified evidence"),
        when_list(c("_help"), "Educational/help post (no actionable thesis)"), when_list(c("_help"), "Educational/help post (no actionable thesis)"),
    )
    points = F.filter(bull["bull_points"], lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"^\$?[A-Z][A-Z0-9.\-]{0,9}$"))
    df = df.withColumns({"_reasons": reasons, "_b0": F.get(points, F.lit(0)), "_a0": F.get(bear["bear_points"], F.lit(0))})
    pct = F.format_string("%.1f", spread * 100)
    has_lev = lev["factor"].isNotNull()
    lev_text = lambda side: F.concat(F.coalesce(lev["side"], F.lit(side)), F.lit(" ×"), lev["factor"].cast("string"))
    notes = F.concat(
        when_list(c("_b0").isNotNull(), F.concat(F.lit("Bull: "), c("_b0"))), when_list(c("_a0").isNotNull(), F.concat(F.lit("Bear: "), c("_a0"))),
        when_list(spread.isNotNull(), F.concat(F.lit("Liquidity: spread ≈ "), pct, F.lit("%"))),
        when_list(has_lev, F.concat(F.lit("Product mechanics: "), lev_text("leveraged"), F.lit(" ETP — path-dependent, issuer-priced"))),
        when_list(F.size("_isins") > 0, "ISIN detected → likely structured product; quotes may decouple intraday"),
        when_list(watching, F.concat(F.lit("Basket monitor: observing "), F.array_join(basket, ", "))),
    )
    zero = c("_ev") == 0
    cap = lambda k: F.when(zero, F.least(bull["setup"][k], F.lit(1))).otherwise(bull["setup"][k])
    taken = summ["stance"].isin("bullish", "bearish")
    wide = F.coalesce(spread >= 0.05, F.lit(False))
    floor_ok = taken & c("_b0").isNotNull() & (ctx["stale_risk"] <= 1) & ~wide
    conf = 0.05 + 0.20 * c("_ev") / 100.0 + F.when(taken, 0.10).otherwise(0.0) + F.when(cap("evidence_specificity") >= 2, 0.10).otherwise(0.0)
    conf = conf + F.when(cap("timeliness") >= 2, 0.05).otherwise(0.0) - F.when(wide, 0.10).otherwise(0.0)
    conf = F.greatest(F.lit(0.05), F.least(F.lit(0.70), conf))
    conf = F.when((F.size("_isins") > 0) | has_lev, F.least(conf, F.lit(0.20))).otherwise(conf)
    decided = dirn["implied_direction"] != "uncertain"
    action = (
        F.when(c("_forced"), "no_trade").when(~decided, "monitor").when(zero & floor_ok, "paper_trade").when(zero, "monitor")
        .when(conf >= 0.50, "consider_small_size").otherwise("paper_trade")
    )
    conf = F.when(c("_forced"), 0.0).when(zero, F.least(conf, F.lit(0.15))).otherwise(conf)
    strength = F.when(c("_forced"), 0).otherwise(c("_ev"))
    blocks = F.concat(
        F.when(c("_forced"), c("_reasons")).otherwise(F.array().cast("array<string>")), when_list(wide, "Illiquidity / wide spread"),
        when_list(zero & ~c("_forced"), "No verified catalysts/evidence"), when_list(c("_forced") & ~watching, NO_TICKER),
        when_list(has_lev, F.concat(F.lit("Leveraged ETP ("), lev_text("unknown"), F.lit(") — path dependency / resets / issuer spread"))),
    )
    rationale = F.when(c("_forced"), F.concat(F.transform("_reasons", lambda r: F.concat(F.lit("Bear: "), r)), notes)).otherwise(notes)
    rationale = F.when(F.size(rationale) > 0, rationale).otherwise(F.array(F.lit("No clear edge identified.")))
    tops = [F.when(x, 1).otherwise(0) for x in (ent["why"].startswith("auto-fixed"), summ["why"].startswith("auto-fixed"), ctx["why"].startswith("auto-fixed"))]
    top_fix = tops[0] + tops[1] + tops[2]
    inner = missing_whys(c("claims")) + missing_whys(c("verifier"))
    fallback = (F.size("verifier") > 0) & F.forall("verifier", lambda v: F.contains(F.lower(v["why"]), F.lit("auto-fallback")))
    uncited = F.when(fallback, 0).otherwise(c("_nocite"))
    info = penalised(F.when(c("_forced"), 5).otherwise(35), 10 * F.least(top_fix, F.lit(3)), 5 * F.least(inner, F.lit(4)))
    clarity = penalised(F.when(c("_forced"), 5).otherwise(25), 5 * F.least(inner, F.lit(4)))
    evidence = penalised(strength, 10 * F.least(uncited, F.lit(3)))
    audit = F.transform(
        c("claims"),  # J23: a claim without a verdict is insufficient
        lambda cl: F.struct(cl["id"].alias("id"), cl["text"].alias("text"),
                            F.coalesce(F.try_element_at(F.filter(c("verifier"), lambda v: v["id"] == cl["id"]), F.lit(-1))["status"], F.lit("insufficient")).alias("verdict")),
    )
    checks = F.concat(
        F.array(F.lit("Locate dated catalysts (filings/news)."), F.lit("Check volume and spread trend."), F.lit("Validate key claims via reliable sources.")),
        F.when((F.size("_isins") > 0) | has_lev, F.array(
            F.lit("Read the ETP’s KID/prospectus: reset rules, daily factor mechanics, and financing costs."),
            F.lit("Check if product has knock-out/barrier and how intraday calculation works."),
            F.lit("Compare intraday issuer quotes vs. underlying chart for that window."))).otherwise(F.array().cast("array<string>")),
        when_list(watching, F.concat(F.lit("Observe basket intraday: "), F.array_join(basket, ", "), F.lit(" (breadth, yields, futures/ETF alignment)"))),
    )
    return df.select(
        "post_id", T.signal_id(T.source_type(c("platform"), c("post_id"), c("url")), text).alias("signal_id"), "ticker", "market",
        F.when(c("_forced"), "uncertain").otherwise(dirn["implied_direction"]).alias("direction"),
        F.when(c("_forced"), "uncertain").otherwise(dirn["timeframe"]).alias("timeframe"),
        F.when(zero, F.least(dirn["strength"], F.lit(1))).otherwise(dirn["strength"]).alias("strength"),
        F.round(conf, 2).alias("confidence"), action.alias("action"), spread.alias("spread"),
        info.alias("information_quality"), clarity.alias("trade_clarity"), evidence.alias("evidence_strength"),
        rationale.alias("rationale"), blocks.alias("blocking_issues"), basket.alias("watchlist"), audit.alias("audit_claims"),
        checks.alias("next_checks"), T.option_contracts(text).alias("options_seen"), c("_isins").alias("isins_seen"),
        c("_sup").alias("supported"), c("_ref").alias("refuted"), c("_ins").alias("insufficient"),
    )
