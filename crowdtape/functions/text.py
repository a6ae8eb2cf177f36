"""Text functions as Column expressions; no Python in the row path."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns, then word lists
CASHTAG = r"\$([A-Za-z]{1,5})(?![A-Za-z0-9])"
CASHTAG_UPPER = r"\$([A-Z]{1,5})\b"
ISIN = r"\b[A-Z]{2}[A-Z0-9]{9}\d\b"
LEVERAGE = r"(?i)\b(long|short)\b.*?\b(?:factor|x)\s*([1-9]\d?)"
OPTION = r"(?i)\b(\d{1,2}/\d{1,2}/\d{2,4})\s*\$?\s*(\d+(?:\.\d+)?)\s*(call|put)s?\b"
NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
SPAN = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|wk|week|weeks)\s*$"

MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]
HELP_PHRASES = [
    "what happened", "can someone explain", "i don't understand", "why did", "how did",
    "what did i do wrong", "help", "confused",
]
POLL_TOKENS = ["who", "which", "what", "favorite", "favourite", "anyone", "tips", "thoughts", "dd", "10x"]
MOVER_TOKENS = ["after hrs", "after-hours", "after hours", "ah ", "ah:", "mover", "halt", "spike", "surge"]
LIQUIDITY_WORDS = [
    "spread", "illiquid", "liquidity", "volume", "thinly", "wide spread", "no volume", "delta",
    "gamma", "hedge", "hedging", "mms", "market maker", "market makers", "dealer", "dealers",
    "vanna", "charm", "delta hedging", "gamma squeeze", "pin risk",
]
TICKER_STOP_WORDS = [
    "THE", "AND", "FOR", "WITH", "LONG", "SHORT", "CALL", "CALLS", "PUT", "PUTS", "A", "TO", "ON",
    "AT", "IN", "OF", "IS", "IT", "IMO", "DD", "BUY", "SELL", "UNDER", "ABOUT",
]
NAME_STOP_WORDS = ["inc", "incorporated", "corp", "corporation", "company", "co", "plc", "ltd", "limited", "the"]
SOCIAL_SITES = ["reddit.com", "x.com", "twitter.com", "stocktwits.com", "t.me", "discord.gg"]
SOCIAL_NAMES = ["reddit", "stocktwits", "x", "twitter"]
NEWS_SITES = ["nasdaq.com", "seekingalpha.com", "bloomberg.com", "reuters.com", "ft.com", "cnbc.com", "wsj.com"]
NEWS_NAMES = ["nasdaq", "reuters", "bloomberg", "news"]
DIRECTIONS = {
    "up": "up", "bull": "up", "bullish": "up", "green": "up", "down": "down", "bear": "down",
    "bearish": "down", "red": "down", "flat": "none", "sideways": "none", "rangebound": "none",
    "uncertain": "uncertain",
}
TIMEFRAMES = {
    "intraday": "intraday", "daytrade": "intraday", "daytrading": "intraday", "swing": "swing_days",
    "swingdays": "swing_days", "swingweeks": "swing_weeks", "weekswing": "swing_weeks",
    "multimonth": "multi_months", "multimonths": "multi_months", "longterm": "long_term",
    "longrun": "long_term",
}
TIMEFRAME_VALUES = ["intraday", "swing_days", "swing_weeks", "multi_months", "long_term", "uncertain"]
STANCE_VALUES = ["bullish", "bearish", "neutral", "uncertain"]
VERDICT_VALUES = ["supported", "refuted", "mixed", "insufficient"]
DIRECTION_VALUES = ["up", "down", "none", "uncertain"]
CLAIM_TYPES = ["valuation", "liquidity", "project_status", "macro_theme", "performance", "other"]
VERDICT_SYNONYMS = {
    "true": "supported", "false": "refuted", "support": "supported", "refute": "refuted",
    "supported": "supported", "refuted": "refuted", "mixed/partial": "mixed", "partial": "mixed",
    "unknown": "insufficient", "n/a": "insufficient",
}
LONG_WORDS = ["call", "calls", "bull", "bullish", "long", "buy", "up"]
SHORT_WORDS = ["put", "puts", "bear", "bearish", "short", "sell", "down"]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(c: Column, parts: list[str]) -> Column:
    """True when the lower-cased text contains one of ``parts``; a search for each, which a long text passes far
    faster than one pattern of alternatives."""
    return let(F.lower(text_or_empty(c)), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in parts]))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(group))


def extract_or_null(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(c), pattern, group), F.lit(""))


def cashtags(text: Column) -> Column:
    """H-S1."""
    return F.transform(find_all(text, CASHTAG, 1), F.upper)


def cashtags_upper(text: Column) -> Column:
    """H-S2."""
    return find_all(F.upper(text), CASHTAG_UPPER, 1)


def isins(text: Column) -> Column:
    """H-S3."""
    return find_all(text, ISIN)


def is_isin(s: Column) -> Column:
    return F.upper(F.trim(text_or_empty(s))).rlike("^" + ISIN + "$")


def leverage(text: Column) -> Column:
    """H-S4: (side, factor) of a leveraged product."""
    side = F.lower(extract_or_null(text, LEVERAGE, 1))
    factor = extract_or_null(text, LEVERAGE, 2).try_cast("int")
    return F.struct(side.alias("side"), factor.alias("factor"))


def option_contracts(text: Column) -> Column:
    """H-S5/J29: distinct (expiry, strike, type) in order of appearance."""
    parts = [find_all(text, OPTION, g) for g in (1, 2, 3)]
    zipped = F.arrays_zip(parts[0].alias("expiry"), parts[1].alias("strike"), parts[2].alias("type"))
    rows = F.transform(
        zipped,
        lambda r: F.struct(r["expiry"].alias("expiry"), r["strike"].alias("strike"), F.lower(r["type"]).alias("type")),
    )
    return F.array_distinct(rows)


def date_tokens(text: Column) -> Column:
    """H-S6: distinct date-like substrings, as written."""
    names = "|".join(MONTHS + [m[:3] for m in MONTHS])
    found = [
        find_all(text, r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"),
        find_all(text, r"\b(\d{1,2})/(\d{1,2})\b"),
        find_all(text, rf"(?i)\b(?:(?:{names}))\s+(\d{{1,2}})(?:,\s*(\d{{4}}))?\b"),
    ]
    return F.array_distinct(F.concat(*found))


def year_tokens(text: Column) -> Column:
    return F.array_distinct(find_all(text, r"\b(20\d{2})\b", 1))


def side_word(word: Column) -> Column:
    """H-S8: long, short or neutral."""
    w = F.lower(F.trim(text_or_empty(word)))
    return F.when(w.isin(LONG_WORDS), "long").when(w.isin(SHORT_WORDS), "short").otherwise("neutral")


def confidence_value(value: Column) -> Column:
    """H-S10: words, percentages, 0..1 or 0..100, to 0..1."""
    v = F.lower(F.trim(value))
    pct = F.nullif(F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).try_cast("double") / 100.0
    num = v.try_cast("double")
    num = F.when(num <= 1, num).otherwise(num / 100.0)
    raw = F.coalesce(
        F.when(v == "low", 0.3).when(v == "medium", 0.6).when(v == "high", 0.9), pct, num
    )
    out = F.when(raw.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return F.when(value.isNotNull(), out)


def trade_call(text: Column) -> Column:
    """H-S7: (tickers, direction, target, confidence) found by patterns; NULL without ticker or side."""
    up = F.upper(text_or_empty(text))
    words = F.array_distinct(find_all(up, r"\b([A-Z]{2,5})\b", 1))
    tickers = F.array_except(words, F.array(*[F.lit(w) for w in TICKER_STOP_WORDS]))
    side = side_word(F.regexp_extract(up, r"\b(LONG|SHORT|CALLS?|PUTS?|BULL(?:ISH)?|BEAR(?:ISH)?)\b", 1))
    target = extract_or_null(text, r"(?i)target[:\s\$]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    conf = F.when(F.contains(text, F.lit("\U0001F680")) | F.contains(up, F.lit("CONFIDENCE")), 0.7).otherwise(0.6)
    call = F.struct(tickers.alias("tickers"), side.alias("direction"), target.alias("target"), conf.alias("confidence"))
    return F.when((F.size(tickers) > 0) & side.isin("long", "short"), call)


def _lookup(token: Column, table: dict[str, str]) -> Column:
    keys = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(keys, token)


def enum_value(value: Column, allowed: list[str], default: str, synonyms: dict[str, str] | None = None) -> Column:
    """H-S9: compare without case, spaces, ``_`` and ``-`` on both sides, then synonyms."""
    token = F.regexp_replace(F.lower(F.trim(text_or_empty(value))), r"[\s_\-]+", "")
    known = {a.replace("_", "").replace("-", ""): a for a in allowed}
    out = _lookup(token, known)
    if synonyms:
        out = F.coalesce(_lookup(token, synonyms), out)
    return F.coalesce(out, F.lit(default))


def expand_magnitude(token: Column) -> Column:
    """H-S11: first ``12.5K``/``M``/``B`` in the text written out."""
    return let(F.trim(text_or_empty(token)), _expanded)


def _expanded(t: Column) -> Column:
    pat = r"(?i)(\d+(?:\.\d+)?)\s*([KMB])"
    num = F.regexp_extract(t, pat, 1)
    unit = F.upper(F.regexp_extract(t, pat, 2))
    mult = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1e9)
    val = num.try_cast("double") * mult
    shown = F.when(val == F.floor(val), F.floor(val).cast("string")).otherwise(val.cast("string"))
    whole = F.regexp_extract(t, pat, 0)
    at = F.locate("\u0001", F.replace(t, whole, F.lit("\u0001")))
    out = F.concat(F.substring(t, F.lit(1), at - 1), shown, F.substring(t, at + F.length(whole), F.length(t)))
    return F.when(whole == "", t).otherwise(out)


def number_like(value: Column) -> Column:
    """H-S11: first number in the text without thousands separators, else the trimmed text."""
    def read(v):
        num = F.regexp_extract(v, NUMBER, 0)
        return F.when(num == "", F.trim(v)).otherwise(F.replace(num, F.lit(","), F.lit("")))

    return let(text_or_empty(value), read)


def split_percent(value: Column, unit: Column) -> Column:
    """H-S11: (value, unit) with a percent sign moved to the unit."""
    return let(F.trim(text_or_empty(value)), lambda v: _split(v, unit))


def _split(v: Column, unit: Column) -> Column:
    num = F.regexp_extract(v, r"(-?\d+(?:\.\d+)?)\s*%", 1)
    plain = F.endswith(v, F.lit("%"))
    return F.struct(
        F.when(num != "", num).when(plain, F.trim(F.regexp_replace(v, "%$", ""))).otherwise(v).alias("value"),
        F.when((num != "") | plain, F.lit("%")).otherwise(unit).alias("unit"),
    )


def clean_ticker(t: Column) -> Column:
    """H-S12: upper-case symbol characters only; blank becomes NULL."""
    return F.nullif(F.upper(F.regexp_replace(F.trim(text_or_empty(t)), r"[^A-Za-z0-9.\-]", "")), F.lit(""))


def clean_exchange(m: Column) -> Column:
    x = F.upper(F.trim(text_or_empty(m)))
    return (
        F.when(x.isin("", "N/A", "NA", "NONE", "UNKNOWN", "UNK", "NULL"), F.lit(None).cast("string"))
        .when(x.isin("NASDAQ", "NASDQ", "NAS"), "NASDAQ")
        .when(x.isin("NYSE", "NEW YORK STOCK EXCHANGE"), "NYSE")
        .when(x.isin("OTC", "OTCBB", "PINK"), "OTC")
        .otherwise(x)
    )


def looks_us_equity(t: Column) -> Column:
    return F.trim(text_or_empty(t)).rlike(r"^[A-Z]{1,5}(?:\.[A-Z]{1,3})?$")


def parse_symbol(raw: Column) -> Column:
    """H-S12: (ticker, market) of ``EXCH:SYM``, ``SYM.SUF`` or ``$SYM``; an ISIN is no symbol."""
    return let(F.regexp_replace(F.trim(text_or_empty(raw)), r"^\$+", ""), _symbol_parts)


def _symbol_parts(r: Column) -> Column:
    colon = F.instr(r, ":") > 0
    left = F.upper(F.trim(F.substring_index(r, ":", 1)))
    whole = F.when(colon, F.trim(F.regexp_replace(r, r"^[^:]*:", ""))).otherwise(r)
    return let(whole, lambda sym: _symbol_struct(r, sym, colon, left))


def _symbol_struct(r: Column, sym: Column, colon: Column, left: Column) -> Column:
    suffix = F.regexp_extract(sym, r"^.*\.([^.]{0,3})$", 1)
    dotted = sym.rlike(r"^.*\.[^.]{0,3}$")
    base = F.when(dotted, F.regexp_extract(sym, r"^(.*)\.[^.]{0,3}$", 1)).otherwise(sym)
    market = F.when(colon, left).when(dotted, F.upper(suffix))
    ticker = F.nullif(F.upper(F.replace(base, F.lit(" "), F.lit(""))), F.lit(""))
    return F.when(
        ~is_isin(r), F.struct(clean_ticker(ticker).alias("ticker"), clean_exchange(market).alias("market"))
    ).otherwise(F.struct(F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("string").alias("market")))


def channel(source: Column, url: Column) -> Column:
    """H-S19: names are matched as words, so that "fox" is not the site "x"."""
    import re

    def words(names):
        return r"\b(?:" + "|".join(map(re.escape, names)) + r")\b"

    def sites(names):
        return r"(?:^|[/.@])(?:" + "|".join(map(re.escape, names)) + ")"

    s, u = F.lower(text_or_empty(source)), F.lower(text_or_empty(url))
    return (
        F.when(u.rlike(sites(SOCIAL_SITES)) | s.rlike(words(SOCIAL_NAMES)), "social")
        .when(u.rlike(sites(NEWS_SITES)) | s.rlike(words(NEWS_NAMES)), "news").otherwise("other")
    )


def source_type(platform: Column, post_id: Column, url: Column) -> Column:
    """H-S20."""
    p, u = F.lower(F.trim(text_or_empty(platform))), F.lower(text_or_empty(url))
    return (
        F.when(p.isin("reddit", "rss", "stocktwits", "x"), p)
        .when(text_or_empty(post_id).rlike("^t[135]_"), "reddit")
        .when(F.contains(u, F.lit("reddit.com")), "reddit")
        .when(F.contains(u, F.lit("stocktwits.com")), "stocktwits")
        .when(F.contains(u, F.lit("x.com")) | F.contains(u, F.lit("twitter.com")), "x").otherwise("rss")
    )


def match_form(c: Column) -> Column:
    """H-S21: lower-case letters and digits separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9]+", " "))


def name_tokens(name: Column) -> Column:
    """H-S21: distinctive words of a company name."""
    words = F.array_distinct(F.split(match_form(name), " "))
    stop = F.array(*[F.lit(w) for w in NAME_STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), stop)


def clip(c: Column, n: int) -> Column:
    """H-S22: whitespace collapsed, first ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")), 1, n)


def snippet(text: Column, terms: Column, window: int = 320) -> Column:
    """H-S22: ``window`` characters around the first listed term that occurs."""
    t = F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))
    low = F.lower(t)
    hits = F.filter(F.transform(terms, lambda x: F.position(F.lower(x), low)), lambda p: p > 0)
    at = F.try_element_at(hits, F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - window // 2)
    end = F.least(F.length(t), start + window)
    body = F.substring(t, start + 1, end - start)
    dots = F.lit("…")
    none = F.concat(F.substring(t, 1, window), F.when(F.length(t) > window, dots).otherwise(""))
    return F.when(at.isNull(), none).otherwise(
        F.concat(F.when(start > 0, dots).otherwise(""), body, F.when(end < F.length(t), dots).otherwise(""))
    )


def words(text: Column) -> Column:
    """H-S23."""
    return find_all(F.lower(text), r"[a-z0-9]+")


def shingles(word_list: Column, k: int = 5) -> Column:
    """H-S23: distinct 64-bit hashes of all runs of ``k`` words; shorter texts have none."""
    def hashed(ws):
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - k + 1, F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + (j - 1)) for j in range(k)]))
        return F.when(F.size(ws) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return let(word_list, hashed)


def jaccard(a: Column, b: Column) -> Column:
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)),
    )


def token_count(text: Column) -> Column:
    """H-S24."""
    t = F.trim(F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", ""))
    n = F.greatest(F.size(F.split(t, r"\s+")), F.ceil(F.length(t) / 4.0))
    return F.when(t == "", F.lit(0)).otherwise(n).cast("long")


def signal_id(kind: Column, text: Column) -> Column:
    """H-S25."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(text_or_empty(text)), 1, 10))


def trade_id(platform: Column, post_id: Column, ticker: Column, direction: Column) -> Column:
    return F.concat_ws("-", platform, post_id, ticker, direction)


def spam_percent(value: Column) -> Column:
    """H-S26: first number of whatever was sent, as an integer from 0 to 100."""
    num = extract_or_null(value.cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    n = F.when(num < 0, F.ceil(num)).otherwise(F.floor(num))
    return F.coalesce(F.least(F.lit(100), F.greatest(F.lit(0), n)), F.lit(0)).cast("int")


def reason_text(one: Column, many: Column) -> Column:
    """H-S26: the reason, else the joined list of reasons."""
    listed = F.array_join(F.filter(F.transform(many, lambda x: F.trim(x)), lambda x: x != ""), "; ")
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), listed, F.lit(""))


def fetch_status(text: Column) -> Column:
    """H-S27."""
    n = F.length(F.trim(F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", "")))
    return F.when(n >= 400, "ok").when(n >= 200, "partial").when(n > 0, "short").otherwise("empty")


def paragraph_count(text: Column) -> Column:
    parts = F.split(text_or_empty(text), "\n\n")
    return F.size(F.filter(parts, lambda p: F.length(F.regexp_replace(p, r"\s+", "")) > 0))


def domain(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def interest_label(score: Column) -> Column:
    """H-S28."""
    return F.when(score >= 85, "urgent").when(score >= 65, "high").when(score >= 40, "medium").otherwise("low")


def source_score(platform: Column) -> Column:
    p = F.lower(text_or_empty(platform))
    return (
        F.when(p.isin("sec", "sedar", "edgar"), 10)
        .when(p.isin("news", "bloomberg", "reuters", "ft", "wsj", "ap", "cnbc"), 9)
        .when(p.isin("company", "pr", "press", "globenewswire", "businesswire"), 6).otherwise(5)
    )


def stance_value(stance: Column) -> Column:
    s = F.lower(text_or_empty(stance))
    return F.when(s.rlike("bull|bear"), 1.0).when(s.rlike("neutral"), 0.4).otherwise(0.2)


def fix_mojibake(s: Column) -> Column:
    """H-S31: undo one wrong latin-1 decoding where the result is valid UTF-8."""
    fits = ~s.rlike(r"[^\u0000-ÿ]")
    raw = F.encode(s, "ISO-8859-1")
    return F.when(fits, F.coalesce(F.try_validate_utf8(raw.cast("string")), s)).otherwise(s)


def clean_paragraphs(text: Column) -> Column:
    """U8: blanks collapsed, repeated paragraphs dropped, order kept."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text_or_empty(text), r"[ \t]+", " ")), r"\n{3,}", "\n\n")
    paras = F.transform(F.split(t, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_join(F.array_distinct(F.filter(paras, lambda p: p != "")), "\n\n")


def clean_lines(text: Column) -> Column:
    """Interface crumbs, very short lines and adjacent repeats dropped."""
    crumbs = r"(?i)^(comments?(?:\s*\(\d+\))?|most popular|trending|share|save|play)\b"
    lines = F.transform(F.split(text_or_empty(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(
        lines,
        lambda x: (x != "") & ~x.rlike(crumbs) & ~((F.length(x) < 6) & ~x.rlike(r"[A-Za-z]\.")),
    )
    # adjacent repeats: compare each line with the one before it
    out = let(kept, lambda ks: F.filter(ks, lambda x, i: (i == 0) | (x != F.get(ks, i - 1))))
    return F.trim(F.regexp_replace(F.array_join(out, "\n"), r"[ \t ]{2,}", " "))


def is_help_post(text: Column) -> Column:
    """P20."""
    return any_of(text, HELP_PHRASES)


def is_mover_post(title: Column, text: Column) -> Column:
    return any_of(F.concat_ws(" ", text_or_empty(title), text_or_empty(text)), MOVER_TOKENS)


def asks_poll(text: Column) -> Column:
    return any_of(text, POLL_TOKENS)


def mentions_liquidity(details: Column) -> Column:
    """H-M5."""
    return any_of(details, LIQUIDITY_WORDS)


def span_seconds(text: Column) -> Column:
    """H-D4: "90m", "6 h", "2 days", "1w" as seconds; NULL for anything else."""
    n = F.nullif(F.regexp_extract(text_or_empty(text), SPAN, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.substring(F.regexp_extract(text_or_empty(text), SPAN, 2), 1, 1))
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return n * size


def stale_bucket(age_days: Column) -> Column:
    """W32."""
    return F.when(age_days <= 3, 0).when(age_days <= 7, 1).when(age_days <= 30, 2).otherwise(3)


def valid_tickers(candidates: Column, universe: Column) -> Column:
    """Cleaned, distinct, in first-seen order, kept if in the universe (an empty one keeps all)."""
    c = F.array_distinct(F.filter(F.transform(candidates, lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    return F.when(F.size(universe) == 0, c).otherwise(F.array_intersect(c, universe))


def fulltext_allowed(url: Column, allow_subscriber_site: bool = False) -> Column:
    """P22."""
    d, path = domain(url), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(d.rlike(r"nasdaqtrader\.com$") & path.rlike(r"/rss\.aspx$"), False)
        .when(d.rlike(r"seekingalpha\.com$"), allow_subscriber_site)
        .otherwise(~d.rlike(r"(?:wsj|bloomberg)\.com$"))
    )
