"""Reading loosely formatted JSON payloads and bringing each stage's output into one shape.

A payload is parsed once into a VARIANT; every field is then read with a tolerant getter, so a field
of the wrong type becomes NULL and takes its default instead of failing the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MISSING_WHY = "auto-fixed: missing why"


# ---- parsing ------------------------------------------------------------------------------------
def json_text(raw: Column) -> Column:
    """H-J1: the JSON object inside a model's answer: fences and comments removed, comparisons
    written as strings (``"value">=5`` -> ``"value": ">=5"``), cut from the first ``{`` to the last ``}``."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    s = F.regexp_replace(s, r"^```[a-zA-Z]*\s*|\s*```$", "")
    s = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    # a string literal is matched first and kept, so that comment marks inside it are safe
    s = F.regexp_replace(s, r'("(?:\\.|[^"\\])*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    bare = r'("(?:\\.|[^"\\])*")\s*(>=|<=|==|!=|>|<)\s*"?([^,}\]"\n]*?)"?\s*(?=[,}\]])'
    return F.regexp_replace(s, bare, r'$1: "$2$3"')


def parse(raw: Column) -> Column:
    """H-J1: VARIANT of the repaired text, the unrepaired text where that already parses, or NULL."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(json_text(raw)))


def dead_letters(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows whose payload parses (as ``v``) and rows to be looked at."""
    parsed = df.withColumn("v", parse(F.col(col)))
    return parsed.filter("v is not null"), parsed.filter("v is null").drop("v")


def lower_keys(raw: Column) -> Column:
    """H-J2: key names of a JSON text in lower case, at every depth."""
    keys = F.array_distinct(F.regexp_extract_all(raw, F.lit(r'"([^"\\]*[A-Z][^"\\]*)"\s*:'), F.lit(1)))
    return F.aggregate(
        keys, raw,
        lambda acc, k: F.regexp_replace(acc, F.concat(F.lit(r'"\Q'), k, F.lit(r'\E"(\s*:)')), F.concat(F.lit('"'), F.lower(k), F.lit('"$1'))),
    )


def load(raw: Column) -> Column:
    return parse(lower_keys(F.coalesce(raw, F.lit("{}"))))


# ---- getters ------------------------------------------------------------------------------------
def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def items(v: Column, path: str) -> Column:
    """Array at a path as VARIANT elements; anything else is empty."""
    return F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def first_items(v: Column, *paths: str) -> Column:
    """The first of several paths that holds a non-empty array."""
    out = F.array().cast("array<variant>")
    for p in reversed(paths):
        a = get(v, p, "array<variant>")
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def string(v: Column, path: str) -> Column:
    return F.trim(F.coalesce(get(v, path), F.lit("")))


def strings(v: Column, path: str) -> Column:
    return F.filter(F.transform(items(v, path), lambda x: F.trim(get(x, ""))), lambda s: s.isNotNull() & (s != ""))


def scalar_or_first(v: Column, path: str) -> Column:
    a = get(v, path, "array<variant>")
    return F.when(a.isNotNull(), get(F.try_element_at(a, F.lit(1)), "")).otherwise(get(v, path))


def bounded_int(v: Column, path: str, default: int, lo: int = 0, hi: int = 3) -> Column:
    """Whole number clamped to a range; unreadable values take the default."""
    d = get(v, path, "double")
    n = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    clamped = F.when(n.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), n)))  # both skip NULLs
    return F.coalesce(clamped, F.lit(default)).cast("int")


def why(v: Column, default: str = MISSING_WHY) -> Column:
    return F.coalesce(F.nullif(F.trim(get(v, "why")), F.lit("")), F.lit(default))


def reasons(v: Column, path: str) -> Column:
    """H-J4: list of reasons as strings; an object becomes "claim - WHY: why"."""
    def one(x):
        claim = F.coalesce(*[F.nullif(string(x, k), F.lit("")) for k in ("claim", "point", "text", "statement", "summary", "detail", "reason")])
        w = F.nullif(string(x, "why"), F.lit(""))
        both = F.when(claim.isNotNull() & w.isNotNull() & (F.lower(w) != F.lower(claim)), F.concat(claim, F.lit(" — WHY: "), w))
        return F.when(is_object(x), F.coalesce(both, claim, w)).otherwise(F.trim(get(x, "")))

    return F.filter(F.transform(items(v, path), one), lambda s: s.isNotNull() & (s != ""))


# ---- stages -------------------------------------------------------------------------------------
def entity(v: Column) -> Column:
    """H-J3: assets that look like US equities or ISINs, time hint, uncertainty."""
    raw = first_items(v, "assets", "tickers", "symbols", "asset")

    def asset(x):
        name = F.coalesce(*[F.nullif(string(x, k), F.lit("")) for k in ("ticker", "symbol", "tkr", "name")])
        p = T.parse_symbol(F.when(is_object(x), name).otherwise(get(x, "")))
        market = F.coalesce(F.when(is_object(x), T.clean_exchange(get(x, "market"))), p["market"])
        return F.struct(p["ticker"].alias("ticker"), market.alias("market"))

    ok = lambda a: a["ticker"].isNotNull() & ~a["ticker"].rlike(r"^\d+$") & (T.looks_us_equity(a["ticker"]) | T.is_isin(a["ticker"]))
    hint = F.coalesce(scalar_or_first(v, "time_hint"), scalar_or_first(v, "timeframe"))
    return F.struct(
        F.filter(F.transform(raw, asset), ok).alias("assets"),
        T.enum_value(hint, T.TIMEFRAME_VALUES, "uncertain", T.TIMEFRAMES).alias("time_hint"),
        bounded_int(v, "uncertainty", 1).alias("uncertainty"), why(v).alias("why"),
    )


def summary(v: Column) -> Column:
    """H-J3: bullets, assets, catalysts, numbers, stance, flags and spam share."""
    def asset(x):
        t = T.clean_ticker(get(x, "ticker"))
        obj = F.struct(t.alias("ticker"), F.coalesce(t, string(x, "name_or_description")).alias("name"), T.clean_exchange(get(x, "exchange_or_market")).alias("market"))
        plain = F.struct(F.lit(None).cast("string").alias("ticker"), F.trim(get(x, "")).alias("name"), F.lit(None).cast("string").alias("market"))
        return F.when(is_object(x), obj).otherwise(plain)

    def number(x):
        label = string(x, "label")
        p = T.split_percent(T.number_like(T.expand_magnitude(string(x, "value"))), get(x, "unit"))
        val, low = p["value"], F.lower(label)
        unit = F.when(F.contains(low, F.lit("contract")), F.lit("contracts")).otherwise(p["unit"])
        odd = (unit == "%") & (F.abs(val.try_cast("double")) > 50) & low.rlike("price|points|down|up")
        obj = F.struct(label.alias("label"), val.alias("value"), F.when(~F.coalesce(odd, F.lit(False)), unit).alias("unit"))
        plain = F.struct(F.trim(get(x, "")).alias("label"), F.lit("").alias("value"), F.lit(None).cast("string").alias("unit"))
        return F.when(is_object(x), obj).otherwise(plain)

    flag = lambda k: F.coalesce(get(v, f"quality_flags.{k}", "boolean"), F.lit(False))
    return F.struct(
        strings(v, "summary_bullets").alias("bullets"), F.transform(items(v, "assets_mentioned"), asset).alias("assets"),
        strings(v, "claimed_catalysts").alias("catalysts"), strings(v, "claimed_risks").alias("risks"),
        F.transform(items(v, "numbers_mentioned"), number).alias("numbers"),
        T.enum_value(scalar_or_first(v, "author_stance"), T.STANCE_VALUES, "uncertain").alias("stance"),
        F.struct(*[flag(k).alias(k) for k in ("repetition_or_template", "vague_claims", "mentions_spread_or_liquidity")]).alias("flags"),
        T.spam_percent(get(v, "spam_likelihood_pct")).alias("spam_pct"),
        T.reason_text(get(v, "spam_why"), strings(v, "spam_reasons")).alias("spam_why"),
        T.clean_ticker(F.coalesce(get(v, "primary_ticker"), get(v, "primaryticker"))).alias("primary_ticker"), why(v).alias("why"),
    )


def claims(v: Column) -> Column:
    """H-J3: claims with ids, known types and one entity each."""
    def one(x, i):
        return F.struct(
            F.coalesce(F.nullif(string(x, "id"), F.lit("")), F.concat(F.lit("c"), (i + 1).cast("string"))).alias("id"),
            string(x, "text").alias("text"), T.enum_value(scalar_or_first(x, "type"), T.CLAIM_TYPES, "other").alias("type"),
            F.nullif(F.trim(scalar_or_first(x, "entity")), F.lit("")).alias("entity"), why(x).alias("why"),
        )

    return F.filter(F.transform(F.transform(items(v, "claims"), lambda x, i: F.struct(is_object(x).alias("ok"), one(x, i).alias("c"))), lambda r: F.when(r["ok"], r["c"])), lambda c: c.isNotNull())


def verdicts(v: Column) -> Column:
    """H-J3: verdicts with known status, bounded confidence and typed citations."""
    def cite(e):
        src, url = F.lower(string(e, "source")), string(e, "url")
        guess = F.when(F.contains(url, F.lit("reddit.com")), "reddit").when(url.rlike(r"x\.com|twitter\.com"), "x").otherwise("rss")
        return F.struct(
            F.when(src.isin("reddit", "rss", "stocktwits", "x"), src).otherwise(guess).alias("source"), string(e, "title").alias("title"), url.alias("url"),
            F.coalesce(F.nullif(string(e, "published_at"), F.lit("")), F.nullif(string(e, "date"), F.lit(""))).alias("published_at"),
            F.coalesce(F.nullif(string(e, "snippet"), F.lit("")), string(e, "text")).alias("snippet"),
        )

    def one(x):
        vid = F.coalesce(*[F.nullif(string(x, k), F.lit("")) for k in ("id", "claim_id", "claimid")], F.lit(""))
        ev = F.filter(first_items(x, "evidence", "citations"), is_object)
        conf = F.coalesce(get(x, "confidence", "double"), F.lit(0.0))
        return F.struct(
            vid.alias("id"), T.enum_value(scalar_or_first(x, "status"), T.VERDICT_VALUES, "insufficient", T.VERDICT_SYNONYMS).alias("status"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)).alias("confidence"), string(x, "reason").alias("reason"),
            F.transform(ev, cite).alias("citations"), why(x).alias("why"),
        )

    return F.transform(F.filter(items(v, "verdicts"), is_object), one)


def verdicts_or_default(verdict_list: Column, claim_list: Column, reason: str = "Verifier produced no verdicts") -> Column:
    """H-J5: one "insufficient" verdict per claim where there are none."""
    none = F.transform(
        claim_list,
        lambda c: F.struct(
            c["id"].alias("id"), F.lit("insufficient").alias("status"), F.lit(0.0).alias("confidence"),
            F.lit(f"{reason}; defaulting to insufficient.").alias("reason"),
            F.array().cast("array<struct<source:string,title:string,url:string,published_at:string,snippet:string>>").alias("citations"),
            F.lit("Auto-fallback.").alias("why"),
        ),
    )
    return F.when(F.size(verdict_list) > 0, verdict_list).otherwise(none)


def context(v: Column) -> Column:
    def listed(path):
        a = get(v, path, "array<variant>")
        one = F.when(get(v, path).isNotNull() & a.isNull(), F.array(get(v, path)))
        return F.when(a.isNotNull(), F.array_compact(F.transform(a, lambda x: get(x, "")))).otherwise(F.coalesce(one, F.array().cast("array<string>")))

    return F.struct(
        listed("context_bullets").alias("bullets"), listed("watchouts").alias("watchouts"),
        bounded_int(v, "stale_risk_level", 2).alias("stale_risk"), why(v).alias("why"),
    )


def bull_case(v: Column) -> Column:
    q = lambda k: bounded_int(v, f"setup_quality.{k}", 0).alias(k)
    return F.struct(
        reasons(v, "bull_points").alias("bull_points"), reasons(v, "implied_catalysts").alias("catalysts"),
        F.struct(q("evidence_specificity"), q("timeliness"), q("edge_vs_consensus")).alias("setup"),
        reasons(v, "what_would_improve").alias("improve"), why(v).alias("why"),
    )


def bear_case(v: Column) -> Column:
    """H-J3/H-M5: a liquidity worry counts only if its details speak of liquidity."""
    details = get(v, "liquidity_concerns.details")
    said = F.coalesce(get(v, "liquidity_concerns.mentioned", "boolean"), F.lit(False)) & T.mentions_liquidity(details)
    return F.struct(
        reasons(v, "bear_points").alias("bear_points"), reasons(v, "red_flags").alias("red_flags"), reasons(v, "data_gaps").alias("data_gaps"),
        F.struct(said.alias("mentioned"), F.when(said, details).alias("details")).alias("liquidity"), why(v).alias("why"),
    )


def direction(v: Column) -> Column:
    allowed = F.array(*[F.lit(x) for x in ("scalp", "swing", "position", "avoid")])
    suits = F.array_intersect(strings(v, "tradability.suitable_for"), allowed)
    return F.struct(
        T.enum_value(scalar_or_first(v, "implied_direction"), T.DIRECTION_VALUES, "uncertain", T.DIRECTIONS).alias("implied_direction"),
        T.enum_value(scalar_or_first(v, "timeframe"), T.TIMEFRAME_VALUES, "uncertain", T.TIMEFRAMES).alias("timeframe"),
        bounded_int(v, "strength", 0).alias("strength"),
        F.struct(
            F.when(F.size(suits) > 0, suits).otherwise(F.array(F.lit("avoid"))).alias("suitable_for"),
            strings(v, "tradability.blocking_issues").alias("blocking_issues"),
        ).alias("tradability"), why(v).alias("why"),
    )


STAGES = {
    "entity": entity, "summariser": summary, "claims": claims, "verifier": verdicts, "context": context,
    "for": bull_case, "against": bear_case, "direction": direction,
}


def normalised(stage_columns: DataFrame, names=None) -> DataFrame:
    """H-J3: payload text columns named after their stages to normalised structs, each parsed once."""
    names = [n for n in (names or STAGES) if n in stage_columns.columns]
    df = stage_columns.withColumns({f"_v_{n}": load(F.col(n)) for n in names})
    return df.withColumns({n: STAGES[n](F.col(f"_v_{n}")) for n in names}).drop(*[f"_v_{n}" for n in names])


# ---- views over payloads ------------------------------------------------------------------------
def symbols(v: Column) -> Column:
    """H-J6: raw symbols of a summary or entity payload, upper case, distinct."""
    listed = F.concat(*[F.transform(items(v, p), lambda x: F.when(is_object(x), get(x, "ticker")).otherwise(F.lit(None).cast("string"))) for p in ("assets_mentioned", "entities", "assets")])
    flat = F.transform(items(v, "tickers"), lambda x: get(x, ""))
    every = F.transform(F.array_compact(F.concat(listed, flat)), lambda t: F.upper(F.trim(t)))
    return F.array_distinct(F.filter(every, lambda t: t != ""))


def talk_tickers(summ: Column, title: Column, body: Column, n: int = 6) -> Column:
    """H-J6/L10: primary ticker, asset tickers, then cashtags; distinct, the first ``n``."""
    found = F.concat(F.array(summ["primary_ticker"]), F.transform(summ["assets"], lambda a: a["ticker"]), T.cashtags_upper(title), T.cashtags_upper(body))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, n)


def markets(ent: Column, n: int = 8) -> Column:
    return F.slice(F.array_distinct(F.array_compact(F.transform(ent["assets"], lambda a: a["ticker"]))), 1, n)


def primary_ticker(summ: Column, ent: Column) -> Column:
    pick = lambda a: F.try_element_at(F.array_compact(F.transform(a, lambda x: x["ticker"])), F.lit(1))
    return F.coalesce(pick(summ["assets"]), pick(ent["assets"]))


def direction_estimate(dir_payload: Column, stance: Column) -> Column:
    """H-S8: the direction stage's word, else the author's stance as a direction."""
    s = F.lower(F.trim(stance))
    mapped = F.when(s.isin("bullish", "up"), "up").when(s.isin("bearish", "down"), "down").when(s == "", F.lit(None)).otherwise(s)
    return F.coalesce(F.nullif(F.trim(get(dir_payload, "implied_direction")), F.lit("")), mapped, F.lit("uncertain"))


def signal_view(first: Column, second: Column) -> Column:
    """H-J9: bias, direction, stance, verdict and confidence of a payload, or of a fallback payload."""
    fields = ("bias", "direction", "stance", "verdict", "confidence")
    some = F.size(F.json_object_keys(F.to_json(first))) > 0
    v = F.when(F.coalesce(some, F.lit(False)), first).otherwise(second)
    vals = {k: get(v, k) for k in fields}
    vals["bias"] = F.coalesce(vals["bias"], vals["direction"])
    return F.struct(*[c.alias(k) for k, c in vals.items()])


def error_text(detail: Column) -> Column:
    """H-J8: one line of an error object: message, then "key=value" of the other fields."""
    m = F.from_json(detail, "map<string,string>")
    msg = F.trim(F.coalesce(F.nullif(m["error"], F.lit("")), m["message"], F.lit("")))
    rest = F.filter(F.map_entries(m), lambda e: ~e["key"].isin("error", "message") & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))

    def shown(e):
        arr = F.from_json(e["value"], "array<string>")
        is_list = e["value"].startswith("[")
        clean = F.array_join(F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != ""), ", ")
        return F.concat(e["key"], F.lit("="), F.when(is_list, F.concat(F.lit("["), clean, F.lit("]"))).otherwise(F.trim(e["value"])))

    extra = F.array_join(F.transform(rest, shown), "; ")
    return F.when(m.isNull(), detail).when((msg != "") & (extra != ""), F.concat(msg, F.lit(" ("), extra, F.lit(")"))).otherwise(
        F.coalesce(F.nullif(msg, F.lit("")), F.nullif(extra, F.lit("")), detail))


def nesting(v: Column) -> Column:
    """How deep the objects and lists of a variant are nested: the highest count of open brackets."""
    bare = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct(
        (s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))
    return F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def sentiment_nodes(df: DataFrame, key: str, v: str, depth: int | None = None) -> DataFrame:
    """H-J7: every object that has a score and a confidence, at any depth.  The number of levels is that
    of the deepest payload (one number from one pass), unless ``depth`` states it."""
    if depth is None:
        depth = (df.agg(F.max(nesting(F.col(v)))).first()[0] or 0) + 1
    level = df.select(key, F.col(v).alias("node"))
    found = None
    for i in range(depth):
        n = F.col("node")
        score = F.coalesce(get(n, "des_raw", "double"), get(n, "des", "double"))
        idio = F.coalesce(get(n, "idio", "double"), get(n, "des_idio", "double"))
        conf = F.coalesce(get(n, "conf", "double"), get(n, "confidence", "double"))
        cand = level.filter(is_object(n)).select(
            key, F.lit(i).alias("level"), score.alias("des_raw"), idio.alias("idio"), conf.alias("conf"),
            F.coalesce(get(n, "deltas", "double"), get(n, "n", "double")).cast("long").alias("deltas"), F.lower(F.coalesce(get(n, "channel"), F.lit(""))).alias("channel"),
        ).filter((F.col("des_raw").isNotNull() | F.col("idio").isNotNull()) & F.col("conf").isNotNull())
        found = cand if found is None else found.unionByName(cand)
        if i + 1 < depth:
            kids = F.coalesce(F.try_variant_get("node", "$", "array<variant>"), F.map_values(F.try_variant_get("node", "$", "map<string,variant>")))
            level = level.select(key, F.explode(kids).alias("node"))
    return found


def best_sentiment(nodes: DataFrame, key: str) -> DataFrame:
    """The candidate with most and surest fields."""
    c = F.col
    one = lambda x, w: F.when(c(x).isNotNull(), w).otherwise(0.0)
    rating = one("des_raw", 1.0) + one("idio", 0.5) + 0.5 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("conf"))) + F.when(c("channel").isin("social", "news"), 0.25).otherwise(0.0)
    order = F.struct(rating.alias("r"), (-c("level")).alias("l"), c("des_raw"), c("conf"))
    return nodes.groupBy(key).agg(F.max_by(F.struct("des_raw", "idio", "conf", "deltas"), order).alias("s")).select(key, "s.*")
