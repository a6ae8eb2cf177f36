"""Predicates and text rules over texts composed from the test tables, so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as PL
from ..functions import text as T
from ..operators import evidence as E
from ..operators import posts as P
from ..operators import tickers as TK
from ..operators import trading as X2
from ..sources import bars as B
from . import fixtures as X
from .market import sql
from .registry import query

def orders(spark, sf):
    return X.table(spark, sf, "orders")


@query("p05_verdict_window", "P5", """
    SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate BETWEEN DATE '1994-03-01' AND DATE '1996-02-29' AND o_custkey % 2 = 0""")
def p05(spark, sf):
    K = F.col("o_orderkey")
    v = orders(spark, sf).select(
        K.alias("id"), F.when(K % 5 == 0, " ").otherwise(F.concat(F.lit("S"), (K % 3).cast("string"))).alias("ticker"),
        F.when(K % 7 != 0, "up").alias("implied_direction"), F.col("o_orderdate").alias("article_date"), "o_custkey")
    return X2.verdict_window(v, "1994-03-01", "1996-02-29", where="o_custkey % 2 = 0").select("id")


@query("p08_symbols", "P8 H-S13", """
    SELECT sym, regexp_matches(sym, '^Z[A-Z]{3}T$') AS test_symbol, regexp_matches(sym, '(-?W$|/W$|-?U$|/U$|-?R$|/R$)') AS derived,
      CASE WHEN regexp_matches(sym, '[-/](W|WS|WT|U|UN|R)$') THEN regexp_extract(sym, '^(.*)[-/](W|WS|WT|U|UN|R)$', 1) ELSE sym END AS base,
      CASE WHEN regexp_matches(sym, '[-/](W|WS|WT)$') THEN 'WARRANT' WHEN regexp_matches(sym, '[-/](U|UN)$') THEN 'UNIT' WHEN regexp_matches(sym, '[-/]R$') THEN 'RIGHTS' END AS kind,
      count(*) AS rows
    FROM (SELECT CASE p_partkey % 9 WHEN 0 THEN 'ZABCT' WHEN 1 THEN 'P' || p_size || '-W' WHEN 2 THEN 'P' || p_size || '/WS' WHEN 3 THEN 'P' || p_size || '-U' WHEN 4 THEN 'P' || p_size || '/UN'
          WHEN 5 THEN 'P' || p_size || '-R' WHEN 6 THEN 'P' || p_size || 'W' WHEN 7 THEN 'ZABT' ELSE 'P' || p_size END AS sym FROM part) GROUP BY ALL""")
def p08(spark, sf):
    k = F.col("p_partkey") % 9
    size = F.concat(F.lit("P"), F.col("p_size").cast("string"))
    sym = F.when(k == 0, "ZABCT").when(k == 7, "ZABT").when(k == 8, size)
    for i, tail in ((1, "-W"), (2, "/WS"), (3, "-U"), (4, "/UN"), (5, "-R"), (6, "W")):
        sym = sym.when(k == i, F.concat(size, F.lit(tail)))
    s = F.col("sym")
    df = X.table(spark, sf, "part").select(sym.alias("sym"))
    return df.groupBy(s, TK.skip_symbol(s).alias("test_symbol"), TK.is_derived_security(s).alias("derived"), TK.split_suffix(s)["base"].alias("base"), TK.split_suffix(s)["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("p10_rss_drop_list", "P10 P11", sql("""
    SELECT post_id, NOT (CAST(post_id AS BIGINT) % 2 = 0 AND (source = 'src1' OR CAST(post_id AS BIGINT) % 5 = 0)) AS kept, CAST(post_id AS BIGINT) % 3 <> 0 AS missing FROM posts"""))
def p10_list(spark, sf):
    i = F.col("post_id").cast("long")
    p = X.posts(spark, sf).withColumns({
        "platform": F.when(i % 2 == 0, "RSS").otherwise("x"), "domain": F.when(i % 5 == 0, "bad.example").otherwise("good.example"),
        "fetch_status": F.when(i % 3 == 0, " OK ").when(i % 3 == 1, "short")})
    dropped = P.drop_rss(["bad.example"], ["src1"])
    return p.select("post_id", (~dropped).alias("kept"), P.only_missing().alias("missing"))


@query("p17_tradeable", "P17", sql("SELECT signal_id FROM signals WHERE confidence >= 0.4 AND ts >= TIMESTAMP '1996-06-10' - INTERVAL 5 DAY"))
def p17(spark, sf):
    return X2.tradeable(X.signals(spark, sf), 0.4, F.to_timestamp(F.lit("1996-06-10"))).select("signal_id")


@query("p18_valid_tickers", "P18", """
    SELECT o_orderkey AS id, array_to_string([x for x in ['S' || (o_orderkey % 4), 'T' || (o_orderkey % 3)] if o_orderkey % 5 = 0 OR x IN ('S1', 'S2', 'T1')], ',') AS tickers FROM orders""")
def p18(spark, sf):
    K = F.col("o_orderkey")
    s, t = (F.concat(F.lit(a), (K % n).cast("string")) for a, n in ((" s", 4), ("T", 3)))
    universe = F.when(K % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in ("S1", "S2", "T1")]))
    return orders(spark, sf).select(K.alias("id"), F.array_join(T.valid_tickers(F.array(s, t, F.upper(s), F.lit(" ")), universe), ",").alias("tickers"))


@query("hs02_cashtags_upper", "H-S2", """
    SELECT o_orderkey AS id, 'BUY,' || CASE o_orderkey % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'ABCDE' ELSE 'NONE' END AS tags FROM orders WHERE o_orderkey % 3 < 2
    UNION ALL SELECT o_orderkey, 'BUY' FROM orders WHERE o_orderkey % 3 = 2""")
def hs02(spark, sf):
    K = F.col("o_orderkey")
    tag = F.when(K % 3 == 0, "$ab").when(K % 3 == 1, "$Abcde").otherwise("$abcdef")
    return orders(spark, sf).select(K.alias("id"), F.array_join(T.cashtags_upper(F.concat(F.lit("$buy "), tag, F.lit("! $1"))), ",").alias("tags"))


@query("hs06_date_tokens", "H-S6", """
    SELECT o_orderkey AS id, strftime(o_orderdate, '%m/%d/%Y') || '|' || strftime(o_orderdate, '%m/%d') || '|' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS dates,
      array_to_string(list_filter([CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate)::VARCHAR END, CASE WHEN o_orderkey % 2 = 0 THEN '2024' END], lambda x: x IS NOT NULL), '|') AS years FROM orders""")
def hs06(spark, sf):
    K = F.col("o_orderkey")
    d = F.col("o_orderdate")
    text = F.concat(F.lit("on "), F.date_format(d, "MM/dd/yyyy"), F.lit(" or "), F.date_format(d, "MMMM"), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"),
                    F.when(K % 2 == 0, " in 2024, 2024").otherwise(" in 12024"))
    return orders(spark, sf).select(K.alias("id"), F.array_join(T.date_tokens(text), "|").alias("dates"), F.array_join(T.year_tokens(text), "|").alias("years"))


@query("hs07_trade_calls", "H-S7", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'ACME,XY' END AS tickers, CASE o_orderkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'long' END AS direction,
      CASE WHEN o_orderkey % 4 < 3 THEN round(o_totalprice, 2) END AS target, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM orders""")
def hs07(spark, sf):
    K = F.col("o_orderkey")
    word = F.when(K % 4 == 0, "long").when(K % 4 == 1, "PUTS").when(K % 4 == 2, "Bullish").otherwise("hold")
    text = F.concat(F.when(K % 4 == 3, F.lit("at ")).otherwise(F.lit("acme xy ")), word, F.lit(" target: $"), F.format_string("%.2f", F.col("o_totalprice").cast("double")), F.when(K % 2 == 0, "\U0001F680").otherwise(""))
    # words of two to five letters count as symbols, so the sentence holds none but the stop words
    call = T.trade_call(text)
    some = F.filter(call["tickers"], lambda t: t.isin("ACME", "XY"))
    return orders(spark, sf).select(K.alias("id"), F.array_join(some, ",").alias("tickers"), call["direction"].alias("direction"), call["target"].alias("target"), call["confidence"].cast("double").alias("confidence"))


@query("hs10_confidence", "H-S10", """
    SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 0.3 WHEN 1 THEN 0.9 WHEN 2 THEN 0.45 WHEN 3 THEN 0.8 WHEN 4 THEN 0.25 WHEN 5 THEN 0.5 END::DOUBLE AS confidence FROM orders""")
def hs10(spark, sf):
    K = F.col("o_orderkey")
    v = F.when(K % 7 == 0, " LOW").when(K % 7 == 1, "high").when(K % 7 == 2, "about 45 %").when(K % 7 == 3, "80").when(K % 7 == 4, "0.25").when(K % 7 == 5, "who knows")
    return orders(spark, sf).select(K.alias("id"), T.confidence_value(v).alias("confidence"))


@query("hs17_relevance_aliases", "H-S17", """
    SELECT p_partkey AS id, CAST(len(a) AS INT) AS n, array_to_string(list_sort(a), '|') AS aliases FROM (
      SELECT p_partkey, list_distinct([x for x in ['P' || p_partkey, '$P' || p_partkey, 'nasdaq:p' || p_partkey, 'nyse:p' || p_partkey, 'p' || p_partkey, 'Acme' || p_size || ' Corp.', 'acme' || p_size || ' corp.',
        'acme' || p_size || ' corp', 'Acme' || p_size, 'acme' || p_size, 'Extra', 'extra'] if length(x) >= 3]) AS a FROM part)""")
def hs17(spark, sf):
    p = X.table(spark, sf, "part")
    a = E.relevance_aliases(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.concat(F.lit("Acme"), F.col("p_size").cast("string"), F.lit(" Corp.")), F.lit("Extra, x"))
    return p.select(F.col("p_partkey").alias("id"), F.size(a).alias("n"), F.array_join(F.array_sort(a), "|").alias("aliases"))


@query("hs19_channel_kinds", "H-S19 H-S20", """
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'social' WHEN 1 THEN 'news' WHEN 2 THEN 'social' WHEN 3 THEN 'other' WHEN 4 THEN 'news' ELSE 'social' END AS channel,
      CASE o_orderkey % 6 WHEN 0 THEN 'reddit' WHEN 2 THEN 'x' WHEN 5 THEN 'stocktwits' WHEN 4 THEN 'reddit' ELSE 'rss' END AS source_type FROM orders""")
def hs19_kinds(spark, sf):
    K = F.col("o_orderkey")
    k = K % 6
    source = F.when(k == 1, "Reuters World").when(k == 2, "on X").when(k == 3, "fox").otherwise("feed")
    url = F.when(k == 0, "https://www.reddit.com/r/a").when(k == 2, "https://x.com/a").when(k == 4, "https://ft.com/a").when(k == 5, "https://stocktwits.com/a").otherwise("https://e.example/a")
    post = F.when(k == 4, "t3_abc").otherwise("1")
    return orders(spark, sf).select(K.alias("id"), T.channel(source, url).alias("channel"), T.source_type(F.lit(""), post, url).alias("source_type"))


@query("p22_fulltext_rules", "P22", """
    SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE TRUE END AS allowed,
      CASE o_orderkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE TRUE END AS subscriber FROM orders""")
def p22_rules(spark, sf):
    K = F.col("o_orderkey")
    k = K % 5
    url = F.when(k == 0, "https://www.nasdaqtrader.com/rss.aspx?feed=1").when(k == 1, "https://seekingalpha.com/a").when(k == 2, "https://www.wsj.com/b").when(k == 3, "https://www.nasdaqtrader.com/x").otherwise("https://e.example/c")
    return orders(spark, sf).select(K.alias("id"), T.fulltext_allowed(url).alias("allowed"), T.fulltext_allowed(url, True).alias("subscriber"))


@query("hd4_spans", "H-D4", """
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 60.0 * (o_orderkey % 90) WHEN 1 THEN 3600.0 * (o_orderkey % 90) WHEN 2 THEN 86400.0 * (o_orderkey % 90) WHEN 3 THEN 604800.0 * (o_orderkey % 90) WHEN 4 THEN 1.5 * 3600 END::DOUBLE AS seconds FROM orders""")
def hd4(spark, sf):
    K = F.col("o_orderkey")
    n, k = (K % 90).cast("string"), K % 6
    span = F.when(k == 0, F.concat(n, F.lit("m"))).when(k == 1, F.concat(n, F.lit(" Hours"))).when(k == 2, F.concat(F.lit(" "), n, F.lit("d "))).when(k == 3, F.concat(n, F.lit("w"))).when(k == 4, "1.5h").otherwise("soon")
    return orders(spark, sf).select(K.alias("id"), T.span_seconds(span).alias("seconds"))


@query("w29_intervals", "W29 W30 W32", """
    SELECT o_orderkey AS id, CASE WHEN s <= 10800 THEN '1m' WHEN s <= 172800 THEN '5m' WHEN s <= 1209600 THEN '15m' WHEN s <= 5184000 THEN '1h' WHEN s <= 63072000 THEN '1d' ELSE '1wk' END AS auto,
      CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN age > 60 THEN '15m' WHEN age > 30 THEN '5m' ELSE '1m' END WHEN 1 THEN CASE WHEN age > 60 THEN '15m' ELSE '5m' END ELSE '1h' END AS degraded,
      greatest(o_orderdate::TIMESTAMP, TIMESTAMP '1996-01-31' - INTERVAL 58 DAY) AS start,
      CASE WHEN age <= 3 THEN 0 WHEN age <= 7 THEN 1 WHEN age <= 30 THEN 2 ELSE 3 END AS stale
    FROM (SELECT *, (o_orderkey * 7919) % 100000000 AS s, o_orderkey % 100 AS age FROM orders)""")
def w29(spark, sf):
    K = F.col("o_orderkey")
    span, age = (K * 7919) % 100000000, K % 100
    name = F.when(K % 3 == 0, "1m").when(K % 3 == 1, "5m").otherwise("1h")
    end = F.to_timestamp(F.lit("1996-01-31 15:00:00"))
    return orders(spark, sf).select(
        K.alias("id"), B.auto_interval(span).alias("auto"), B.degrade_interval(name, age).alias("degraded"),
        B.intraday_start(F.col("o_orderdate").cast("timestamp"), end).alias("start"), T.stale_bucket(age).alias("stale"))


@query("hs08_directions", "H-S8", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'down' WHEN o_orderkey % 3 = 0 THEN 'up' WHEN o_orderkey % 3 = 1 THEN 'down' ELSE 'uncertain' END AS direction FROM orders""")
def hs08(spark, sf):
    K = F.col("o_orderkey")
    payload = F.parse_json(F.when(K % 2 == 0, F.lit('{"implied_direction": " down "}')).otherwise(F.lit('{"implied_direction": ""}')))
    stance = F.when(K % 3 == 0, "Bullish").when(K % 3 == 1, "bearish")
    return orders(spark, sf).select(K.alias("id"), PL.direction_estimate(payload, stance).alias("direction"))


@query("hj04_reasons", "H-J4 H-J8", """
    SELECT o_orderkey AS id, 'grew — WHY: orders|plain ' || o_orderkey || '|only why' AS reasons, 'failed (code=' || o_orderkey || '; tags=[a, b])' AS error FROM orders""")
def hj04(spark, sf):
    K = F.col("o_orderkey")
    n = K.cast("string")
    j = F.concat(F.lit('{"p": [{"claim": "grew", "why": "orders"}, " plain '), n, F.lit(' ", {"why": "only why"}, "", {"claim": ""}]}'))
    e = F.concat(F.lit('{"error": " failed ", "code": '), n, F.lit(', "tags": [" a", "b", ""], "empty": ""}'))
    return orders(spark, sf).select(K.alias("id"), F.array_join(PL.reasons(F.parse_json(j), "p"), "|").alias("reasons"), PL.error_text(e).alias("error"))


@query("hj05_default_verdicts", "H-J5", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'c1:insufficient:0.0|c' || o_orderkey || ':insufficient:0.0' ELSE 'v:supported:0.9' END AS verdicts FROM orders""")
def hj05(spark, sf):
    K = F.col("o_orderkey")
    n = K.cast("string")
    claims = F.array(F.struct(F.lit("c1").alias("id")), F.struct(F.concat(F.lit("c"), n).alias("id")))
    kind = "array<struct<id:string,status:string,confidence:double,reason:string,citations:array<struct<source:string,title:string,url:string,published_at:string,snippet:string>>,why:string>>"
    have = F.from_json(F.when(K % 2 == 0, "[]").otherwise('[{"id": "v", "status": "supported", "confidence": 0.9}]'), kind)
    out = PL.verdicts_or_default(have, claims)
    return orders(spark, sf).select(K.alias("id"), F.array_join(F.transform(out, lambda v: F.concat_ws(":", v["id"], v["status"], v["confidence"].cast("string"))), "|").alias("verdicts"))


@query("hj01_dead_letters", "H-J1", """
    SELECT o_orderkey AS id, o_orderkey % 4 <> 3 AS parses, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN '>=' || o_orderkey END AS value FROM orders""")
def hj01_dead(spark, sf):
    K = F.col("o_orderkey")
    n = K.cast("string")
    raw = F.when(K % 4 == 0, F.concat(F.lit('{"a": '), n, F.lit("}"))).when(K % 4 == 1, F.concat(F.lit('```json\n{"a": '), n, F.lit(" // note\n}\n```"))).when(
        K % 4 == 2, F.concat(F.lit('sure: {"a" >= '), n, F.lit("} done"))).otherwise("no object")
    good, bad = PL.dead_letters(orders(spark, sf).select(K.alias("id"), raw.alias("payload")))
    return good.select("id", F.lit(True).alias("parses"), PL.get(F.col("v"), "a").alias("value")).unionByName(
        bad.select("id", F.lit(False).alias("parses"), F.lit(None).cast("string").alias("value")))
