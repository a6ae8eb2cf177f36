"""Ticker dimension queries over part, supplier and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tickers as K
from ..sources import bars as B
from . import fixtures as X
from .market import big, r4, sql
from .registry import query


def info(spark, sf):
    """Vendor-like info rows: every asset class occurs, names carry theme words."""
    p = X.table(spark, sf, "part")
    k = F.col("p_partkey")
    sym = (
        F.when(k % 10 == 0, F.concat(F.element_at(F.array(*[F.lit(r) for r in ("CL", "GC", "ES", "XX")]), (k % 4 + 1).cast("int")), k.cast("string"), F.lit("=F")))
        .when(k % 10 == 1, F.concat(F.lit("P"), k.cast("string"), F.lit("-W")))
        .when(k % 10 == 2, F.concat(F.lit("C"), k.cast("string"), F.lit("-USD")))
        .otherwise(F.concat(F.lit("P"), k.cast("string")))
    )
    return p.select(
        sym.alias("symbol"), F.lit(None).cast("string").alias("quote_type"), F.initcap("p_name").alias("long_name"),
        F.lit(None).cast("string").alias("short_name"), F.col("p_brand").alias("sector"), F.lower("p_type").alias("industry"),
        F.when(k % 3 == 0, "NMS").when(k % 3 == 1, "LSE").alias("exchange"), F.lit("Tokyo (TSE) main").alias("full_exchange"),
        F.col("p_retailprice").alias("market_cap"), F.col("p_size").cast("double").alias("average_volume"),
    )


def scored_dim(spark, sf):
    p = X.table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("P"), k.cast("string")).alias("symbol"), F.col("p_brand").alias("sector"),
        F.when(F.col("p_size") < 40, "EQUITY").otherwise("FUTURES").alias("asset_type"),
        F.col("p_retailprice").alias("market_cap"), F.when(k % 5 != 0, F.col("p_size") * 1000.0).alias("adv_value"),
        ((k * 7 % 101) / 100.0).alias("ret_3m"), F.when(k % 4 != 0, (k * 13 % 97) / 100.0).alias("ret_6m"),
        ((k * 29 % 89) / 100.0).alias("ret_12m"), F.when(k % 6 != 0, F.col("p_retailprice")).alias("last_close"),
        F.concat(F.lower("p_type"), F.lit(", "), F.element_at(F.split("p_name", " "), 1)).alias("themes"),
    )


DIM = """SELECT 'P' || p_partkey AS symbol, p_brand AS sector, CASE WHEN p_size < 40 THEN 'EQUITY' ELSE 'FUTURES' END AS asset_type, p_retailprice AS market_cap,
   CASE WHEN p_partkey % 5 <> 0 THEN p_size * 1000.0::DOUBLE END AS adv_value, (p_partkey*7%101)/100.0::DOUBLE AS ret_3m, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey*13%97)/100.0::DOUBLE END AS ret_6m,
   (p_partkey*29%89)/100.0::DOUBLE AS ret_12m, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS last_close, unnest([lower(p_type), split_part(p_name,' ',1)]) AS theme FROM part"""


def _leaders_sql(part, w, n):
    ranks = ", ".join(
        f"rank() OVER ({part} ORDER BY coalesce({c},{d}) DESC) AS r{i}"
        for i, (c, d) in enumerate([("market_cap", 0), ("adv_value", 0), ("ret_3m", -1), ("ret_6m", -1), ("ret_12m", -1)])
    )
    return ranks, f"{w[0]}*r0 + {w[1]}*r1 + {w[2]}*((r2+r3+r4)/3.0::DOUBLE)", n


_SR, _SS, _ = _leaders_sql("", ("0.4::DOUBLE", "0.3::DOUBLE", "0.3::DOUBLE"), 12)
_TR, _TS, _ = _leaders_sql("PARTITION BY theme", ("0.35::DOUBLE", "0.35::DOUBLE", "0.30::DOUBLE"), 20)


@query("c14_sector_leaders", "C14 W22 L7", sql(f"""
    WITH d AS (SELECT DISTINCT ON (symbol) * FROM ({DIM})), r AS (SELECT *, {_SR} FROM d), s AS (SELECT symbol, sector, {_SS} AS score FROM r)
    SELECT symbol, sector, round(score,4) AS leader_score, place FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY round(score,9), symbol) AS place FROM s) WHERE place <= 12"""))
def c14_sector(spark, sf):
    from pyspark.sql import functions as F

    out = K.sector_leaders(scored_dim(spark, sf), 12)
    return big(r4(out, "leader_score").select("symbol", "sector", "leader_score", "place"), "place")


@query("c14_theme_leaders", "C14 W22 L7", sql(f"""
    WITH d AS (SELECT DISTINCT * FROM ({DIM})), r AS (SELECT *, {_TR} FROM d), s AS (SELECT symbol, theme, {_TS} AS score FROM r)
    SELECT symbol, theme, round(score,4) AS leader_score, place FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(score,9), symbol) AS place FROM s) WHERE place <= 20"""))
def c14_theme(spark, sf):
    out = K.theme_leaders(scored_dim(spark, sf), 20)
    return big(r4(out, "leader_score").select("symbol", "theme", "leader_score", "place"), "place")


@query("w22_min_rank", "W22", sql("""
    SELECT 'P' || p_partkey AS symbol, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank_size, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rank_price, p_brand AS sector FROM part"""))
def w22(spark, sf):
    from ..operators.ranking import min_ranks

    p = X.table(spark, sf, "part").withColumns({"symbol": F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "sector": F.col("p_brand")})
    return min_ranks(p, ["sector"], {"size": F.col("p_size"), "price": F.col("p_retailprice")}, ["symbol"])


@query("p07_universe_filter", "P7", sql(f"""
    SELECT symbol, asset_type FROM (SELECT DISTINCT ON (symbol) * FROM ({DIM})) WHERE
      CASE WHEN asset_type IN ('EQUITY','ADR','ETF') THEN coalesce(market_cap,0) >= 950 AND coalesce(adv_value,0) >= 10000 ELSE last_close IS NOT NULL AND (adv_value IS NULL OR adv_value >= 0) END"""))
def p07(spark, sf):
    return K.universe_filter(scored_dim(spark, sf), 950, 10000, ["EQUITY", "FUTURES"]).select("symbol", "asset_type")


@query("j09_resolve_tickers", "J9 S7", sql("""
    WITH a AS (SELECT symbol AS key, symbol, 0 AS prio, ord FROM tickers UNION ALL SELECT 'N' || ord, symbol, 1, ord FROM tickers UNION ALL SELECT upper(raw_name), symbol, 1, ord FROM tickers),
    m AS (SELECT key, arg_min(symbol, prio * 1000000000 + ord) AS symbol FROM a GROUP BY key),
    q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' p' || p_partkey WHEN 1 THEN 'n' || p_partkey ELSE p_name END AS raw FROM part)
    SELECT q.p_partkey, m.symbol FROM q LEFT JOIN m ON m.key = upper(trim(q.raw))"""))
def j09(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" p"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.col("p_name"))
    q = X.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return K.resolve(q, "raw", K.alias_map(X.tickers(spark, sf))).select("p_partkey", "symbol")


# every second order line asks for a symbol that the dimension lacks: its row stays, without metadata
@query("j08_ticker_metadata", "J8", sql("""
    SELECT l_orderkey, l_linenumber, l_partkey, t.sector, t.industry FROM lineitem LEFT JOIN tickers t ON t.symbol = 'P' || (l_partkey + CASE WHEN l_linenumber % 2 = 0 THEN 10000000 ELSE 0 END)"""))
def j08(spark, sf):
    key = F.col("l_partkey") + F.when(F.col("l_linenumber") % 2 == 0, 10000000).otherwise(0)
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("p"), key.cast("string")).alias("t"))
    return K.with_metadata(li, "t", X.tickers(spark, sf), ["sector", "industry"]).drop("t")


@query("j11_mapped_vendor_symbols", "J11", sql("""
    WITH m AS (SELECT 'T' || s_suppkey AS ticker, 'T' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.L' WHEN 2 THEN '.SA' WHEN 3 THEN '.DE' ELSE '' END AS vendor, s_suppkey AS k FROM supplier)
    SELECT ticker, CASE WHEN k % 3 <> 0 THEN vendor END AS vendor_symbol FROM m"""))
def j11_mapped(spark, sf):
    """The suffix comes from the first field that names a market; a mapping counts only where it has prices."""
    market = F.element_at(F.array(*[F.lit(x) for x in ("NasdaqGS", "London Stock Exchange", "B3 São Paulo", "Frankfurt", "Atlantis")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = X.table(spark, sf, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_suppkey", market.alias("market"))
    m = s.withColumn("vendor", F.concat("ticker", K.vendor_suffix(F.lit(None).cast("string"), F.lit(" "), F.col("market"))))
    return K.resolve_vendor_symbols(s.select("ticker"), m.select("ticker", "vendor"), m.filter("s_suppkey % 3 <> 0").select(F.col("vendor").alias("symbol")))


@query("j11_vendor_symbols", "J11 S11", sql("""
    WITH r AS (SELECT DISTINCT 'S' || chr(CAST(65 + l_suppkey % 26 AS INTEGER)) AS ticker FROM lineitem), h AS (SELECT 'S' || chr(CAST(65 + s_suppkey % 13 AS INTEGER)) || '.L' AS symbol FROM supplier UNION SELECT 'S' || chr(CAST(65 + s_suppkey % 5 AS INTEGER)) FROM supplier)
    SELECT ticker, CASE WHEN ticker IN (SELECT symbol FROM h) THEN ticker WHEN ticker || '.L' IN (SELECT symbol FROM h) THEN ticker || '.L' END AS vendor_symbol FROM r"""))
def j11(spark, sf):
    def letter(c, n):
        return F.chr((F.col(c) % n + 65).cast("long"))

    req = X.table(spark, sf, "lineitem").select(F.concat(F.lit("$s"), letter("l_suppkey", 26)).alias("ticker"))
    s = X.table(spark, sf, "supplier")
    have = s.select(F.concat(F.lit("S"), letter("s_suppkey", 13), F.lit(".L")).alias("symbol")).unionAll(s.select(F.concat(F.lit("S"), letter("s_suppkey", 5))))
    none = req.select("ticker", F.lit(None).cast("string").alias("vendor")).limit(0)
    return K.resolve_vendor_symbols(req, none, have)


@query("j14_apply_patch", "J14", sql("""
    SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size % 4 = 0 AND p_size >= 20 THEN 'ETF' ELSE 'EQUITY' END AS asset_type, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x' END AS long_name, 'NYSE Arca' AS market, p_size % 4 = 0 AND p_size >= 20 AS applied FROM part"""))
def j14(spark, sf):
    p = X.table(spark, sf, "part")
    sym = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol")
    base = p.select(sym, F.lit("EQUITY").alias("asset_type"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x").alias("long_name"),
                    F.lit("UNKNOWN").alias("market"), F.lit("").alias("exchange"), F.lit("").alias("themes"))
    patch = p.select(sym, F.when(F.col("p_size") % 4 == 0, "etf").otherwise("equity").alias("detected"), (F.col("p_size") / 50.0).alias("conf"), F.col("p_name").alias("name"), F.lit("nysearca").alias("label"))
    return K.apply_patch(base, patch, 0.4).select("symbol", "asset_type", "long_name", "market", "applied")


@query("p09_sparse_rows", "P9", sql("""
    SELECT symbol FROM (SELECT 'P' || p_partkey AS symbol, p_partkey AS k FROM part WHERE p_partkey % 7 = 0 OR p_size % 5 = 0)"""))
def p09(spark, sf):
    p = X.table(spark, sf, "part")
    df = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("long_name"),
                  F.lit("s").alias("sector"), F.lit("i").alias("industry"), F.when(F.col("p_size") % 5 == 0, "unknown").otherwise("NYSE").alias("market"))
    return K.sparse_rows(df).select("symbol")


@query("u03_universe", "U3 P8 S9", sql("""
    WITH r AS (SELECT 'S' || l_suppkey AS symbol, '' AS name, 'A' AS listing, false AS etf, 0 AS prio FROM lineitem UNION ALL SELECT 'S' || s_suppkey, s_name, 'B', s_acctbal > 5000, 1 FROM supplier)
    SELECT symbol, coalesce(arg_min(name, prio) FILTER (WHERE name <> ''), '') AS name, arg_min(listing, prio) AS listing, bool_or(etf) AS etf FROM r GROUP BY symbol"""))
def u03(spark, sf):
    a = K.seed_rows(X.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")), "A", "first", 0)
    s = X.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"),
        F.lit("B").alias("listing"), F.lit("").alias("category"), (F.col("s_acctbal") > 5000).alias("etf"), F.lit("second").alias("source"), F.lit(1).alias("priority"))
    return K.assemble_universe(a.unionByName(s)).select("symbol", "name", "listing", "etf")


@query("j30_currency_pairs", "J30", sql("""
    WITH c AS (SELECT DISTINCT substr(upper(n_name), 1, 3) || n_nationkey AS ccy FROM nation) SELECT a.ccy || b.ccy || '=X' AS symbol FROM c a JOIN c b ON a.ccy <> b.ccy"""))
def j30(spark, sf):
    c = X.table(spark, sf, "nation").select(F.concat(F.substring(F.upper("n_name"), 1, 3), F.col("n_nationkey").cast("string")).alias("ccy")).distinct()
    return K.currency_pairs(c)


@query("c15_enriched_tickers", "C15 J10 J13 H-S13 H-S14 H-S15 H-S16 H-S18 H-D3")
def c15(spark, sf):
    perf = X.table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("last_close"), F.lit(None).cast("double").alias("adv_value"))
    return K.enrich(info(spark, sf), perf, F.to_date(F.lit("2024-07-01")))


@query("hs14_asset_types", "H-S14 H-S13 A16", sql("""
    SELECT CASE WHEN p_partkey % 10 = 0 THEN 'FUTURES' WHEN p_partkey % 10 = 1 THEN 'WARRANT' WHEN p_partkey % 10 = 2 THEN 'CRYPTO' ELSE 'EQUITY' END AS asset_type, count(*) AS "rows",
      CAST(1.0 AS DOUBLE) AS sector_share, round(avg(CASE WHEN p_partkey % 3 < 2 THEN 1.0 ELSE 0.0 END),4) AS exchange_share FROM part GROUP BY 1"""))
def hs14(spark, sf):
    df = info(spark, sf)
    df = df.withColumn("asset_type", K.asset_type(F.col("quote_type"), F.col("symbol"), F.col("long_name")))
    return r4(K.coverage(df, ["sector", "exchange"], "asset_type"), "sector_share", "exchange_share")


@query("j10_exchange_meta", "J10", sql("""
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'FUTURES' WHEN p_partkey % 10 = 2 THEN 'CRYPTO' WHEN p_partkey % 3 = 0 THEN 'NASDAQ' WHEN p_partkey % 3 = 1 THEN 'LSE' ELSE 'Tokyo (TSE)' END AS market FROM part"""))
def j10(spark, sf):
    df = info(spark, sf)
    key = F.regexp_extract("symbol", r"(\d+)", 1).cast("long").alias("p_partkey")
    return df.select(key, K.exchange_meta(F.col("exchange"), F.col("full_exchange"), F.col("symbol"))["market"].alias("market"))


@query("hs18_theme_tags", "H-S18", sql("""
    SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(lower(p_name), '\\bbrass\\b|metal') THEN 'alloys' END, CASE WHEN regexp_matches(lower(p_name), '\\bgold\\b|\\bau\\b') THEN 'gold' END, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'parts' END) AS tags FROM part"""))
def hs18(spark, sf):
    themes = {"gold": r"\bgold\b|\bau\b", "alloys": r"\bbrass\b|metal", "parts": "ring|bolt"}
    return X.table(spark, sf, "part").select("p_partkey", F.array_join(K.theme_tags(F.col("p_name"), F.lit(""), themes), ",").alias("tags"))


# New York's rule of those years: first Sunday of April to last Sunday of October
@query("hd3_session_utc", "H-D3", """
    SELECT day, CASE WHEN day >= a + CAST((7 - dayofweek(a)) % 7 AS INT) AND day < o - CAST(dayofweek(o) AS INT) THEN '13:30' ELSE '14:30' END AS ny_open, '00:00' AS tokyo_open
    FROM (SELECT day, make_date(year(day), 4, 1) AS a, make_date(year(day), 10, 31) AS o FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))""")
def hd3(spark, sf):
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", K.session_utc(F.col("day"), F.lit("America/New_York"), F.lit("09:30")).alias("ny_open"),
                    K.session_utc(F.col("day"), F.lit("Asia/Tokyo"), F.lit("09:00")).alias("tokyo_open"))


@query("j12_symbol_alternatives", "J12", sql("""
    SELECT 'X' || p_partkey || '.B' AS symbol, 'X' || p_partkey || '-B' AS alternatives FROM part"""))
def j12(spark, sf):
    s = F.concat(F.lit("X"), F.col("p_partkey").cast("string"), F.lit(".B"))
    return X.table(spark, sf, "part").select(s.alias("symbol"), F.array_join(K.symbol_alternatives(s), ",").alias("alternatives"))


@query("j12_symbol_forms", "J12", sql("""
    SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN b || '-PA' WHEN 1 THEN b || '-PB' WHEN 2 THEN b || '-PC' WHEN 3 THEN b || '-B' WHEN 4 THEN b || '-U,' || b || '-UN' WHEN 5 THEN b || '-W,' || b || '-WS,' || b || '-WT' WHEN 6 THEN b || '-PA' ELSE '' END AS forms
    FROM (SELECT p_partkey, 'X' || p_size AS b FROM part)"""))
def j12_forms(spark, sf):
    k = F.col("p_partkey") % 8
    tail = F.when(k == 0, "$A").when(k == 1, "^B").when(k == 2, ".PR.C").when(k == 3, ".b").when(k == 4, ".U").when(k == 5, ".W").when(k == 6, ".PRA").otherwise("")
    s = F.concat(F.lit("X"), F.col("p_size").cast("string"), tail)
    return X.table(spark, sf, "part").select("p_partkey", F.array_join(K.symbol_alternatives(s), ",").alias("forms"))


@query("hs14_asset_kinds", "H-S14", sql("""
    SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'ETF' WHEN 1 THEN 'FUTURES' WHEN 2 THEN 'FOREX' WHEN 3 THEN 'CRYPTO' WHEN 4 THEN 'FUTURES' WHEN 5 THEN 'FOREX' WHEN 6 THEN 'CRYPTO'
      WHEN 7 THEN 'UNIT' WHEN 8 THEN 'RIGHTS' WHEN 9 THEN 'ADR' WHEN 10 THEN 'SPAC?' ELSE 'EQUITY' END AS asset_type FROM part"""))
def hs14_kinds(spark, sf):
    k = F.col("p_partkey") % 12
    quote = F.when(k == 0, "MutualFund").when(k == 1, "future").when(k == 2, "CURRENCY").when(k == 3, "cryptocurrency").when(k == 11, "equity")
    sym = F.concat(F.lit("P"), F.col("p_size").cast("string"), F.when(k == 4, "=F").when(k == 5, "=X").when(k == 6, "-USD").when(k == 7, "-U").when(k == 8, "/R").otherwise("0"))
    name = F.when(k == 9, "Some ADR").when(k == 10, "Blue Acquisition Corp").otherwise("plain")
    return X.table(spark, sf, "part").select("p_partkey", K.asset_type(quote, sym, name).alias("asset_type"))


@query("a23_symbol_samples", "A23 C19", sql("""
    SELECT source AS symbol, pos, post_id, substr(trim(regexp_replace(title, '\\s+', ' ', 'g')),1,160) AS title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY post_id) AS pos FROM posts) WHERE pos <= 5"""))
def a23(spark, sf):
    p = X.posts(spark, sf)
    out = K.symbol_samples(p, p.select("post_id", F.col("source").alias("symbol")), 5)
    return big(out.select("symbol", "pos", "post_id", "title"), "pos")


KEYWORDS = "(list_filter(w, lambda x, i: x <> '' AND length(x) <= 24 AND list_position(w, x) = i)[1:12])"


@query("c19_gate_preview", "C19", sql(f"""
    SELECT post_id AS symbol, k || k || k AS include_any, k AS include_macro, k AS regulatory, k AS exclude_any, 'ok' AS why FROM (
      SELECT post_id, {KEYWORDS} AS k FROM (SELECT post_id, list_transform(string_split(title, ' '), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS w FROM posts))"""))
def c19(spark, sf):
    p = X.posts(spark, sf)
    w = F.split("title", " ")
    lex = p.select(F.col("post_id").alias("symbol"), *[w.alias(c) for c in ("must_hooks", "finance_core", "sector_terms", "macro_terms", "regulatory_terms", "exclusions")], F.lit(None).cast("string").alias("why"))
    return K.gate_preview(lex)


@query("j31_prediction_board", "J31", sql("""
    WITH c AS (SELECT symbol AS ticker, count(*) AS n, max(ts) AS last_ts, arg_max(side, row(ts, signal_id)) AS dir, round(arg_max(confidence, row(ts, signal_id)) FILTER (WHERE signal_id % 2 = 0), 6) AS pnl FROM signals GROUP BY symbol)
    SELECT u.ticker, coalesce(n, 0) AS calls, last_ts AS last_call, dir AS direction, pnl AS last_pnl FROM (SELECT 'S' || s_suppkey AS ticker FROM supplier) u LEFT JOIN c USING (ticker) ORDER BY calls DESC, u.ticker LIMIT 50"""))
def j31(spark, sf):
    u = X.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    s = X.signals(spark, sf).select(F.col("symbol").alias("ticker"), "ts", F.col("side").alias("direction"), "confidence", F.col("signal_id").alias("call_id"))
    t = s.filter("call_id % 2 = 0").select("ticker", "ts", F.lit("TP").alias("exit_reason"), F.round("confidence", 6).alias("pnl"), "call_id")
    return K.prediction_board(u, s, t, 50)


@query("w29_window_interval", "W29 H-D4", sql("""
    SELECT o_orderkey, CASE WHEN d <= 10800 THEN '1m' WHEN d <= 172800 THEN '5m' WHEN d <= 1209600 THEN '15m' WHEN d <= 5184000 THEN '1h' WHEN d <= 63072000 THEN '1d' ELSE '1wk' END AS interval
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * 10 AS d FROM orders)"""))
def w29(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", B.auto_interval(F.col("o_totalprice") * 10).alias("interval"))


@query("w30_needed_series", "W30 S11", sql("""
    SELECT DISTINCT symbol AS ticker, CASE WHEN p LIKE '1%' THEN '15m' WHEN p LIKE '2%' THEN '1h' WHEN p LIKE '3%' THEN '4h' ELSE '1d' END AS interval
    FROM (SELECT s.symbol, o.o_orderpriority AS p FROM signals s JOIN orders o ON o.o_orderkey = s.signal_id)"""))
def w30(spark, sf):
    o = X.table(spark, sf, "orders")
    tf = F.when(F.col("o_orderpriority").startswith("1"), "intraday").when(F.col("o_orderpriority").startswith("2"), "swing_days").when(F.col("o_orderpriority").startswith("3"), "swing_weeks").otherwise("long_term")
    v = X.signals(spark, sf).join(o, F.col("signal_id") == F.col("o_orderkey")).select(F.col("symbol").alias("ticker"), tf.alias("timeframe"), F.col("side").alias("implied_direction"))
    return B.needed_series(v)
