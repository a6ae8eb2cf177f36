"""Text functions, evidence, novelty and context queries over documents and benchmark claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import postings as P
from ..session import stored
from . import fixtures as X
from .market import r4, sql
from .registry import query


def claims(spark, sf):
    b = X.table(spark, sf, "benchmark")
    return b.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("set_id"),
        F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("claim_id"), "text",
        F.lit(None).cast("string").alias("entity"), F.to_timestamp(F.lit("2024-02-15")).alias("as_of"),
    )


SCORES = """SELECT c.claim_id, p.post_id, CAST(list_sum(list_transform(c.terms, lambda t: CASE WHEN contains(p.body, t) THEN 1 ELSE 0 END)) AS DOUBLE) AS score
    FROM (SELECT 'c' || item_id AS claim_id,
            list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9.\\-]{2,}')[1:8], lambda x: lower(x))) AS terms,
            list_distinct(list_transform(regexp_extract_all(text, '\\b([A-Z]{1,5})(?:\\b|[^A-Za-z0-9])', 1), lambda x: lower(x)) || list_filter([%s], lambda w: contains(lower(text), w))) AS names
          FROM benchmark) c,
         (SELECT post_id, lower(title || ' ' || text) AS body FROM posts) p
    WHERE len(list_filter(c.names, lambda a: contains(p.body, a))) > 0 OR len(c.names) = 0""" % ", ".join(f"'{w}'" for w in E.COMMODITIES)


def indexed_posts(spark, sf):
    return X.posts(spark, sf).select("post_id", F.concat_ws(" ", "title", "text").alias("body"), F.col("posted_at").alias("at"), "url", F.col("post_id").cast("long").alias("ordinal"))


@query("j20_evidence_scores", "J20", sql(f"SELECT * FROM ({SCORES}) WHERE score > 0"))
def j20(spark, sf):
    """Scores from the index; the texts are read to build it, then no more."""
    return P.evidence_scores(P.scratch_index(indexed_posts(spark, sf)), claims(spark, sf)).select("claim_id", "post_id", "score")


OWN = "CAST(CAST(substr(claim_id, 2) AS BIGINT) * 7 AS VARCHAR)"


@query("c04_evidence_map", "C4 L4", sql(f"""
    WITH s AS ({SCORES}), b AS (
      SELECT s.claim_id, p.url, p.post_id, s.score, CAST(p.post_id AS BIGINT) AS n, CAST(s.post_id = {OWN} AS INTEGER) AS own FROM s JOIN posts p USING (post_id) WHERE s.score > 0
      UNION ALL SELECT DISTINCT s.claim_id, p.url, p.post_id, 0.0, CAST(p.post_id AS BIGINT), 2 FROM s JOIN posts p ON p.post_id = {OWN})
    SELECT claim_id, post_id, score, forced, rank FROM (SELECT claim_id, post_id, score, own = 2 AS forced, row_number() OVER (PARTITION BY claim_id ORDER BY own = 2 DESC, score DESC, n) AS rank FROM b WHERE own <> 1) WHERE rank <= 3"""))
def c04(spark, sf):
    """Each claim comes from a post: that post is the first row, whatever its score."""
    c = claims(spark, sf).withColumn("set_id", (F.substring("claim_id", 2, 9).cast("long") * 7).cast("string"))
    p = indexed_posts(spark, sf)
    out = P.evidence_map(P.scratch_index(p), c, p)
    return out.select("claim_id", "post_id", "score", (F.col("forced") == 1).alias("forced"), F.col("rank").cast("long").alias("rank"))


@query("c04_snippets", "C4 L4 H-S22", sql(f"""
    WITH s AS ({SCORES}), b AS (SELECT s.claim_id, p.url, p.post_id, s.score, CAST(p.post_id AS BIGINT) AS n FROM s JOIN posts p USING (post_id) WHERE s.score > 0)
    SELECT claim_id, post_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, n) AS rank FROM b) WHERE rank <= 3"""))
def c04_snippets(spark, sf):
    p = X.posts(spark, sf).withColumns({"at": F.col("posted_at"), "ordinal": F.col("post_id").cast("long")})
    out = P.evidence_snippets(P.scratch_index(indexed_posts(spark, sf)), claims(spark, sf), p)
    return out.select("claim_id", "post_id", "score", F.col("rank").cast("long").alias("rank"))


@query("j21_relevance_scan", "J21 L5 H-S17", sql("""
    WITH r AS (SELECT 'b' || item_id AS ref_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 6), lambda x: lower(x))) AS kw FROM benchmark),
    p AS (SELECT post_id, lower(text) AS body, posted_at AS pat, source FROM posts),
    s AS (SELECT ref_id, post_id, p.pat, CAST(len(list_filter(kw, lambda k: contains(body, k))) AS DOUBLE) + CASE WHEN contains(body, 'thing') THEN 6 ELSE 0 END + CASE WHEN source = 'src1' THEN 1.5 WHEN source = 'src2' THEN 0.5 ELSE 0 END AS score FROM r, p WHERE p.pat BETWEEN TIMESTAMP '2023-12-21' AND TIMESTAMP '2024-01-20')
    SELECT ref_id, post_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, pat DESC, post_id) AS rank FROM s WHERE score >= 4) WHERE rank <= 20"""))
def j21(spark, sf):
    b = X.table(spark, sf, "benchmark")
    kw = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 6), F.lower))
    req = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("ref_id"), F.to_timestamp(F.lit("2024-01-20")).alias("at"),
                   F.array(F.lit("Thing"), F.lit("thing")).alias("aliases"), kw.alias("keywords"))
    platform = F.when(F.col("source") == "src1", "RSS").when(F.col("source") == "src2", "x").otherwise("blog")
    p = X.posts(spark, sf).select("post_id", F.col("text").alias("body"), platform.alias("platform"), F.col("posted_at").alias("at"))
    out = P.relevance_scan(P.scratch_index(p), req, p, before_days=30, min_score=4.0, top=20)
    return out.select("ref_id", "post_id", "score", F.col("rank").cast("long").alias("rank"))


@query("c03_novelty", "C3 J19 H-S23", sql("""
    WITH w AS (SELECT source AS ticker, post_id, posted_at AS pat, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM posts),
    s AS (SELECT ticker, post_id, pat, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) ELSE [] END AS sh,
          row_number() OVER (PARTITION BY ticker ORDER BY pat, post_id) AS n FROM w),
    p AS (SELECT a.ticker, a.post_id, max(CASE WHEN len(a.sh) + len(b.sh) = 0 THEN 0 ELSE len(list_intersect(a.sh, b.sh))::DOUBLE / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) END) AS best, count(*) AS samples
          FROM s a JOIN s b ON a.ticker = b.ticker AND b.n < a.n AND b.n >= a.n - 100 AND b.pat >= a.pat - INTERVAL 30 DAY GROUP BY ALL)
    SELECT s.ticker, s.post_id, round(CASE WHEN len(sh) > 0 AND best IS NOT NULL THEN greatest(0, 1 - best) ELSE 0.7 END,4) AS novelty, coalesce(samples, 0) AS samples
    FROM s LEFT JOIN p USING (ticker, post_id)"""))
def c03(spark, sf):
    p = X.posts(spark, sf).select(F.col("source").alias("ticker"), "post_id", F.col("posted_at").alias("at"), "text")
    return r4(E.novelty(p), "novelty").drop("at")


@query("j19_prior_pairs", "J19 C3", sql("""
    WITH s AS (SELECT source AS ticker, post_id, posted_at AS pat, row_number() OVER (PARTITION BY source ORDER BY posted_at, post_id) AS n FROM posts)
    SELECT a.ticker, a.post_id, b.post_id AS prior_id FROM s a JOIN s b ON a.ticker = b.ticker AND b.n < a.n AND b.n >= a.n - 20 AND b.pat >= a.pat - INTERVAL 10 DAY"""))
def j19(spark, sf):
    p = X.posts(spark, sf).select(F.col("source").alias("ticker"), "post_id", F.col("posted_at").alias("at"))
    return E.prior_pairs(p, days=10, keep=20).select("ticker", "post_id", "prior_id")


# companies are named by long words of the first posts, so that texts do name them; one in five has no
# descriptor, an industry may be another's sector, and a third of the posts has no ticker: every case decides rows
@query("p19_context_filter", "P19 H-S21 U5 J9", sql("""
    WITH w AS (SELECT post_id, regexp_extract_all(text, '[A-Za-z]{7,}') AS ws, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS form FROM posts),
    t AS (SELECT t.symbol, coalesce(nullif(array_to_string(w.ws[1:1 + t.ord % 2], ' '), ''), t.raw_name) AS name, lower(CASE WHEN t.ord % 5 = 0 THEN 'UNKNOWN' ELSE t.sector END) AS sector,
      lower(CASE WHEN t.ord % 5 <> 0 THEN 'Brand#' || (t.ord % 40 + 1) END) AS industry, CASE WHEN t.ord % 10 = 1 THEN 'etf' END AS asset_type FROM tickers t LEFT JOIN w ON w.post_id = CAST(t.ord % 200 AS VARCHAR)),
    d AS (SELECT *, [x FOR x IN [sector, industry, asset_type] IF x <> 'unknown'] AS known FROM t),
    pt AS (SELECT post_id, 'P' || post_id AS symbol FROM posts WHERE CAST(post_id AS BIGINT) % 3 <> 0),
    tg AS (SELECT symbol AS target, lower(name) AS name, sector, industry, asset_type, known FROM d WHERE symbol IN (SELECT min(symbol) FROM t GROUP BY sector)),
    m AS (SELECT tg.target, tg.known, w.post_id FROM tg JOIN w ON contains(w.form, tg.name) OR len([x FOR x IN string_split(tg.name, ' ') IF len(x) >= 3 AND contains(w.form, ' ' || x || ' ')]) > 0)
    SELECT tg.target, pt.post_id FROM tg JOIN d b ON b.symbol = tg.target OR b.sector = tg.sector OR b.industry = tg.industry OR b.asset_type = tg.asset_type JOIN pt ON pt.symbol = b.symbol
    UNION SELECT m.target, m.post_id FROM m LEFT JOIN pt USING (post_id) LEFT JOIN d b ON b.symbol = pt.symbol WHERE pt.symbol IS NULL OR len(m.known) = 0 OR list_has_any(m.known, b.known)"""))
def p19(spark, sf):
    p = X.posts(spark, sf)
    n = F.col("ord")
    long_words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)), F.lit(1), (1 + n % 2).cast("int"))
    named = X.tickers(spark, sf).withColumn("post_id", (n % 200).cast("string")).join(p.select("post_id", "text"), "post_id", "left")
    dim = named.select(
        "symbol", F.coalesce(F.nullif(F.array_join(long_words, " "), F.lit("")), "long_name").alias("long_name"),
        F.when(n % 5 == 0, "UNKNOWN").otherwise(F.col("sector")).alias("sector"),
        F.when(n % 5 != 0, F.concat(F.lit("Brand#"), (n % 40 + 1).cast("string"))).alias("industry"),
        F.when(n % 10 == 1, "ETF").alias("asset_type"),
    )
    dim = stored(dim, "dim")  # read for the targets, for their facts and for those of the posts
    first = dim.groupBy("sector").agg(F.min("symbol").alias("symbol")).select("symbol")
    tagged = p.filter(F.col("post_id").cast("long") % 3 != 0).select("post_id", F.concat(F.lit("P"), "post_id").alias("symbol"))
    return E.context_filter(p.select("post_id", F.col("text").alias("body")), tagged, dim, first)


@query("hs01_cashtags", "H-S1 H-S2 L10", sql("""
    SELECT post_id, CAST(len(x) AS BIGINT) AS n, CAST(len(list_distinct(x)) AS BIGINT) AS distinct_n, list_aggregate(x[1:6], 'string_agg', ',') AS first_six FROM (
      SELECT post_id, list_transform(regexp_extract_all(regexp_replace(text, ' (th|de|un|en|la) ', ' $\\1 ', 'g'), '\\$([A-Za-z]{1,5})(?:[^A-Za-z0-9]|$)', 1), lambda t: upper(t)) AS x FROM posts) WHERE len(x) > 0"""))
def hs01(spark, sf):
    text = F.regexp_replace("text", " (th|de|un|en|la) ", r" \$$1 ")
    df = X.posts(spark, sf).select("post_id", T.cashtags(text).alias("x")).filter(F.size("x") > 0)
    return df.select("post_id", F.size("x").cast("long").alias("n"), F.size(F.array_distinct("x")).cast("long").alias("distinct_n"),
                     F.array_join(F.slice("x", 1, 6), ",").alias("first_six"))


@query("hs11_magnitudes", "H-S11", sql("""
    SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1000000 END AS VARCHAR) AS written FROM orders"""))
def hs11(spark, sf):
    o = X.table(spark, sf, "orders")
    n = F.floor("o_totalprice").cast("string")
    token = F.concat(n, F.when(F.col("o_orderkey") % 2 == 0, "K").otherwise(" m"))
    return o.select("o_orderkey", T.number_like(T.expand_magnitude(token)).alias("written"))


@query("hs22_snippets", "H-S22", sql("""
    SELECT post_id, CASE WHEN pos = 0 THEN substr(t, 1, 320) || CASE WHEN length(t) > 320 THEN '…' ELSE '' END
      ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || substr(t, st + 1, least(length(t), st + 320) - st) || (CASE WHEN least(length(t), st + 320) < length(t) THEN '…' ELSE '' END) END AS snippet
    FROM (SELECT *, greatest(0, pos - 1 - 160) AS st FROM (SELECT post_id, t, CASE WHEN instr(lower(t), 'tion') > 0 THEN instr(lower(t), 'tion') ELSE instr(lower(t), 'sch') END AS pos
      FROM (SELECT post_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM posts)))"""))
def hs22(spark, sf):
    terms = F.array(F.lit("tion"), F.lit("sch"))
    return X.posts(spark, sf).select("post_id", T.snippet(F.col("text"), terms).alias("snippet"))


@query("hs24_token_count", "H-S24", sql("""
    SELECT post_id, CAST(greatest(len(string_split_regex(t, '\\s+')), ceil(length(t) / 4.0)) AS BIGINT) AS tokens FROM (SELECT post_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM posts) WHERE t <> ''"""))
def hs24(spark, sf):
    return X.posts(spark, sf).select("post_id", T.token_count(F.col("text")).alias("tokens")).filter("tokens > 0")


@query("hs25_signal_ids", "H-S25", sql("SELECT post_id, 'rss_' || substr(sha1(text), 1, 10) AS signal_id FROM posts"))
def hs25(spark, sf):
    return X.posts(spark, sf).select("post_id", T.signal_id(F.lit("rss"), F.col("text")).alias("signal_id"))


@query("hs27_fetch_status", "H-S27", sql("""
    SELECT status, count(*) AS posts, CAST(sum(lines) AS BIGINT) AS paragraphs FROM (
      SELECT CASE WHEN n >= 400 THEN 'ok' WHEN n >= 200 THEN 'partial' WHEN n > 0 THEN 'short' ELSE 'empty' END AS status,
        len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '\\s+', '', 'g') <> '')) AS lines
      FROM (SELECT text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM posts)) GROUP BY status"""))
def hs27(spark, sf):
    df = X.posts(spark, sf).select(T.fetch_status(F.col("text")).alias("status"), T.paragraph_count(F.col("text")).alias("k"))
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("posts"), F.sum("k").alias("paragraphs"))


@query("hs28_interest_labels", "H-S28", sql("""
    SELECT label, count(*) AS posts FROM (SELECT CASE WHEN interest_score >= 85 THEN 'urgent' WHEN interest_score >= 65 THEN 'high' WHEN interest_score >= 40 THEN 'medium' ELSE 'low' END AS label FROM interest) GROUP BY label"""))
def hs28(spark, sf):
    return X.interest(spark, sf).groupBy(T.interest_label(F.col("interest_score")).alias("label")).agg(F.count(F.lit(1)).alias("posts"))


@query("u08_clean_paragraphs", "U8", sql("""
    SELECT post_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), chr(10) || chr(10)) AS cleaned FROM (
      SELECT post_id, list_transform(string_split(regexp_replace(trim(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[ \\t]+', ' ', 'g')), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS l FROM posts)"""))
def u08(spark, sf):
    # each line becomes a paragraph, so that repeated lines are repeated paragraphs
    return X.posts(spark, sf).select("post_id", T.clean_paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("cleaned"))


@query("u09_clean_lines", "U9", sql("""
    SELECT post_id, trim(regexp_replace(array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]), chr(10)), '[ \\t]{2,}', ' ', 'g')) AS cleaned FROM (
      SELECT post_id, list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(comments?(\\s*\\(\\d+\\))?|most popular|trending|share|save|play)\\b') AND NOT (length(x) < 6 AND NOT regexp_matches(x, '[A-Za-z]\\.'))) AS k
      FROM (SELECT post_id, list_transform(string_split_regex(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM posts))"""))
def u09(spark, sf):
    return X.posts(spark, sf).select("post_id", T.clean_lines(F.col("text")).alias("cleaned"))


@query("p20_post_kinds", "P20", sql("""
    SELECT count(*) FILTER (WHERE regexp_matches(lower(text), 'what happened|can someone explain|i don.t understand|why did|how did|what did i do wrong|help|confused')) AS help_posts,
      count(*) FILTER (WHERE regexp_matches(lower(title || ' ' || text), 'after hrs|after-hours|after hours|ah |ah:|mover|halt|spike|surge')) AS mover_posts FROM posts"""))
def p20(spark, sf):
    return X.posts(spark, sf).agg(F.count_if(T.is_help_post(F.col("text"))).alias("help_posts"),
                                  F.count_if(T.is_mover_post(F.col("title"), F.col("text"))).alias("mover_posts"))


@query("hs19_channels", "H-S19 H-S20", sql("""
    SELECT source, 'other' AS channel, 'rss' AS source_type, count(*) AS posts FROM posts GROUP BY source"""))
def hs19(spark, sf):
    p = X.posts(spark, sf)
    return p.groupBy("source", T.channel(F.col("source"), F.col("url")).alias("channel"),
                     T.source_type(F.col("platform"), F.col("post_id"), F.col("url")).alias("source_type")).agg(F.count(F.lit(1)).alias("posts"))
