"""Articles from pages and posts from feed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import articles as A
from . import fixtures as X
from .market import sql
from .registry import query


@query("s19_articles", "S19 H-X1 H-X2 H-X3 H-X5 H-X6")
def s19(spark, sf):
    return A.articles(X.table(spark, sf, "pages"))


PLAIN = "regexp_replace({}, '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{_a}', '{_b}')"
DROP = A.DROP_LINE.replace("'", "''")


@query("s19_article_paragraphs", "S19 H-X1 H-X3", f"""
    SELECT page_id, array_to_string([x for x in p if x <> '' AND NOT regexp_matches(x, '{DROP}')], chr(10) || chr(10)) AS text FROM (
      SELECT page_id, [trim(regexp_replace({PLAIN.format("y")}, '\\s+', ' ', 'g')) for y in string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'), '<p>')[2:]] AS p
      FROM pages WHERE html LIKE '%<article>%')""")
def s19_paragraphs(spark, sf):
    """The article container of every page that has one."""
    pages = X.table(spark, sf, "pages").filter(F.contains("html", F.lit("<article>")))
    return A.parse_pages(pages).select("page_id", F.element_at("candidates", 1).alias("text"))


@query("s19_titles", "S19 H-X1", sql("""
    SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')) AS title FROM pages"""))
def s19_titles(spark, sf):
    return A.parse_pages(X.table(spark, sf, "pages")).select("page_id", "title")


@query("s18_feed_posts", "S18", sql("""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, source, 'https://e.example.com/' || doc_id AS url, 'Doc ' || doc_id AS title FROM documents"""))
def s18(spark, sf):
    d = X.table(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>Doc "), n, F.lit("</title><link>https://e.example.com/"), n, F.lit("</link><guid>"), n,
                    F.lit("</guid><description>&lt;p&gt;"), F.col("lang"), F.lit("&lt;/p&gt;</description></item>"))
    # one feed document per source and hundred documents, as a crawler would store them
    f = d.withColumn("x", item).groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_join(F.collect_list("x"), "").alias("x"))
    feeds = f.select(F.concat(F.lit("https://f/"), "source").alias("feed_url"), F.lit(None).cast("string").alias("feed_name"),
                     F.concat(F.lit("<rss><channel><title>"), "source", F.lit("</title>"), "x", F.lit("</channel></rss>")).alias("xml"))
    return A.feed_posts(feeds).select("post_id", "source", "url", "title")


@query("p22_fulltext_allowed", "P22 H-S27", sql("""
    SELECT host, count(*) AS pages, true AS allowed FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages) GROUP BY host"""))
def p22(spark, sf):
    p = X.table(spark, sf, "pages")
    return p.groupBy(T.domain(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.bool_and(T.fulltext_allowed(F.col("url"))).alias("allowed"))


def pages_with_data(spark, sf):
    """A page per document whose text stands in structured data, in embedded state, or in both."""
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NewsArticle", "Report", "Person")]), (F.col("doc_id") % 3 + 1).cast("int"))
    node = F.struct(kind.alias("@type"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("articleBody"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("description"))
    ld = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.array(node).alias("@graph")))).when(F.col("doc_id") % 5 == 1, F.to_json(F.array(node))).otherwise(F.to_json(node))
    state = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("short").alias("text"), F.struct(F.col("text").alias("Body"), F.lit("Twice told.").alias("html")).alias("node")),
                                                F.struct(F.lit("short").alias("text"), F.struct(F.lit("x").alias("Body"), F.lit("Twice told.").alias("html")).alias("node"))).alias("items")).alias("props")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">{bad</script><script type="application/ld+json">'), ld,
                    F.lit('</script><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></head><body></body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), F.lit("https://e.example.com/").alias("url"), html.alias("html"))


BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
PROSE = "trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("hx2_structured_bodies", "H-X2", sql(f"""
    SELECT doc_id AS page_id, CASE WHEN doc_id % 3 <> 2 AND length({BODY}) > 150 THEN md5({BODY}) ELSE md5('') END AS body FROM documents"""))
def hx2(spark, sf):
    out = A.parse_pages(pages_with_data(spark, sf))
    return out.select("page_id", F.md5(F.element_at("candidates", 2)).alias("body"))


@query("hx6_state_prose", "H-X6", sql(f"""
    SELECT doc_id AS page_id, md5(CASE WHEN length({PROSE}) >= 40 OR regexp_matches({PROSE}, '[.!?](\\s|$)') THEN {PROSE} || chr(10) || chr(10) ELSE '' END || 'Twice told.') AS prose FROM documents"""))
def hx6(spark, sf):
    out = A.parse_pages(pages_with_data(spark, sf))
    return out.select("page_id", F.md5(F.element_at("candidates", 3)).alias("prose"))
