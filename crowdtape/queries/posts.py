"""Listings, calendars, counters and set operations over posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import posts as P
from ..sources import store as ST
from . import fixtures as X
from .market import big, sql
from .registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
now = lambda: F.to_timestamp(F.lit("2024-01-31 00:00:00"))


@query("a01_calendar", "A1 J3 H-D5", sql("""
    SELECT CAST(coalesce(posted_at, scraped_at) AS DATE) AS day, count(*) AS posts,
      count(*) FILTER (WHERE post_id IN (SELECT post_id FROM stages WHERE stage = 'chairman')) AS analysed
    FROM posts WHERE coalesce(posted_at, scraped_at) >= DATE '2024-01-01' AND coalesce(posted_at, scraped_at) < DATE '2024-02-01' GROUP BY 1"""))
def a01(spark, sf):
    return P.calendar(X.posts(spark, sf), X.stages(spark, sf), 2024, 1)


@query("a02_counts", "A2", sql(f"""
    SELECT count(*) FILTER (WHERE CAST(scraped_at AS DATE) = DATE '2024-01-15') AS on_day,
      count(*) FILTER (WHERE scraped_at >= {NOW} - INTERVAL 48 HOUR) AS last_hours FROM posts"""))
def a02(spark, sf):
    return P.count_since(X.posts(spark, sf), now(), 48, F.to_date(F.lit("2024-01-15")))


@query("a03_top_platforms", "A3", sql(f"""
    SELECT platform, count(*) AS posts FROM posts WHERE scraped_at >= {NOW} - INTERVAL 240 HOUR GROUP BY platform ORDER BY posts DESC, platform LIMIT 10"""))
def a03(spark, sf):
    return P.top_platforms(X.posts(spark, sf), now(), 240, 10)


@query("a05_store_stats", "A4 A5", sql("""
    SELECT min(scraped_at) AS first_at, max(scraped_at) AS last_at, count(*) AS posts, (SELECT count(*) FROM (SELECT DISTINCT platform, post_id FROM posts)) AS keys FROM posts"""))
def a05(spark, sf):
    return P.store_stats(X.posts(spark, sf))


@query("a27_stage_catalog", "A27", sql("SELECT stage, count(DISTINCT post_id) AS posts FROM stages GROUP BY stage"))
def a27(spark, sf):
    return P.stage_catalog(X.stages(spark, sf))


@query("l01_listing_page", "L1 P4", sql("""
    SELECT post_id, scraped_at, substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 400) AS preview,
      (SELECT count(*) FROM posts) AS total FROM posts ORDER BY coalesce(scraped_at, posted_at) DESC, post_id LIMIT 50 OFFSET 50"""))
def l01(spark, sf):
    p = X.posts(spark, sf)
    total = p.agg(F.count(F.lit(1)).alias("total"))
    page = P.page(p, [P.listing_time().desc(), F.col("post_id")], 2, 50)
    return page.select("post_id", "scraped_at", P.preview(F.col("text")).alias("preview")).join(F.broadcast(total))


@query("l02_next_after", "L2", sql("""
    SELECT post_id, scraped_at FROM posts WHERE (scraped_at, post_id) > (TIMESTAMP '2024-01-10 02:00:00', '5') ORDER BY scraped_at, post_id LIMIT 100"""))
def l02(spark, sf):
    at = F.to_timestamp(F.lit("2024-01-10 02:00:00"))
    return P.next_after(X.posts(spark, sf), at, "5", 100).select("post_id", "scraped_at")


@query("l03_recent", "L3", sql("SELECT post_id, scraped_at FROM posts ORDER BY scraped_at DESC, post_id DESC LIMIT 10"))
def l03(spark, sf):
    return P.recent(X.posts(spark, sf), 10).select("post_id", "scraped_at")


@query("l08_pick_latest", "L8", sql("SELECT post_id, scraped_at FROM posts ORDER BY scraped_at DESC, post_id DESC LIMIT 1"))
def l08(spark, sf):
    return P.pick_latest(X.posts(spark, sf)).select("post_id", "scraped_at")


@query("l08_pick_random", "L8", sql("SELECT post_id, scraped_at FROM posts ORDER BY md5('7:' || post_id), post_id LIMIT 1"))
def l08_random(spark, sf):
    return P.pick_random(X.posts(spark, sf), 7).select("post_id", "scraped_at")


@query("l11_batch_targets", "L11", sql("""
    SELECT post_id, min(ordinal) AS ordinal FROM (SELECT CAST(user_id AS VARCHAR) AS post_id, event_id AS ordinal FROM events) GROUP BY post_id ORDER BY ordinal LIMIT 200"""))
def l11(spark, sf):
    ids = X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("post_id"), F.col("event_id").alias("ordinal"))
    return P.batch_targets(ids)


@query("l12_backlog_order", "L12", sql("""
    SELECT post_id, scraped_at, row_number() OVER (PARTITION BY source ORDER BY scraped_at NULLS LAST, post_id) AS place, source FROM
      posts"""))
def l12(spark, sf):
    from ..operators.records import positions

    head = positions(X.posts(spark, sf).select("post_id", "scraped_at", "source"), "source", "scraped_at", ["post_id"])
    return big(head.select("post_id", "scraped_at", F.col("position").alias("place"), "source"), "place")


@query("l13_warm_up", "L13", sql("""
    SELECT post_id FROM posts WHERE scraped_at <= TIMESTAMP '2024-01-20' AND post_id NOT IN (SELECT post_id FROM stages WHERE stage = 'summariser')
      AND post_id NOT IN (SELECT post_id FROM interest WHERE status = 'error')"""))
def l13(spark, sf):
    done = X.stages(spark, sf).filter("stage = 'summariser'")
    failed = X.interest(spark, sf).filter("status = 'error'")
    return P.warm_up(X.posts(spark, sf), F.to_timestamp(F.lit("2024-01-20")), done, failed).select("post_id")


@query("u07_snapshot_new_ids", "U7 U2", sql("""
    SELECT DISTINCT post_id FROM posts WHERE post_id NOT IN (SELECT post_id FROM stages WHERE stage = 'summariser')
      AND post_id NOT IN (SELECT post_id FROM interest WHERE status = 'error')"""))
def u07(spark, sf):
    done = X.stages(spark, sf).filter("stage = 'summariser'")
    failed = X.interest(spark, sf).filter("status = 'error'")
    return P.snapshot_new_ids(X.posts(spark, sf), done, failed)


@query("p03_search", "P3 J4", sql("""
    SELECT post_id, platform, source FROM posts WHERE (lower(title) LIKE '%the%' OR lower(text) LIKE '%the%')
      AND (posted_at >= TIMESTAMP '2024-01-05' OR scraped_at >= TIMESTAMP '2024-01-05') AND (posted_at < TIMESTAMP '2024-01-25' OR scraped_at < TIMESTAMP '2024-01-25')"""))
def p03(spark, sf):
    df = P.search(X.posts(spark, sf), text="the", since=F.to_timestamp(F.lit("2024-01-05")), until=F.to_timestamp(F.lit("2024-01-25")))
    return df.select("post_id", "platform", "source")


@query("p06_related_window", "P6", sql("""
    WITH r AS (SELECT post_id AS ref_id, scraped_at AS t FROM posts)
    SELECT ref_id, post_id FROM r JOIN posts p ON p.scraped_at BETWEEN r.t - INTERVAL 3 DAY AND r.t + INTERVAL 1 DAY WHERE p.post_id <> ref_id"""))
def p06(spark, sf):
    """Every post is a reference."""
    p = X.posts(spark, sf)
    refs = p.select("scraped_at", "post_id")
    return P.related_window(p.select("post_id", "scraped_at"), refs, before_days=3, after_days=1).select("ref_id", "post_id")


@query("p10_drop_with_audit", "P10 S17 P11", sql("""
    SELECT CASE WHEN source IN (SELECT min(source) FROM posts) THEN 'removed' ELSE 'kept' END AS verdict, count(*) AS posts FROM posts GROUP BY 1"""))
def p10(spark, sf):
    p = X.posts(spark, sf).withColumns({"platform": F.lit("rss"), "domain": F.lit("")})
    low = p.agg(F.min("source").alias("_s"))
    p = p.join(F.broadcast(low))
    kept, removed = P.filter_audit(p, (F.lower("platform") == "rss") & (F.col("source") == F.col("_s")))
    both = kept.select(F.lit("kept").alias("verdict")).unionAll(removed.select(F.lit("removed").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("posts"))


@query("s04_normalised_posts", "S4 S3", sql("""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, 'reddit' AS platform, source, CAST(doc_id AS VARCHAR) AS title, n_chars::DOUBLE AS score FROM documents"""))
def s04(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(" ").alias("platform"), F.col("source").alias("label"),
                                              F.col("n_chars").alias("score"), "text")
    return ST.normalise_posts(d).select("post_id", "platform", "source", "title", "score")


@query("s13_upsert", "S13 U1 U6 J28", sql("""
    SELECT post_id, arg_max(quality, v) AS quality, max(v) AS v FROM (
      SELECT CAST(doc_id AS VARCHAR) AS post_id, CAST(-1 AS BIGINT) AS quality, CAST(0 AS BIGINT) AS v FROM documents
      UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(quality AS BIGINT), CAST(1 AS BIGINT) FROM labels) GROUP BY post_id"""))
def s13(spark, sf):
    old = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"), F.lit(-1).cast("long").alias("quality"), F.lit(0).cast("long").alias("v"))
    new = X.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"), F.col("quality").cast("long"), F.lit(1).cast("long").alias("v"))
    return ST.upsert(old, new, ["post_id"], ["v"])


@query("s15_clear_analysis", "S15 P21", sql("""
    SELECT stage, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS kept FROM (SELECT stage, stage <> 'summariser' AS gone FROM stages) GROUP BY stage"""))
def s15(spark, sf):
    kept, removed = ST.clear_analysis(X.stages(spark, sf))
    both = kept.select("stage", F.lit(False).alias("g")).unionAll(removed.select("stage", F.lit(True).alias("g")))
    return both.groupBy("stage").agg(F.count_if("g").alias("removed"), F.count_if(~F.col("g")).alias("kept"))


@query("s02_union_columns", "S2", sql("""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, source, '' AS quality FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), '', CAST(quality AS VARCHAR) FROM labels"""))
def s02(spark, sf):
    a = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"), "source")
    b = X.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"), F.col("quality").cast("string").alias("quality"))
    return ST.union_columns(a, b)


@query("s01_log_time_parse", "S1 H-D1", sql("""
    SELECT count(*) AS rows_read, count(TRY_CAST(t AS TIMESTAMP)) AS parsed FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN '' ELSE CAST(ts AS VARCHAR) END AS t FROM events)"""))
def s01(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 == 1, "").otherwise(F.col("ts").cast("string"))
    df = ST.with_parsed_time(X.table(spark, sf, "events").select(raw.alias("scraped_at")))
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.count("ts").alias("parsed"))


@query("hx7_merge_refetched", "H-X7 A17", sql("""
    SELECT CASE WHEN l.doc_id IS NULL THEN '' WHEN quality = 1 THEN 'ok' ELSE 'short' END AS fetch_status, count(*) AS rows,
      count(*) FILTER (WHERE quality = 1) AS text_updates, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND doc_id % 3 = 0) AS title_updates, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS final_url_updates
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""".replace("AS rows", 'AS "rows"')))
def hx7(spark, sf):
    p = X.posts(spark, sf).withColumns({"final_url": F.lit(""), "fetch_status": F.lit(""), "title": F.when(F.col("post_id").cast("long") % 3 == 0, " ").otherwise("t")})
    lb = X.table(spark, sf, "labels")
    url = X.posts(spark, sf).select("post_id", "url")
    f = lb.withColumn("post_id", F.col("doc_id").cast("string")).join(url, "post_id").select(
        "url", F.when(F.col("quality") == 1, F.concat(F.lit("new "), F.col("post_id"))).otherwise("").alias("text"),
        F.lit("x").alias("title"), F.col("url").alias("final_url"), F.when(F.col("quality") == 1, "ok").otherwise("short").alias("fetch_status"))
    return P.refetch_report(P.merge_refetched(p, f))
