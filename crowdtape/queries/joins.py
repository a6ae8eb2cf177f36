"""As-of, interval, semi/anti and look-up joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import posts as P
from ..operators import records as R
from . import fixtures as X
from .market import big, r4, r8, sql
from .registry import query


def _asof(spark, sf, **kw):
    s = X.signals(spark, sf)
    bars = X.daily_bars(spark, sf).select("symbol", "ts", "open", "close")
    bars = bars.withColumnRenamed("ts", "bar_ts")
    out = A.asof_join(s, bars, ["symbol"], right_ts="bar_ts", **{"bucket": "year", **kw})
    return r8(out.select("signal_id", "symbol", "ts", "asof.bar_ts", "asof.open", "asof.close"), "open", "close")


def _asof_sql(op):
    return sql(f"""SELECT s.signal_id, s.symbol, s.ts, b.ts AS bar_ts, round(b.open,8) AS open, round(b.close,8) AS close
        FROM signals s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.ts {op} b.ts""")


@query("j15_asof_backward", "J15", _asof_sql(">="))
def j15(spark, sf):
    return _asof(spark, sf)


@query("j16_asof_forward", "J16", _asof_sql("<="))
def j16(spark, sf):
    return _asof(spark, sf, direction="forward")


@query("j15_asof_by_depth", "J15", _asof_sql(">="))
def j15_depth(spark, sf):
    """Buckets of 200 rows, wherever they lie."""
    return _asof(spark, sf, bucket=200)


@query("j16_asof_forward_strict", "J16", _asof_sql("<"))
def j16_strict(spark, sf):
    return _asof(spark, sf, direction="forward", strict=True)


@query("j17_price_window", "J17 W31", sql("""
    SELECT s.signal_id, s.symbol, b.ts, round(b.close,8) AS close, t.ts AS t0_ts, round(t.close,8) AS t0_close,
      round(epoch(b.ts) - epoch(s.ts),4) AS seconds_from_center, round(b.close/t.close - 1,4) AS return_from_t0
    FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.ts BETWEEN s.ts - INTERVAL 3 DAY AND s.ts + INTERVAL 3 DAY
    LEFT JOIN (SELECT s2.signal_id, b2.ts, b2.close FROM signals s2 ASOF JOIN bars b2 ON s2.symbol = b2.symbol AND s2.ts >= b2.ts WHERE b2.ts >= s2.ts - INTERVAL 3 DAY) t
      ON t.signal_id = s.signal_id"""))
def j17(spark, sf):
    d3 = F.expr("INTERVAL 3 DAYS")
    out = A.price_window(X.signals(spark, sf), X.daily_bars(spark, sf), before=d3, after=d3, bucket_seconds=7 * 86400)
    out = out.select("signal_id", "symbol", "ts", "close", "t0_ts", "t0_close", "seconds_from_center", "return_from_t0")
    return r8(r4(out, "seconds_from_center", "return_from_t0"), "close", "t0_close")


@query("j02_posts_interest", "J2 P2", sql("""
    SELECT p.post_id, coalesce(p.scraped_at, p.posted_at) AS at, i.interest_score, i.status FROM posts p LEFT JOIN interest i USING (post_id)"""))
def j02(spark, sf):
    p, i = X.posts(spark, sf), X.interest(spark, sf)
    return p.join(i, "post_id", "left").select("post_id", P.listing_time().alias("at"), "interest_score", "status")


@query("j01_verdicts_with_posts", "J1 P2", sql("""
    SELECT s.post_id, coalesce(p.posted_at, p.scraped_at) AS article_at, s.created_at FROM stages s JOIN posts p USING (post_id) WHERE s.stage = 'chairman'"""))
def j01(spark, sf):
    s = X.stages(spark, sf).filter(F.col("stage") == "chairman")
    return s.join(X.posts(spark, sf), "post_id").select("post_id", P.event_time().alias("article_at"), "created_at")


@query("j03_stage_flags", "J3", sql("""
    SELECT p.post_id, EXISTS (SELECT 1 FROM stages s WHERE s.post_id = p.post_id AND s.stage = 'summariser') AS has_summary,
      EXISTS (SELECT 1 FROM stages s WHERE s.post_id = p.post_id AND s.stage = 'chairman') AS has_analysis,
      EXISTS (SELECT 1 FROM stages s WHERE s.post_id = p.post_id AND s.stage = 'chairman') AS has_verdict FROM posts p"""))
def j03(spark, sf):
    return P.with_flags(X.posts(spark, sf), X.stages(spark, sf)).select("post_id", "has_summary", "has_analysis", "has_verdict")


@query("j04_interesting_posts", "J4", sql("""
    SELECT post_id, title FROM posts p WHERE EXISTS (SELECT 1 FROM interest i WHERE i.post_id = p.post_id AND i.status = 'ok' AND i.interest_score >= 60)"""))
def j04(spark, sf):
    return P.interesting(X.posts(spark, sf), X.interest(spark, sf), 60).select("post_id", "title")


@query("j05_posts_without_summary", "J5", sql("""
    SELECT post_id FROM posts WHERE post_id NOT IN (SELECT post_id FROM stages WHERE stage = 'summariser')"""))
def j05(spark, sf):
    return P.without_stage(X.posts(spark, sf), X.stages(spark, sf), "summariser").select("post_id")


QUEUE = """SELECT p.post_id, p.title, coalesce(i.interest_score, 0) AS interest_score, coalesce(p.posted_at, p.scraped_at) AS article_time,
      CASE WHEN i.status = 'ok' AND i.interest_score >= 100 AND v.post_id IS NOT NULL THEN 'has_verdict' {rest} END AS mode
    FROM posts p LEFT JOIN interest i USING (post_id) LEFT JOIN (SELECT DISTINCT post_id FROM stages WHERE stage = 'chairman') v USING (post_id)"""
QUEUE_PLAIN = QUEUE.format(rest="WHEN i.status = 'ok' AND i.interest_score >= 100 THEN 'interest'")
QUEUE_REPAIR = QUEUE.replace('>= 100','>= 10').format(rest="WHEN v.post_id IS NULL AND coalesce(i.interest_score,0) >= 10 THEN 'repair' WHEN v.post_id IS NULL THEN 'below_threshold'")


@query("j06_verdict_queue", "J6 L6", sql(f"SELECT * FROM ({QUEUE_PLAIN}) WHERE mode IS NOT NULL"))
def j06(spark, sf):
    return P.verdict_queue(X.posts(spark, sf), X.stages(spark, sf), X.interest(spark, sf), 100)


@query("a25_queue_counts", "A25 L6", sql(f"""
    SELECT count(*) FILTER (WHERE mode IN ('interest','repair')) AS total, count(*) FILTER (WHERE mode = 'has_verdict') AS skipped_with_verdict,
      count(*) FILTER (WHERE mode = 'below_threshold') AS skipped_below_threshold, count(*) FILTER (WHERE mode = 'repair') AS repairs FROM ({QUEUE_REPAIR})"""))
def a25(spark, sf):
    return P.queue_counts(P.verdict_queue(X.posts(spark, sf), X.stages(spark, sf), X.interest(spark, sf), 10, repair=True))


@query("l06_ordered_queue", "L6", sql(f"""
    SELECT post_id, mode, article_time FROM ({QUEUE_REPAIR}) WHERE mode IN ('interest','repair')"""))
def l06(spark, sf):
    q = P.verdict_queue(X.posts(spark, sf), X.stages(spark, sf), X.interest(spark, sf), 10, repair=True)
    q = q.filter(F.col("mode").isin("interest", "repair"))
    return q.orderBy(*P.queue_order()).select("post_id", "mode", "article_time")


@query("j07_interest_backfill", "J7", sql("""
    SELECT p.post_id, p.title, coalesce(p.scraped_at, p.posted_at) AS at FROM posts p LEFT JOIN interest i USING (post_id)
    WHERE p.post_id IN (SELECT post_id FROM stages WHERE stage = 'summariser') AND (i.post_id IS NULL OR i.status <> 'ok' OR coalesce(i.error_code,'') = 'price_data_unavailable')"""))
def j07(spark, sf):
    return P.interest_backfill(X.posts(spark, sf), X.stages(spark, sf), X.interest(spark, sf))


def _log(spark, sf):
    p = X.posts(spark, sf)
    return p.select("platform", "post_id", F.sha1("text").alias("content"), "scraped_at", F.col("post_id").cast("long").alias("n"))


@query("j24_dedup_against_log", "J24", sql("""
    WITH b AS (SELECT platform, post_id, text, CAST(post_id AS BIGINT) AS n FROM posts),
    log AS (SELECT * FROM b WHERE platform = (SELECT min(platform) FROM posts)),
    fresh AS (SELECT * FROM b WHERE platform <> (SELECT min(platform) FROM posts) AND text NOT IN (SELECT text FROM log))
    SELECT arg_min(platform, n) AS platform, CAST(min(n) AS VARCHAR) AS post_id, sha1(text) AS content FROM fresh GROUP BY text"""))
def j24(spark, sf):
    df = _log(spark, sf)
    first = F.broadcast(df.agg(F.min("platform").alias("_p")))
    both = df.join(first)
    log = both.filter("platform = _p").drop("_p")
    batch = both.filter("platform <> _p").drop("_p")
    out = P.dedup_against_log(batch, log, [["platform", "post_id"], ["content"]], ["n"])
    return out.select("platform", "post_id", "content")


@query("a28_ingest_counts", "A28 J24", sql("""
    SELECT count(*) AS offered, count(DISTINCT text) AS accepted, count(*) - count(DISTINCT text) AS duplicates FROM posts"""))
def a28(spark, sf):
    df = _log(spark, sf)
    done = P.dedup_against_log(df, df.limit(0), [["platform", "post_id"], ["content"]], ["n"])
    return P.ingest_counts(df, done)


@query("j25_sync_backlog", "J25", sql("""
    WITH l AS (SELECT CAST(post_id AS BIGINT) AS n, platform, post_id FROM posts), r AS (SELECT platform, post_id FROM posts JOIN interest USING (post_id) WHERE status = 'error')
    SELECT post_id, n FROM l WHERE n > (SELECT max(n) FROM l SEMI JOIN r USING (platform, post_id)) AND post_id NOT IN (SELECT post_id FROM r)"""))
def j25(spark, sf):
    loc = X.posts(spark, sf).select("platform", "post_id", F.col("post_id").cast("long").alias("n"))
    rem = X.posts(spark, sf).join(X.interest(spark, sf).filter("status = 'error'"), "post_id", "left_semi")
    return P.sync_backlog(loc, rem, ["platform", "post_id"], "n").select("post_id", "n")


@query("w23_latest_payload", "W23", sql("""
    SELECT post_id, stage, max(created_at) AS created_at, CAST(arg_max(quality, created_at) AS BIGINT) AS quality FROM stages GROUP BY post_id, stage"""))
def w23(spark, sf):
    df = P.latest_payload(X.stages(spark, sf))
    q = F.get_json_object("payload", "$.quality").cast("long")
    return df.select("post_id", "stage", "created_at", q.alias("quality"))


@query("w24_last_records", "W24", sql("""
    SELECT ticker, delta_id, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts, delta_id) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, delta_id DESC) AS rn FROM deltas) WHERE rn <= 25"""))
def w24(spark, sf):
    return big(R.last_n(X.deltas(spark, sf), 25).select("ticker", "delta_id", "ts", "pos"), "pos")


def conversation_records(spark, sf):
    """Turns as records: system turns are memories, others deltas; one minute apart."""
    c = X.table(spark, sf, "conversations")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))
    c = c.select(F.concat(F.lit("C"), (F.col("conv_id") % 7).cast("string")).alias("ticker"), at.alias("ts"), "role",
                 F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"), "text")
    d = c.filter("role <> 'system'").withColumnRenamed("text", "sum")
    m = c.filter("role = 'system'").select("ticker", F.col("ts").alias("range_end"), "record_id", F.col("text").alias("note"))
    return d, m


CONV = """SELECT 'C' || (conv_id % 7) AS ticker, TIMESTAMP '2024-01-01' + to_minutes(turn) AS at,
    CASE WHEN role = 'system' THEN 'memory' ELSE 'delta' END AS kind, conv_id || '/' || turn AS record_id, text AS body FROM conversations"""


@query("w25_as_of_records", "W25 C20", sql(f"""
    WITH c AS ({CONV}), q AS (SELECT DISTINCT ticker, c.at AS as_of FROM c), j AS (
      SELECT q.ticker, q.as_of, c.kind, c.record_id, c.at, row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY c.at DESC, c.kind DESC, c.record_id DESC) AS rn
      FROM q JOIN c ON c.ticker = q.ticker AND c.at <= q.as_of)
    SELECT ticker, as_of, kind, record_id, j.at, row_number() OVER (PARTITION BY ticker, as_of ORDER BY j.at, kind, record_id) AS pos FROM j WHERE rn <= 40"""))
def w25(spark, sf):
    d, m = conversation_records(spark, sf)
    req = d.select("ticker", F.col("ts").alias("as_of")).union(m.select("ticker", "range_end")).distinct()
    return R.as_of_records(req, d, m, limit=40).drop("body")


@query("c20_memory_context", "C20", sql(f"""
    WITH c AS ({CONV}), q AS (SELECT DISTINCT ticker, c.at AS as_of FROM c), j AS (
      SELECT q.ticker, q.as_of, c.kind, c.record_id, c.at, c.body, row_number() OVER (PARTITION BY q.ticker, q.as_of ORDER BY c.at DESC, c.kind DESC, c.record_id DESC) AS rn
      FROM q JOIN c ON c.ticker = q.ticker AND c.at <= q.as_of)
    SELECT ticker, as_of, row_number() OVER (PARTITION BY ticker, as_of ORDER BY j.at, kind, record_id) AS pos,
      '(' || kind || ') [' || strftime(j.at, '%Y-%m-%dT%H:%M:%SZ') || '] ' || coalesce(body, '') AS line FROM j WHERE rn <= 40
    UNION ALL SELECT ticker, as_of, 0, 'AS_OF cutoff = ' || strftime(as_of, '%Y-%m-%dT%H:%M:%SZ') FROM q"""))
def c20(spark, sf):
    d, m = conversation_records(spark, sf)
    req = d.select("ticker", F.col("ts").alias("as_of")).union(m.select("ticker", "range_end")).distinct()
    return R.context_lines(R.as_of_records(req, d, m, limit=40))


@query("a24_roll_up_set", "A24", sql("""
    WITH e AS (SELECT ticker, min(ts) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, delta_id DESC) AS rn FROM deltas) WHERE rn <= 50 GROUP BY ticker HAVING count(*) = 50)
    SELECT ticker, count(*) AS older, min(ts) AS range_start, max(ts) AS range_end FROM deltas JOIN e USING (ticker) WHERE ts < edge GROUP BY ticker"""))
def a24(spark, sf):
    return R.roll_up_set(X.deltas(spark, sf), 50)


@query("a24_roll_up_lines", "A24", sql("""
    WITH e AS (SELECT ticker, min(ts) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, delta_id DESC) AS rn FROM deltas) WHERE rn <= 50 GROUP BY ticker HAVING count(*) = 50)
    SELECT ticker, delta_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '] ' || ticker || ' :: ' || "sum" || ' (dir=' || dir || ', imp=' || impact || ')' AS line
    FROM deltas JOIN e USING (ticker) WHERE ts < edge"""))
def a24_lines(spark, sf):
    return R.roll_up_lines(X.deltas(spark, sf), 50)


@query("t03_monotone_gate_batch", "T3", sql("""
    WITH a AS (SELECT ticker, delta_id, ts, impact, date_trunc('hour', ts) AS arrived FROM deltas),
    m AS (SELECT *, max(ts) OVER (PARTITION BY ticker ORDER BY arrived, impact, delta_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
    SELECT ticker, delta_id, CASE WHEN seen IS NULL OR ts > seen THEN 'ADD' ELSE 'SKIP' END AS action FROM m"""))
def t03_batch(spark, sf):
    # arrivals are shuffled inside each hour so that some deltas come late
    d = X.deltas(spark, sf).withColumn("arrived", F.date_trunc("hour", "ts"))
    return R.running_gate(d, ["arrived", "impact", "delta_id"]).select("ticker", "delta_id", "action")
