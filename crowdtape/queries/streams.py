"""Streaming forms run over the event, document and conversation files until drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timing as TM
from ..session import prepare
from ..streaming import ingest as G
from ..streaming import retries as R
from ..streaming import scores as SC
from ..streaming import trades as TR
from . import fixtures as X
from .council import DURATIONS, FIT, durations
from .market import r4, r8, sql
from .registry import query
from .sentiment import REQ, SCORED


def arrivals(df, arrived, slices=3):
    """``df`` cut by arrival time into slices of about equal size, as functions that each write theirs."""
    df = df.withColumn("_at", arrived)
    cuts = df.agg(F.percentile_approx("_at", [k / slices for k in range(1, slices)], 10_000).alias("c")).first().c or []
    low = [None, *cuts]
    parts = [df.filter((F.lit(True) if a is None else F.col("_at") >= a) & (F.lit(True) if b is None else F.col("_at") < b)).drop("_at")
             for a, b in zip(low, [*cuts, None])]
    return [lambda path, part=part: part.write.mode("append").parquet(path) for part in parts]


def stream(spark, sf, name):
    prepare(spark)
    # the table is a file or a folder of part files: a pattern matches both (a plain path must be a folder).
    # All of it arrives at once, since the files of a table are in no order of time.
    s = G.file_stream(spark, f"{sf}/{name}[.]parquet", spark.read.parquet(f"{sf}/{name}.parquet").schema, files_per_batch=None)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def delta_stream(spark, sf):
    ev = stream(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string"))
    return ev.select(F.col("event_id").alias("delta_id"), t.alias("ticker"), "ts", F.array(t).alias("who"),
                     F.when(k % 2 == 0, "social").otherwise("news").alias("chan"),
                     (F.date_trunc("hour", "ts") + F.make_dt_interval(secs=(F.lit(1000) - F.col("value")))).alias("arrived"))


@query("t01_hourly_bars_stream", "T1 T4", sql("""
    SELECT symbol, bts AS ts, round(open,8) AS open, round(high,8) AS high, round(low,8) AS low, round(close,8) AS close, volume FROM hbars"""))
def t01(spark, sf):
    def build(ticks):
        return G.tick_bars(ticks, "1 hour", "10 minutes", symbol=F.col("event_type"), price=F.col("value"), volume=F.lit(1.0), order=[F.col("ts"), F.col("event_id")])

    bars, out = build(stream(spark, sf, "events")), G.scratch(spark, "bars")
    G.drain(bars, G.scratch(spark, "ck"), path=out)
    ends = lambda df: df["ts"] + F.make_dt_interval(hours=F.lit(1))
    whole = G.with_open_windows(spark.read.schema(bars.schema).parquet(out), X.table(spark, sf, "events"), build, end=ends, reach_seconds=0)
    return r8(whole, "open", "high", "low", "close")


@query("t02_dedup_stream", "T2 T9 J24", sql("SELECT CAST(min(doc_id) AS VARCHAR) AS post_id, sha1(text) AS url FROM documents GROUP BY text"))
def t02(spark, sf):
    d = stream(spark, sf, "documents")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("doc_id"))
    posts = d.select(F.col("source").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), F.sha1("text").alias("url"), at.alias("scraped_at"))
    log = G.scratch(spark, "log")
    G.drain(G.counted(posts), G.scratch(spark, "ck"), each=G.append_new_posts(log, order=("scraped_at", "post_id")))
    return spark.read.parquet(log).select("post_id", "url")


@query("t03_monotone_gate_stream", "T3", sql("""
    WITH a AS (SELECT 'U' || (user_id % 20) AS ticker, event_id AS delta_id, ts, date_trunc('hour', ts) + to_microseconds(CAST(round((1000 - value) * 1000000) AS BIGINT)) AS arr FROM events),
    m AS (SELECT *, max(ts) OVER (PARTITION BY ticker ORDER BY arr, delta_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
    SELECT ticker, delta_id, CASE WHEN seen IS NULL OR ts > seen THEN 'ADD' ELSE 'SKIP' END AS action FROM m"""))
def t03(spark, sf):
    out = G.scratch(spark, "gate")
    G.drain(delta_stream(spark, sf), G.scratch(spark, "ck"), each=G.monotone_gate(G.scratch(spark, "last"), out))
    return spark.read.parquet(out).select("ticker", "delta_id", "action")


@query("t06_sliding_bursts_stream", "T6 A8", sql("""
    WITH w AS (SELECT ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS as_of FROM deltas, range(1, 7) r(h) WHERE chan = 'social')
    SELECT ticker, as_of, count(*) AS burst FROM w GROUP BY ticker, as_of"""))
def t06(spark, sf):
    out = G.scratch(spark, "bursts")
    bursts = G.sliding_bursts(delta_stream(spark, sf))
    G.drain(bursts, G.scratch(spark, "ck"), path=out)
    return G.with_open_windows(spark.read.schema(bursts.schema).parquet(out), X.deltas(spark, sf), G.sliding_bursts, end=lambda df: df["as_of"], reach_seconds=6 * 3600)


@query("t05_retry_and_dead_letters", "T5", sql("""
    SELECT CASE WHEN n + 1 < 3 THEN 'retry' ELSE 'dead' END AS fate, count(*) AS posts FROM (SELECT user_id, count(*) % 4 AS n FROM events GROUP BY user_id) GROUP BY 1"""))
def t05(spark, sf):
    e = X.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("post_id")).agg((F.count(F.lit(1)) % 4).alias("attempts"))
    retry, dead = G.split_failures(e.select("post_id"), e)
    both = retry.select(F.lit("retry").alias("fate")).unionAll(dead.select(F.lit("dead").alias("fate")))
    return both.groupBy("fate").agg(F.count(F.lit(1)).alias("posts"))


@query("t07_chained_batch", "T7 T2 C16", sql("SELECT source AS ticker, count(*) AS posts FROM (SELECT text, arg_min(source, doc_id) AS source FROM documents GROUP BY text) GROUP BY source"))
def t07(spark, sf):
    d = stream(spark, sf, "documents")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("doc_id"))
    posts = d.select(F.col("source").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), F.sha1("text").alias("url"), at.alias("scraped_at"))
    log, out = G.scratch(spark, "log"), G.scratch(spark, "counts")

    def store(batch, batch_id):
        G.append_new_posts(log)(batch, batch_id)
        return spark.read.parquet(log).filter(F.col("batch") == batch_id)

    def count(batch, batch_id):
        n = batch.groupBy(F.col("platform").alias("ticker")).agg(F.count(F.lit(1)).alias("posts"))
        n.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    G.drain(posts, G.scratch(spark, "ck"), each=G.chain(store, count))
    return spark.read.parquet(out).groupBy("ticker").agg(F.sum("posts").alias("posts"))


@query("t07_post_chain", "T7 T2 S14 J6", sql("""
    WITH n AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
    p AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, source, md5(text) AS body FROM documents JOIN n USING (doc_id))
    SELECT p.post_id, p.source AS ticker, p.body AS delta, interest_score, CASE WHEN interest_score >= 60 AND status = 'ok' THEN 'interest' END AS mode
    FROM p LEFT JOIN interest USING (post_id)"""))
def t07_chain(spark, sf):
    """Every new post gets its summary stage row, its delta, its interest and its place in the queue."""
    from ..operators.posts import verdict_queue
    from ..sources import store as ST

    d = stream(spark, sf, "documents")
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("doc_id"))
    posts = d.select(F.col("source").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), F.sha1("text").alias("url"), at.alias("scraped_at"),
                     at.alias("posted_at"), F.md5("text").alias("text"), F.lit("").alias("title"))
    log, stages, deltas, queue = (G.scratch(spark, n) for n in ("log", "stages", "deltas", "queue"))
    scores = X.interest(spark, sf)

    def store(batch, batch_id):
        G.append_new_posts(log)(batch, batch_id)
        return spark.read.parquet(log).filter(F.col("batch") == batch_id).drop("batch")

    def summarise(new, batch_id):
        rows = ST.append_stage(new, F.col("post_id"), "summariser", F.to_json(F.struct("platform", "text")), F.col("scraped_at"))
        rows.write.mode("overwrite").parquet(f"{stages}/batch={batch_id}")
        return spark.read.parquet(f"{stages}/batch={batch_id}")

    def extract(summaries, batch_id):
        v = lambda k: F.get_json_object("payload", f"$.{k}")
        rows = summaries.select("post_id", v("platform").alias("ticker"), F.col("created_at").alias("ts"), v("text").alias("sum"))
        rows.write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")

    def enqueue(summaries, batch_id):
        new = spark.read.parquet(log).filter(F.col("batch") == batch_id)
        verdict_queue(new, summaries, scores, 60).write.mode("overwrite").parquet(f"{queue}/batch={batch_id}")

    G.drain(posts, G.scratch(spark, "ck"), each=G.chain(store, summarise, extract, enqueue))
    told = spark.read.parquet(deltas).select("post_id", "ticker", F.col("sum").alias("delta"))
    waiting = spark.read.parquet(queue).filter("mode = 'interest'").select("post_id", "mode")
    return told.join(scores.select("post_id", "interest_score"), "post_id", "left").join(waiting, "post_id", "left").select("post_id", "ticker", "delta", "interest_score", "mode")


@query("t10_duration_state_stream", "T10 A22", sql(f"""
    WITH f AS (SELECT {FIT} FROM ({DURATIONS})), b AS (SELECT *, (sxd * szz - szd * sxz) / (sxx * szz - sxz * sxz) AS b1, (szd * sxx - sxd * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM f)
    SELECT round(b1, 4) AS token_slope, round(b2, 4) AS summary_slope, round(md - b1 * mx - b2 * mz, 4) AS intercept, n FROM b"""))
def t10(spark, sf):
    rows = durations(stream(spark, sf, "documents"))
    out = G.scratch(spark, "state")

    def each(batch, batch_id):  # one mergeable state row per batch
        TM.duration_state(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    G.drain(rows, G.scratch(spark, "ck"), each=each)
    m = TM.duration_model(TM.merge_states(spark.read.parquet(out)))
    return m.select(F.round("article_coefficient", 4).alias("token_slope"), F.round("summary_coefficient", 4).alias("summary_slope"), F.round("intercept", 4).alias("intercept"), "n")


LATE = "epoch_us(as_of) < (SELECT max(epoch_us(ts)) FROM deltas) - 3600000000"


@query("t06_decayed_stream", "T6 A6 A7 A8", sql(f"""WITH {SCORED.replace(REQ, "SELECT DISTINCT ticker, date_trunc('hour', ts) + INTERVAL 1 HOUR AS as_of FROM deltas")}
    SELECT ticker, as_of, channel, round(des_raw,4) AS des_raw, round(confidence,4) AS confidence, n_deltas, burst FROM des WHERE channel = 'all' AND {LATE}"""))
def t06_decayed(spark, sf):
    """Deltas arrive in three slices up to half an hour late; the stream is stopped and started again between them."""
    prepare(spark)
    d = X.deltas(spark, sf)
    rows, out, ck = G.scratch(spark, "arrived"), G.scratch(spark, "scores"), G.scratch(spark, "ck")
    # an arrival is delayed by its id, so that slices overlap in time
    for arrive in arrivals(d, F.unix_micros("ts") + (F.col("delta_id") % 30) * 60_000_000):
        arrive(rows)
        SC.run(G.file_stream(spark, rows, d.schema), ck, out)
    got = spark.read.parquet(out)
    if got.isEmpty() and not d.isEmpty():
        raise ValueError("the stream closed no hour")
    return r4(got, "des_raw", "confidence").select("ticker", "as_of", "channel", "des_raw", "confidence", "n_deltas", "burst")


def post_columns(docs):
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("doc_id"))
    return docs.select(F.col("source").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), F.sha1("text").alias("url"), at.alias("scraped_at"))


@query("t04_backlog_then_live", "T4 T1", sql("""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN doc_id % 4 = 0 THEN 'backlog' ELSE 'live' END AS phase, 1 AS times FROM documents"""))
def t04(spark, sf):
    """A quarter is the backlog; one arrives while it is drained, two while the live query is stopped."""
    prepare(spark)
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    rows, out, ck, cutoff = (G.scratch(spark, n) for n in ("arrived", "phases", "ck", "cutoff"))
    arrive = lambda k: docs.filter(F.pmod("doc_id", F.lit(4)) == k).write.mode("append").parquet(rows)
    late = [1]

    def each(batch, batch_id, phase):
        if late:
            arrive(late.pop())
        batch.select("post_id", F.lit(phase).alias("phase")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    arrive(0)
    for k in (None, 2, 3):
        if k:
            arrive(k)
        q = G.backlog_then_live(post_columns(G.file_stream(spark, rows, docs.schema)), ck, each, cutoff, every="1 second")
        q.processAllAvailable()
        q.stop()
    return spark.read.parquet(out).groupBy("post_id", "phase").agg(F.count(F.lit(1)).cast("int").alias("times"))


OUTCOMES = """
    SELECT CAST(user_id AS VARCHAR) AS post_id, date_trunc('milliseconds', ts) AS t, event_type NOT IN ('error', 'view') AS ok, CAST(event_id AS VARCHAR) AS reason FROM events"""
FATES = f"""
  o AS ({OUTCOMES}),
  p AS (SELECT *, lead(t) OVER (PARTITION BY post_id ORDER BY t, ok, reason) AS next_t, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY post_id ORDER BY t, ok, reason) AS run FROM o),
  f AS (SELECT *, (row_number() OVER (PARTITION BY post_id, run ORDER BY t, reason) - 1) % 3 + 1 AS attempts FROM p WHERE NOT ok),
  d AS (SELECT *, t + to_hours(CAST(1 << (attempts - 1) AS INTEGER)) AS due, (SELECT max(t) - INTERVAL 1 HOUR FROM o) AS mark FROM f),
  fates AS (
    SELECT post_id, 'dead' AS fate, CAST(attempts AS INTEGER) AS attempts, t AS "at", reason FROM d WHERE attempts = 3 AND t < mark
    UNION ALL SELECT post_id, 'retry', CAST(attempts AS INTEGER), due, reason FROM d WHERE attempts < 3 AND due < mark AND (next_t IS NULL OR next_t >= due))"""


def settled(spark, sf):
    """Outcomes arrive in three slices up to half an hour late; the stream is stopped and started between them."""
    prepare(spark)
    e = X.table(spark, sf, "events")
    o = e.select(F.col("user_id").cast("string").alias("post_id"), F.date_trunc("millisecond", "ts").alias("at"),
                 (~F.col("event_type").isin("error", "view")).alias("ok"), F.col("event_id").cast("string").alias("reason"))
    rows, ck, queue, dead = (G.scratch(spark, n) for n in ("arrived", "ck", "queue", "dead"))
    for arrive in arrivals(o, F.unix_micros("at") + (F.col("reason").cast("long") % 30) * 60_000_000):
        arrive(rows)
        R.run(G.file_stream(spark, rows, o.schema), ck, queue, dead)
    kind = f"{R.FATES.replace('at long', 'at timestamp')}, batch long"
    return [spark.read.schema(kind).parquet(p).drop("batch") for p in (queue, dead)]


@query("t05_retry_stream", "T5", sql(f"WITH {FATES} SELECT * FROM fates"))
def t05_stream(spark, sf):
    queue, dead = settled(spark, sf)
    return queue.unionByName(dead)


@query("t05_skip_list", "T5", sql(f"""WITH {FATES} SELECT post_id, attempts, "at" AS failed_at, reason FROM fates WHERE fate = 'dead' ORDER BY "at" DESC, post_id LIMIT 200"""))
def t05_skip(spark, sf):
    return R.skip_list(settled(spark, sf)[1]).select("post_id", "attempts", "failed_at", "reason")


@query("t09_ingest_counters", "T9 A28 T2", sql("""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id % 3, doc_id) AS k FROM documents)
    SELECT doc_id % 3 AS batch, count(*) AS offered, count(*) FILTER (source IS NULL) AS without_key, count(*) FILTER (k = 1) AS accepted, count(*) FILTER (k > 1) AS duplicates
    FROM d GROUP BY 1"""))
def t09(spark, sf):
    """Three arrivals, a batch each; what was observed on the way in beside what the log took."""
    prepare(spark)
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    rows, log, ck, progress = G.scratch(spark, "arrived"), G.scratch(spark, "log"), G.scratch(spark, "ck"), []
    for k in range(3):
        docs.filter(F.pmod("doc_id", F.lit(3)) == k).write.mode("append").parquet(rows)
        q = G.drain(G.counted(post_columns(G.file_stream(spark, rows, docs.schema))), ck, each=G.chain(G.append_new_posts(log, order=("scraped_at", "post_id"))))
        progress += q.recentProgress
    return G.ingest_counters(progress, spark.read.parquet(log))


@query("t01_closed_bars_stream", "T1", sql("""
    SELECT symbol, bts AS ts, round(open,8) AS open, round(high,8) AS high, round(low,8) AS low, round(close,8) AS close, volume FROM hbars
    WHERE epoch_us(bts) + 3600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)"""))
def t01_closed(spark, sf):
    """Only what the stream itself has closed: the hours that end before its last watermark."""
    bars, out = G.tick_bars(stream(spark, sf, "events"), "1 hour", "10 minutes", symbol=F.col("event_type"), price=F.col("value"), volume=F.lit(1.0), order=[F.col("ts"), F.col("event_id")]), G.scratch(spark, "bars")
    G.drain(bars, G.scratch(spark, "ck"), path=out)
    return r8(spark.read.schema(bars.schema).parquet(out), "open", "high", "low", "close")


@query("t06_closed_bursts_stream", "T6 A8", sql("""
    WITH w AS (SELECT ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS as_of FROM deltas, range(1, 7) r(h) WHERE chan = 'social')
    SELECT ticker, as_of, count(*) AS burst FROM w WHERE epoch_us(as_of) <= (SELECT max(epoch_us(ts)) - 3600000000 FROM deltas) GROUP BY ticker, as_of"""))
def t06_closed(spark, sf):
    """Only what the stream itself has closed."""
    bursts, out = G.sliding_bursts(delta_stream(spark, sf)), G.scratch(spark, "bursts")
    G.drain(bursts, G.scratch(spark, "ck"), path=out)
    return spark.read.schema(bursts.schema).parquet(out)


@query("c10_trade_log_stream", "C10", sql("""
    WITH e AS (SELECT 'reddit-' || user_id || '-' || event_id % 5 AS trade_id, CASE WHEN event_type = 'error' THEN 'CLOSE' ELSE 'PLACED' END AS kind, date_trunc('milliseconds', ts) AS t, event_id
      FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
    k AS (SELECT *, (SELECT max(t) - INTERVAL 1 HOUR FROM e) AS mark FROM e),
    p AS (SELECT trade_id, 'PLACED' AS event_type, t AS "at", event_id FROM k WHERE kind = 'PLACED' AND t < mark QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY t, event_id) = 1),
    c AS (SELECT k.trade_id, 'CLOSE' AS event_type, k.t AS "at", k.event_id FROM k JOIN p ON p.trade_id = k.trade_id AND k.t >= p."at" WHERE kind = 'CLOSE' AND t < mark
      QUALIFY row_number() OVER (PARTITION BY k.trade_id ORDER BY k.t, k.event_id) = 1)
    SELECT * FROM p UNION ALL SELECT * FROM c"""))
def c10_stream(spark, sf):
    """Every event comes twice and up to half an hour late, in three slices with a restart between them."""
    prepare(spark)
    e = X.table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "signup", "error"))
    e = e.select(F.concat(F.lit("reddit-"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("trade_id"),
                 F.when(F.col("event_type") == "error", "CLOSE").otherwise("PLACED").alias("event_type"), F.date_trunc("millisecond", "ts").alias("at"), "event_id",
                 F.col("props").alias("payload"), F.explode(F.array(F.lit(7), F.lit(19))).alias("delay"))
    rows, ck, out = (G.scratch(spark, n) for n in ("arrived", "ck", "trades"))
    for arrive in arrivals(e, F.unix_micros("at") + (F.col("event_id") * F.col("delay") % 30) * 60_000_000):
        arrive(rows)
        TR.run(G.file_stream(spark, rows, e.schema), ck, out)
    return spark.read.parquet(out).select("trade_id", "event_type", "at", "event_id")
