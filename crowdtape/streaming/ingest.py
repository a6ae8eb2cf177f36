"""Continuous forms of the operators: resume, deduplicate, gate, retry, count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.posts import dedup_against_log
from ..operators.records import running_gate
from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = 64) -> DataFrame:
    """Rows of newly arrived files; the checkpoint of the query that reads it is the cursor.  A batch
    takes up to ``files_per_batch`` of them (None: all)."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(folder)


def drain(stream: DataFrame, checkpoint: str, *, path: str | None = None, each: Callable | None = None, mode: str = "append", name: str | None = None):
    """T4, first phase: process everything that is there and stop."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if name:
        w = w.queryName(name)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", path)
    q = w.start()
    q.awaitTermination()
    return q


def backlog_then_live(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int, str], None], cutoff: str, every: str = "30 seconds"):
    """T4: drain the backlog, write down where it ended, then go on live with the same checkpoint; returns
    the running query.

    ``each(batch, batch_id, phase)`` gets "backlog" or "live". The ``cutoff`` folder holds the number of the
    last backlog batch. Stopped and started again, the query finds it there and goes on live; stopped within
    the backlog, it goes on with the backlog. Rows that arrive during the handover are in the checkpoint's
    next batch, so each comes once.
    """
    spark = stream.sparkSession
    if not _exists(spark, f"{cutoff}/_SUCCESS"):
        last = [-1]

        def backlog(batch: DataFrame, batch_id: int) -> None:
            each(batch, batch_id, "backlog")

        q = drain(stream, checkpoint, each=backlog)
        if q.lastProgress:
            last[0] = q.lastProgress["batchId"]
        spark.createDataFrame([(last[0],)], "batch long").coalesce(1).write.mode("overwrite").parquet(cutoff)

    def live(batch: DataFrame, batch_id: int) -> None:
        each(batch, batch_id, "live")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(live).trigger(processingTime=every).start()


def recent_duplicates_dropped(stream: DataFrame, ts: str = "scraped_at", horizon: str = "2 days") -> DataFrame:
    """T2, bounded horizon: state holds only the keys of the last ``horizon``."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["platform", "post_id"])


def append_new_posts(log_path: str, keys=(("platform", "post_id"), ("url",)), order=("scraped_at", "post_id")) -> Callable:
    """T2, unbounded history: a batch function that appends posts the log has by no key.

    A batch writes its own folder and reads only older ones, so a replayed batch replaces what it
    wrote before: each post is stored exactly once.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # only the key columns of the log are ever read
        parts = list(dict.fromkeys(c for key in keys for c in key))
        kinds = ", ".join(f"{c} {batch.schema[c].dataType.simpleString()}" for c in parts)
        log = _stored_before(spark, log_path, batch_id, kinds)
        fresh = dedup_against_log(batch, log, [list(k) for k in keys], list(order))
        fresh.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return each


def with_open_windows(closed: DataFrame, rows: DataFrame, build: Callable[[DataFrame], DataFrame], *, end: Callable[[DataFrame], Column], reach_seconds: int) -> DataFrame:
    """A drained windowed stream with the windows that its watermark has not closed yet: ``build`` makes
    them from those static ``rows`` (ts) that lie after, or within ``reach_seconds`` before, the last
    closed window.  Closed and open windows together are all windows."""
    last = closed.agg(F.max(end(closed)).alias("m")).first().m
    if last is None:
        return build(rows)
    since = F.lit(last).cast("timestamp")
    tail = build(rows.filter(F.col("ts") >= since - F.make_dt_interval(secs=F.lit(reach_seconds))))
    return closed.unionByName(tail.filter(end(tail) > since))


def monotone_gate(state_path: str, out_path: str, max_tickers: int | None = 6) -> Callable:
    """A batch function; per ticker, ADD a delta newer than everything that arrived before it, else SKIP.

    State is one time per ticker and batch, in its own folder.  A hot ticker is split by arrival hours (see
    ``running_gate``), so no task holds a whole ticker.  Batches have delta_id, ts, arrived and who; a delta
    fans out to the first ``max_tickers`` (None: all) of its tickers.  A replayed batch replaces what it wrote.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        who = F.array_distinct(F.transform("who", F.upper))
        flat = batch.withColumn("ticker", F.explode(who if max_tickers is None else F.slice(who, 1, max_tickers)))
        flat = flat.select("ticker", "delta_id", "ts", "arrived")
        last = _stored_before(batch.sparkSession, state_path, batch_id, "ticker string, ts timestamp").groupBy("ticker").agg(F.max("ts").alias("last"))
        gated = running_gate(flat, ["arrived", "delta_id"], last=last)
        gated.select("ticker", "delta_id", "action").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        flat.groupBy("ticker").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return each


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _stored_before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What earlier batches wrote under ``path``; empty before the first."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(path).filter(F.col("batch") < batch_id).drop("batch")


def split_failures(failed: DataFrame, attempts: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """T5: failed ids with their attempt count raised: (to retry, given up)."""
    a = attempts.groupBy("post_id").agg(F.max("attempts").alias("_a"))
    n = failed.join(a, "post_id", "left").withColumn("attempts", F.coalesce("_a", F.lit(0)) + 1).drop("_a")
    return n.filter(F.col("attempts") < limit), n.filter(F.col("attempts") >= limit)


def keep_newest(rows: DataFrame, n: int = 200, ts: str = "failed_at", key: str = "post_id") -> DataFrame:
    """T5: retention of the skip list."""
    return rows.orderBy(F.desc(ts), key).limit(n)


def sliding_bursts(deltas: DataFrame, hours: int = 6, slide: int = 1, late: str = "1 hour") -> DataFrame:
    """Social deltas per ticker in sliding windows; partial sums are merged before the shuffle."""
    return (
        deltas.withWatermark("ts", late).filter(F.col("chan") == "social")
        .groupBy("ticker", F.window("ts", f"{hours} hours", f"{slide} hours")).agg(F.count(F.lit(1)).alias("burst"))
        .select("ticker", F.col("window.end").alias("as_of"), "burst")
    )


def tick_bars(ticks: DataFrame, every: str, late: str, *, symbol: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """Bars from a stream of ticks: a bar is final once the watermark passes its end."""
    k = F.struct(*order)
    t = ticks.withWatermark("ts", late).select(symbol.alias("symbol"), "ts", price.alias("p"), volume.alias("v"), k.alias("k"))
    return t.groupBy("symbol", F.window("ts", every)).agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def counted(stream: DataFrame, name: str = "ingest") -> DataFrame:
    """Rows offered and rows without a key, reported with the progress of every batch."""
    return stream.observe(
        name, F.count(F.lit(1)).alias("offered"), F.count_if(F.coalesce(F.trim("post_id"), F.lit("")) == "").alias("without_key")
    )


def ingest_counters(progress: list, log: DataFrame, name: str = "ingest") -> DataFrame:
    """(batch, offered, without_key, accepted, duplicates) of the batches in ``progress``, a query's
    ``recentProgress``: what ``counted`` observed beside what the log took in. Batches have to read their
    input once (``chain`` persists it), else the observation counts it again."""
    seen = [(p["batchId"], m["offered"], m["without_key"]) for p in progress if (m := p.observedMetrics.get(name))]
    offered = log.sparkSession.createDataFrame(seen, "batch long, offered long, without_key long")
    accepted = log.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("accepted"))
    both = offered.join(accepted, "batch", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0).cast("long")))
    return both.withColumn("duplicates", F.col("offered") - F.col("accepted"))


def chain(*steps: Callable[[DataFrame, int], DataFrame | None]) -> Callable:
    """Run the steps of a new batch one after the other, each on the output of the one before; a
    step that returns nothing passes its input on."""
    def each(batch: DataFrame, batch_id: int) -> None:
        df = batch.persist()
        try:
            cur = df
            for step in steps:
                out = step(cur, batch_id)
                cur = cur if out is None else out
        finally:
            df.unpersist()

    return each
