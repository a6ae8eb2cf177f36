"""Conversation records: deltas and memories per ticker, read without looking ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_n(records: DataFrame, n: int, key: str = "ticker", order=("ts", "delta_id")) -> DataFrame:
    """The newest ``n`` records per key (``pos`` counts up in time).

    ``row_number <= n`` has a group limit before the shuffle, so a hot ticker ships few rows.
    """
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    up = W.partitionBy(key).orderBy(F.col("_rn").desc())
    return kept.withColumn("pos", F.row_number().over(up)).drop("_rn")


def as_of_records(
    requests: DataFrame, deltas: DataFrame, memories: DataFrame, limit: int = 500,
    tie: str = "record_id",
) -> DataFrame:
    """For each (ticker, as_of), deltas at or before the moment plus memories whose range ended
    by then, the newest ``limit`` of them in time order.

    Every record gets its position in the ticker's history; a request finds its own position by an
    as-of lookup and takes the ``limit`` positions before it, so no request meets the whole history.
    """
    from .asof import asof_join

    recs = deltas.select("ticker", F.col("ts").alias("at"), F.lit("delta").alias("kind"),
                         F.col(tie).alias("record_id"), F.col("sum").alias("body")).unionByName(
        memories.select("ticker", F.col("range_end").alias("at"), F.lit("memory").alias("kind"),
                        F.col(tie).alias("record_id"), F.col("note").alias("body")))
    placed = positions(recs, "ticker", "at", ["kind", "record_id"])
    heads = placed.groupBy("ticker", "at").agg(F.max("position").alias("position"))
    req = asof_join(requests.select("ticker", "as_of"), heads, ["ticker"], left_ts="as_of",
                    right_ts="at", columns=["position"], name="_h")
    req = req.filter("_h is not null").withColumn("_last", F.col("_h.position")).drop("_h")
    first = F.greatest(F.lit(1), F.col("_last") - limit + 1)
    req = req.withColumn("_first", first)
    slot = lambda c: F.floor(c / limit)
    wanted = req.withColumn("_slot", F.explode(F.sequence(slot(F.col("_first")), slot(F.col("_last")))))
    joined = wanted.join(placed.withColumn("_slot", slot(F.col("position"))), ["ticker", "_slot"])
    return joined.filter(F.col("position").between(F.col("_first"), F.col("_last"))).select(
        "ticker", "as_of", "kind", "record_id", "at", "body",
        (F.col("position") - F.col("_first") + 1).cast("long").alias("pos"),
    )


def positions(df: DataFrame, key: str, ts: str, ties: list[str], bucket: str = "hour") -> DataFrame:
    """Running position of each row in its key's history: rank inside a time bucket plus the count
    of the buckets before it, so that no key is sorted by a single task."""
    b = df.withColumn("_b", F.date_trunc(bucket, F.col(ts)))
    counts = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    w = W.partitionBy(key, "_b").orderBy(ts, *ties)
    return (
        b.join(starts, [key, "_b"]).withColumn("position", F.col("_s") + F.row_number().over(w))
        .drop("_b", "_s")
    )


def roll_up_set(deltas: DataFrame, keep_latest: int, tie: str = "delta_id") -> DataFrame:
    """Per ticker, how many deltas are strictly older than the ``keep_latest``-th newest one and
    which range they cover.  The threshold comes from a per-key top-N."""
    newest = last_n(deltas, keep_latest, order=("ts", tie))
    edge = newest.groupBy("ticker").agg(
        F.min("ts").alias("_edge"), F.count(F.lit(1)).alias("_have")
    ).filter(F.col("_have") == keep_latest)
    return (
        deltas.join(edge, "ticker").filter(F.col("ts") < F.col("_edge")).groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("older"), F.min("ts").alias("range_start"), F.max("ts").alias("range_end"))
    )


def roll_up_lines(deltas: DataFrame, keep_latest: int, tie: str = "delta_id") -> DataFrame:
    """One line of text per delta to be rolled up."""
    newest = last_n(deltas, keep_latest, order=("ts", tie))
    edge = newest.groupBy("ticker").agg(
        F.min("ts").alias("_edge"), F.count(F.lit(1)).alias("_have")
    ).filter(F.col("_have") == keep_latest)
    older = deltas.join(edge, "ticker").filter(F.col("ts") < F.col("_edge"))
    return older.select("ticker", tie, roll_up_line().alias("line"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def roll_up_line() -> Column:
    who = F.array_join("who", ", ")
    return F.concat(
        F.lit("["), iso(F.col("ts")), F.lit("] "), who, F.lit(" :: "), F.coalesce("sum", F.lit("")),
        F.lit(" (dir="), F.coalesce("dir", F.lit("")), F.lit(", imp="), F.coalesce("impact", F.lit("")), F.lit(")"),
    )


def context_lines(records: DataFrame) -> DataFrame:
    """C20: the lines of an as-of memory, in order, under a line that names the cutoff."""
    line = F.concat(
        F.lit("("), F.col("kind"), F.lit(") ["), iso(F.col("at")), F.lit("] "), F.coalesce("body", F.lit(""))
    )
    lines = records.select("ticker", "as_of", "pos", line.alias("line"))
    cut = records.select("ticker", "as_of").distinct().select(
        "ticker", "as_of", F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit("AS_OF cutoff = "), iso(F.col("as_of"))).alias("line"),
    )
    return lines.unionByName(cut)


def running_gate(deltas: DataFrame, order: list[str], key: str = "ticker", ts: str = "ts", last: DataFrame | None = None) -> DataFrame:
    """T3 in batch: a delta is added only if it is newer than every earlier arrival of its ticker.

    Running maximum of the earlier arrivals, split by arrival buckets: inside a bucket by a window,
    across buckets by the bucket maxima.  ``order`` is the arrival order, its first column a
    timestamp.  ``last`` (key, last) is the newest time that arrived before all of these.
    """
    b = deltas.withColumn("_b", F.date_trunc("hour", F.col(order[0])))
    tops = b.groupBy(key, "_b").agg(F.max(ts).alias("_m"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(key, "_b", F.max("_m").over(before).alias("_c"))
    w = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.max(ts).over(w), F.col("_c"))
    if last is not None:
        carry = carry.join(last.select(key, F.col("last").alias("_l")), key, "left").withColumn("_c", F.greatest("_c", "_l")).drop("_l")
    return (
        b.join(carry, [key, "_b"]).withColumn("_seen", seen)
        .withColumn("action", F.when(F.col("_seen").isNull() | (F.col(ts) > F.col("_seen")), "ADD").otherwise("SKIP"))
        .drop("_b", "_c", "_seen")
    )
