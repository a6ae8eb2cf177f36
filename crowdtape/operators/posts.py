"""Queries over posts, their stage payloads and their interest scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

# fixed values: stages that survive a reset, and stages that count as analysis in listings
PRESERVED_STAGES = ["summariser", "conversation_hub"]
ANALYSIS_STAGES = [
    "direction", "moderator", "researcher", "technical_research", "sentiment_research",
    "conversation_hub", "chairman",
]


def event_time() -> Column:
    """The post's own time, else the time it was collected."""
    return F.coalesce("posted_at", "scraped_at")


def listing_time() -> Column:
    """P2, listing order: collection time first."""
    return F.coalesce("scraped_at", "posted_at")


def preview(text: Column, n: int = 400) -> Column:
    """P4."""
    return F.substring(F.translate(text, "\n\r", "  "), 1, n)


def search(
    posts: DataFrame, *, text: str | None = None, platform: str | None = None,
    source: str | None = None, since=None, until=None,
) -> DataFrame:
    """Either timestamp may satisfy the date bounds; text search ignores ASCII case and takes
    ``%``/``_`` in the query as patterns."""
    df = posts
    if platform is not None:
        df = df.filter(F.col("platform") == platform)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if since is not None:
        df = df.filter((F.col("posted_at") >= since) | (F.col("scraped_at") >= since))
    if until is not None:
        df = df.filter((F.col("posted_at") < until) | (F.col("scraped_at") < until))
    if text:
        df = df.filter(F.col("title").ilike(f"%{text}%") | F.col("text").ilike(f"%{text}%"))
    return df


def interesting(posts: DataFrame, interest: DataFrame, minimum: float) -> DataFrame:
    """J4."""
    ok = interest.filter(
        (F.lower(F.coalesce("status", F.lit(""))) == "ok") & (F.col("interest_score") >= minimum)
    )
    return posts.join(ok.select("post_id"), "post_id", "left_semi")


def latest_payload(stages: DataFrame) -> DataFrame:
    """Newest payload per (post, stage).  ``max_by`` merges on the map side; no sort."""
    newest = F.struct("created_at", "payload")
    return stages.groupBy("post_id", "stage").agg(
        F.max("created_at").alias("created_at"), F.max_by("payload", newest).alias("payload")
    )


def latest_stage_columns(stages: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per post with the newest payload of each named stage as a column: replaces one
    lookup per post and stage."""
    newest = F.struct("created_at", "payload")
    aggs = [
        F.max_by(
            F.when(F.col("stage") == n, F.col("payload")),
            F.when(F.col("stage") == n, newest),
        ).alias(n)
        for n in names
    ]
    return stages.filter(F.col("stage").isin(list(names))).groupBy("post_id").agg(*aggs)


def stage_flags(stages: DataFrame) -> DataFrame:
    """One aggregate instead of one EXISTS per flag."""
    def has(names):
        return F.coalesce(F.max(F.col("stage").isin(names)), F.lit(False))

    return stages.groupBy("post_id").agg(
        has(["summariser"]).alias("has_summary"),
        has(ANALYSIS_STAGES).alias("has_analysis"),
        has(["chairman"]).alias("has_verdict"),
    )


def with_flags(posts: DataFrame, stages: DataFrame) -> DataFrame:
    df = posts.join(stage_flags(stages), "post_id", "left")
    return df.fillna(False, ["has_summary", "has_analysis", "has_verdict"])


def without_stage(posts: DataFrame, stages: DataFrame, stage: str) -> DataFrame:
    """J5."""
    done = stages.filter(F.col("stage") == stage).select("post_id").distinct()
    return posts.join(done, "post_id", "left_anti")


def calendar(posts: DataFrame, stages: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """A1: posts and analysed posts per day, optionally of one month, on real timestamps."""
    df = posts.withColumn("_at", event_time())
    if year is not None and month is not None:
        first = F.make_date(F.lit(year), F.lit(month), F.lit(1)).cast("timestamp")
        df = df.filter((F.col("_at") >= first) & (F.col("_at") < F.add_months(first, 1).cast("timestamp")))
    df = with_flags(df.select("post_id", "_at"), stages)
    return (
        df.filter(F.col("_at").isNotNull()).groupBy(F.to_date("_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("posts"), F.count_if("has_verdict").alias("analysed"))
    )


def count_since(posts: DataFrame, now: Column, hours: int, day: Column) -> DataFrame:
    """A2: posts of one day and of the last ``hours``, in one pass."""
    at = F.col("scraped_at")
    return posts.agg(
        F.count_if(F.to_date(at) == day).alias("on_day"),
        F.count_if(at >= now - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("last_hours"),
    )


def top_platforms(posts: DataFrame, now: Column, hours: int, limit: int) -> DataFrame:
    """A3."""
    recent = posts.filter(F.col("scraped_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return (
        recent.groupBy("platform").agg(F.count(F.lit(1)).alias("posts"))
        .orderBy(F.desc("posts"), "platform").limit(limit)
    )


def store_stats(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """A4 and A5: first, last, rows and distinct keys.

    Keys are counted as rows of a grouped table: the grouping is partial on the map side, unlike a
    distinct count that would collect a hot platform's ids in one place.
    """
    totals = posts.agg(
        F.min("scraped_at").alias("first_at"), F.max("scraped_at").alias("last_at"),
        F.count(F.lit(1)).alias("posts"),
    )
    if approximate:
        keys = posts.agg(F.approx_count_distinct(F.struct("platform", "post_id")).alias("keys"))
    else:
        keys = posts.groupBy("platform", "post_id").agg(F.lit(1).alias("_1")).agg(
            F.count(F.lit(1)).alias("keys")
        )
    return totals.join(F.broadcast(keys))  # one row each


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """L1: one page of a listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def next_after(posts: DataFrame, after_ts=None, after_id: str | None = None, limit: int = 500) -> DataFrame:
    """L2: the rows that follow a cursor in (collection time, id) order; ties with the cursor row
    are kept.  ``limit`` is the page's size, as asked."""
    df = posts
    if after_ts is not None:
        at = F.col("scraped_at")
        df = df.filter((at > after_ts) | ((at == after_ts) & (F.col("post_id") > (after_id or ""))))
    return df.orderBy("scraped_at", "post_id").limit(int(limit))


def recent(posts: DataFrame, n: int = 10) -> DataFrame:
    """L3."""
    return posts.orderBy(F.desc("scraped_at"), F.desc("post_id")).limit(n)


def pick_latest(posts: DataFrame) -> DataFrame:
    """The newest post, by an aggregate instead of a sort."""
    key = F.struct("scraped_at", "post_id")
    return posts.agg(F.max_by(F.struct(*posts.columns), key).alias("p")).select("p.*")


def pick_random(posts: DataFrame, seed: int) -> DataFrame:
    """A reproducible random post: smallest seeded hash of the id."""
    key = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("post_id"))), F.col("post_id"))
    return posts.agg(F.min_by(F.struct(*posts.columns), key).alias("p")).select("p.*")


def verdict_queue(
    posts: DataFrame, stages: DataFrame, interest: DataFrame, minimum: float, repair: bool = False,
) -> DataFrame:
    """What is to be analysed.  ``mode`` is interest, repair, has_verdict or
    below_threshold; the first two are the queue, in (repairs first, time, id) order."""
    verdicts = stages.filter(F.col("stage") == "chairman").select("post_id").distinct()
    df = (
        posts.withColumn("article_time", event_time())
        .join(interest.select("post_id", "interest_score", "status"), "post_id", "left")
        .join(verdicts.withColumn("_v", F.lit(True)), "post_id", "left")
    )
    scored = F.col("interest_score").isNotNull() & (F.lower(F.coalesce("status", F.lit(""))) == "ok")
    score, has = F.coalesce("interest_score", F.lit(0.0)), F.coalesce("_v", F.lit(False))
    ready = scored & (score >= minimum)
    mode = F.when(ready & has, "has_verdict")
    if repair:
        mode = mode.when(~has & (score >= minimum), "repair").when(~has, "below_threshold")
    else:
        mode = mode.when(ready, "interest")
    return (
        df.withColumn("mode", mode).filter(F.col("mode").isNotNull())
        .select("post_id", "title", score.alias("interest_score"), "article_time", "mode")
    )


def queue_order() -> list[Column]:
    return [
        F.when(F.col("mode") == "repair", 0).otherwise(1), F.col("article_time").asc_nulls_first(),
        F.desc("interest_score"), F.col("post_id"),
    ]


def queue_counts(queue: DataFrame) -> DataFrame:
    """A25."""
    m = F.col("mode")
    return queue.agg(
        F.count_if(m.isin("interest", "repair")).alias("total"),
        F.count_if(m == "has_verdict").alias("skipped_with_verdict"),
        F.count_if(m == "below_threshold").alias("skipped_below_threshold"),
        F.count_if(m == "repair").alias("repairs"),
    )


def in_given_order(df: DataFrame, order: DataFrame, key: str = "post_id") -> DataFrame:
    """Order by a caller's (key, ordinal) table, and keep only its keys."""
    return df.join(order.select(key, "ordinal"), key).orderBy("ordinal")


def interest_backfill(posts: DataFrame, stages: DataFrame, interest: DataFrame) -> DataFrame:
    """Summarised posts whose score is missing, failed or lacked prices.  The disjunction is a
    filter after the join, so the join stays an equality join."""
    done = stages.filter(F.col("stage") == "summariser").select("post_id").distinct()
    ci = interest.select("post_id", "status", "error_code").withColumn("_ci", F.lit(True))
    df = posts.join(done, "post_id", "left_semi").join(ci, "post_id", "left")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return df.filter(
        F.col("_ci").isNull() | (low("status") != "ok") | (low("error_code") == "price_data_unavailable")
    ).select("post_id", "title", listing_time().alias("at"))


def _with_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is complete: a missing or blank id or address matches nothing."""
    for c in key:
        df = df.filter(F.trim(F.col(c).cast("string")) != "")
    return df


def dedup_against_log(
    batch: DataFrame, log: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str],
) -> DataFrame:
    """Rows of ``batch`` that share none of ``keys`` with the log nor with an accepted earlier
    row of the batch (missing or blank parts never match).

    The outcome equals taking the rows one after the other.  One anti join per key against the log, then
    rounds.  In a round a row that is first in all its keys is accepted.  A row with exactly one earlier
    rival is accepted if and only if that rival is not, so chains of such rows are settled together by
    pointer doubling, in as many steps as the logarithm of the longest chain.  Only rows with several
    earlier rivals wait for the next round.
    """
    open_rows = batch
    for key in keys:
        open_rows = open_rows.join(_with_key(log, key).select(*key).distinct(), list(key), "left_anti")
    open_rows = cut_lineage(open_rows.select(*batch.columns).withColumn("_id", F.monotonically_increasing_id()))
    accepted = []
    while not open_rows.isEmpty():
        state = _settled(cut_lineage(_rivals(open_rows, keys, order)))
        judged = cut_lineage(open_rows.join(state, "_id"))
        won = judged.filter("state = 'in'").select(*batch.columns)
        accepted.append(won)
        open_rows = judged.filter("state = 'wait'").drop("state")
        for key in keys:
            open_rows = open_rows.join(_with_key(won, key).select(*key).distinct(), list(key), "left_anti")
        open_rows = cut_lineage(open_rows.select(*batch.columns, "_id"))
    return reduce(DataFrame.unionByName, accepted) if accepted else batch.limit(0)


def _rivals(rows: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str]) -> DataFrame:
    """(_id, state, rival): ``in`` for rows that are first in all their keys, the only earlier rival of
    rows that are second in some keys and first in the others, ``wait`` for all else."""
    ranked = rows.withColumn("_rank", F.struct(*order, "_id"))
    marked = ranked
    places, before = [], []
    for i, key in enumerate(keys):
        mine = _with_key(ranked, key).select(*key, "_rank")
        first = mine.groupBy(*key).agg(F.min("_rank").alias(f"_f{i}"))
        second = mine.join(first, list(key)).filter(F.col("_rank") > F.col(f"_f{i}")).groupBy(*key).agg(F.min("_rank").alias(f"_s{i}"))
        marked = marked.join(first, list(key), "left").join(second, list(key), "left")
        f, s, r = F.col(f"_f{i}"), F.col(f"_s{i}"), F.col("_rank")
        places.append(F.when(f.isNull() | (r == f), 0).when(r == s, 1).otherwise(2))
        before.append(F.when(f.isNotNull() & (r == s), f["_id"]))
    last = F.greatest(*places) if len(places) > 1 else places[0]
    rivals = F.array_distinct(F.array_compact(F.array(*before)))
    one = (last == 1) & (F.size(rivals) == 1)
    return marked.select(
        "_id", F.when(last == 0, "in").when(~one, "wait").alias("state"), F.when(one, F.element_at(rivals, 1)).alias("rival"))


def _settled(rows: DataFrame) -> DataFrame:
    """(_id, state): follows rivals to the head of their chain, doubling the stride each step."""
    hops = rows.withColumn("odd", F.lit(True))
    while not hops.filter("state IS NULL").isEmpty():
        ahead = hops.select(F.col("_id").alias("rival"), F.col("state").alias("_s"), F.col("rival").alias("_r"), F.col("odd").alias("_o"))
        met = hops.join(ahead, "rival", "left")
        settled = F.when(F.col("_s") == "wait", "wait").when(F.col("_s").isNotNull(), F.when((F.col("_s") == "in") != F.col("odd"), "in").otherwise("out"))
        hops = cut_lineage(met.select(
            "_id", F.coalesce("state", settled).alias("state"), F.coalesce("_r", "rival").alias("rival"),
            F.when(F.col("_r").isNotNull(), F.col("odd") != F.col("_o")).otherwise(F.col("odd")).alias("odd")))
    return hops.select("_id", "state")


def sync_backlog(local: DataFrame, remote: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """Local rows after the newest one already known remotely, minus any known anyway."""
    known = remote.select(*key).distinct()
    edge = local.join(known, list(key), "left_semi").agg(F.max(ordinal).alias("_edge"))
    after = local.join(F.broadcast(edge)).filter(
        F.col("_edge").isNull() | (F.col(ordinal) > F.col("_edge"))
    )
    return after.join(known, list(key), "left_anti").drop("_edge")


def backlog_order() -> list[Column]:
    """Oldest first, unparsable times last."""
    return [F.col("scraped_at").asc_nulls_last(), F.col("post_id")]


def warm_up(posts: DataFrame, cutoff: Column, summarised: DataFrame, failed: DataFrame) -> DataFrame:
    """Posts up to a cutoff that were neither summarised nor given up."""
    df = posts.filter(F.col("scraped_at") <= cutoff)
    for seen in (summarised, failed):
        df = df.join(seen.select("post_id").distinct(), "post_id", "left_anti")
    return df


def snapshot_new_ids(snapshot: DataFrame, *known: DataFrame) -> DataFrame:
    """Distinct ids of a snapshot minus every known set."""
    ids = snapshot.select(F.trim("post_id").alias("post_id")).filter("post_id <> ''").distinct()
    for other in known:
        ids = ids.join(other.select("post_id").distinct(), "post_id", "left_anti")
    return ids


def batch_targets(ids: DataFrame, limit: int | None = 200) -> DataFrame:
    """First ``limit`` distinct ids in their given order (None: all); the cap is the feature."""
    out = ids.groupBy("post_id").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal")
    return out if limit is None else out.limit(limit)


def stage_catalog(stages: DataFrame) -> DataFrame:
    """Posts per stage, from distinct (post, stage)."""
    return stages.select("post_id", "stage").distinct().groupBy("stage").agg(
        F.count(F.lit(1)).alias("posts")
    )


def ingest_counts(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows offered, accepted and refused as duplicates in one batch."""
    n = batch.agg(F.count(F.lit(1)).alias("offered"))
    a = accepted.agg(F.count(F.lit(1)).alias("accepted"))
    return n.join(F.broadcast(a)).withColumn("duplicates", F.col("offered") - F.col("accepted"))


def filter_audit(df: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows from one condition (null counts as kept)."""
    gone = F.coalesce(drop, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def drop_rss(domains: Sequence[str], sources: Sequence[str]) -> Column:
    """P10."""
    listed = F.col("domain").isin(list(domains)) | F.col("source").isin(list(sources))
    return (F.lower("platform") == "rss") & listed


def only_missing() -> Column:
    """P11."""
    return F.lower(F.trim(F.coalesce("fetch_status", F.lit("")))) != "ok"


def merge_refetched(posts: DataFrame, fetched: DataFrame) -> DataFrame:
    """H-X7: take refetched text when there is some, a title only where none was, the final address
    always; ``*_changed`` flags feed A17."""
    f = fetched.select(
        "url", *[F.col(c).alias(f"_n_{c}") for c in ("text", "title", "final_url", "fetch_status")],
        F.lit(True).alias("_hit"),
    )
    df = posts.join(f, "url", "left")
    has_text = F.length(F.trim(F.coalesce("_n_text", F.lit("")))) > 0
    new_text = F.coalesce(F.col("_hit") & has_text & ~F.col("_n_text").eqNullSafe(F.col("text")), F.lit(False))
    new_title = F.coalesce(
        F.col("_hit") & (F.trim(F.coalesce("title", F.lit(""))) == "") & (F.coalesce("_n_title", F.lit("")) != ""),
        F.lit(False),
    )
    new_final = F.coalesce(F.col("_hit") & ~F.col("_n_final_url").eqNullSafe(F.col("final_url")), F.lit(False))
    return df.withColumns(
        {
            "text_changed": new_text, "title_changed": new_title, "final_url_changed": new_final,
            "text": F.when(new_text, F.col("_n_text")).otherwise(F.col("text")),
            "title": F.when(new_title, F.col("_n_title")).otherwise(F.col("title")),
            "final_url": F.when(F.col("_hit"), F.col("_n_final_url")).otherwise(F.col("final_url")),
            "fetch_status": F.when(F.col("_hit"), F.col("_n_fetch_status")).otherwise(F.col("fetch_status")),
        }
    ).drop("_hit", "_n_text", "_n_title", "_n_final_url", "_n_fetch_status")


def refetch_report(merged: DataFrame) -> DataFrame:
    """A17."""
    return merged.groupBy("fetch_status").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(f"{c}_changed").alias(f"{c}_updates") for c in ("text", "title", "final_url")],
    )


def related_window(
    posts: DataFrame, refs: DataFrame, *, before_days: int, after_days: int = 0,
) -> DataFrame:
    """Posts in a time range around each reference row, the row itself excluded.  Time slots of
    a day turn the range into an equality join."""
    from .asof import interval_join

    r = refs.select(
        F.col("post_id").alias("ref_id"),
        (F.col("scraped_at") - F.make_dt_interval(F.lit(before_days))).alias("_lo"),
        (F.col("scraped_at") + F.make_dt_interval(F.lit(after_days))).alias("_hi"),
    )
    out = interval_join(r, posts, [], lo="_lo", hi="_hi", ts="scraped_at")
    return out.filter(F.col("post_id") != F.col("ref_id")).drop("_lo", "_hi")
