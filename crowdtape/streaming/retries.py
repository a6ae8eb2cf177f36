"""T5 as a stream: attempts that fail are tried again after a growing pause, the third failure is final.

State per post counts its failures since the last success. A failure below the limit sets a timer; when it
is due and nothing newer has happened, the post is handed out again. A success forgets the count. The
failure that reaches the limit is a dead letter, and the post may start anew. Outcomes of one post are
taken in the order of their times, whatever batch or order they arrive in, as long as the watermark has not
passed them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import streaming_state
from .ingest import keep_newest

FATES = "post_id string, fate string, attempts int, at long, reason string"


class Retries(StatefulProcessor):
    """State: failures so far, when the next try is due (0: none), the last reason. Outcomes that the
    watermark may still see overtaken wait in a list of at most the outcomes within its delay."""

    def __init__(self, limit: int, pause_ms: int):
        self.limit, self.pause_ms = limit, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "attempts int, due long, reason string")
        self.waiting = handle.getListState("waiting", "at long, ok boolean, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(r.ms, r.ok, r.reason) for r in rows if r.ms >= mark]
        if new:
            # a timer settles all that the watermark has passed, so the first of them is enough
            self.handle.registerTimer(min(at for at, _, _ in new) + 1)
            self.waiting.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What lies before the watermark is settled in order: outcomes, and pauses that have ended. (A timer
        set here for a moment that has passed would wait for the next batch.)"""
        until, out = timerValues.getCurrentWatermarkInMs(), []
        attempts, due, reason = self.count.get() if self.count.exists() else (0, 0, None)
        here, later = [], []
        for at, ok, why in self.waiting.get() if self.waiting.exists() else ():
            (here if at < until else later).append((at, ok, why))

        def fate(kind: str, at: int) -> None:
            out.append(Row(post_id=key[0], fate=kind, attempts=attempts, at=at, reason=reason))

        for at, ok, why in sorted(here, key=lambda x: (x[0], x[1], x[2] or "")):
            if due and due <= at:
                fate("retry", due)
                due = 0
            if ok:
                attempts, due, reason = 0, 0, None
                continue
            attempts, reason = attempts + 1, why
            due = at + self.pause_ms * 2 ** (attempts - 1)
            if attempts >= self.limit:
                fate("dead", at)
                attempts, due, reason = 0, 0, None
        if due and due < until:
            fate("retry", due)
            due = 0
        elif due:
            self.handle.registerTimer(due + 1)
        if here:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(at for at, _, _ in later) + 1)
        if attempts:
            self.count.update((attempts, due, reason))
        elif self.count.exists():
            self.count.clear()
        return iter(out)

    def close(self) -> None:
        pass


def fates(outcomes: DataFrame, limit: int = 3, pause: timedelta = timedelta(hours=1), late: str = "1 hour") -> DataFrame:
    """A stream of (post_id, fate retry|dead, attempts, at, reason) from a stream of outcomes
    (post_id, at, ok, reason). ``at`` is when a retry is due or the last attempt failed."""
    known = outcomes.filter(F.col("post_id").isNotNull() & F.col("at").isNotNull()).select("post_id", "at", F.unix_millis("at").alias("ms"), F.coalesce("ok", F.lit(False)).alias("ok"), "reason")
    processor = Retries(limit, int(pause.total_seconds() * 1000))
    out = known.withWatermark("at", late).groupBy("post_id").transformWithState(processor, FATES, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def to_queue_and_dead_letters(queue: str, dead: str) -> Callable:
    """A batch function: what to try again goes to one folder, what is given up to the other. A replayed
    batch replaces what it wrote."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            rows.filter("fate = 'retry'").write.mode("overwrite").parquet(f"{queue}/batch={batch_id}")
            rows.filter("fate = 'dead'").write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        finally:
            rows.unpersist()

    return each


def run(outcomes: DataFrame, checkpoint: str, queue: str, dead: str, **options) -> None:
    """Settle what has arrived and stop; the next run with the same folders goes on."""
    with streaming_state(outcomes.sparkSession):
        q = fates(outcomes, **options).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        q.foreachBatch(to_queue_and_dead_letters(queue, dead)).start().awaitTermination()


def skip_list(letters: DataFrame, newest: int = 200) -> DataFrame:
    """The dead letters that are kept: the newest."""
    return keep_newest(letters.withColumnRenamed("at", "failed_at"), newest)
