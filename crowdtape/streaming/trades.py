"""C10 as a stream: the log of trades, each placed once and closed once.

A trade has two states, placed and closed. Its PLACED event is the earliest one; its CLOSE is the earliest
at or after that. Events may come late, twice, or the close before the placement: a trade's events wait
until the watermark has passed them, so the log is the same for every order of arrival within its delay.
What a closed trade still gets is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import streaming_state

LOG = "trade_id string, event_type string, at long, event_id long, payload string"


class TradeStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "closed boolean, placed_at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, is_close boolean, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        closed, placed_at = self.state.get() if self.state.exists() else (False, None)
        # a trade that is placed waits for a close only, one that is closed for nothing
        new = [] if closed else [(r.ms, r.event_id, r.is_close, r.payload) for r in rows if r.ms >= mark and (r.is_close or placed_at is None)]
        if new:
            self.waiting.appendList(list(dict.fromkeys(new)))
            for at in {x[0] for x in new}:
                self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.waiting.exists():
            return iter(())
        mark, out, later = timerValues.getCurrentWatermarkInMs(), [], []
        closed, placed_at = self.state.get() if self.state.exists() else (False, None)
        closes = []
        for at, event_id, is_close, payload in sorted(self.waiting.get(), key=lambda x: (x[0], x[2], x[1])):
            if at >= mark:
                later.append((at, event_id, is_close, payload))
            elif is_close:
                closes.append((at, event_id, payload))
            elif placed_at is None:
                placed_at = at
                out.append(Row(trade_id=key[0], event_type="PLACED", at=at, event_id=event_id, payload=payload))
        if placed_at is not None and not closed:
            for at, event_id, payload in closes:
                if at >= placed_at:
                    closed = True
                    out.append(Row(trade_id=key[0], event_type="CLOSE", at=at, event_id=event_id, payload=payload))
                    break
        # all that lies before the watermark is settled: without a placement, its closes came before it
        later = [] if closed else [x for x in later if x[2] or placed_at is None]
        self.waiting.put(later) if later else self.waiting.clear()
        if placed_at is not None:
            self.state.update((closed, placed_at))
        return iter(out)

    def close(self) -> None:
        pass


def trade_log(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of log rows from a stream of ``events`` (trade_id, event_type PLACED|CLOSE, at, event_id, payload)."""
    known = events.filter(F.col("event_type").isin("PLACED", "CLOSE") & F.col("trade_id").isNotNull() & F.col("at").isNotNull())
    rows = known.select("trade_id", "at", F.unix_millis("at").alias("ms"), "event_id", (F.col("event_type") == "CLOSE").alias("is_close"), "payload")
    out = rows.withWatermark("at", late).groupBy("trade_id").transformWithState(TradeStates(), LOG, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def run(events: DataFrame, checkpoint: str, out: str, **options) -> None:
    """Log what has arrived and stop; the next run with the same folders goes on."""
    with streaming_state(events.sparkSession):
        q = trade_log(events, **options).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        q.format("parquet").option("path", out).start().awaitTermination()
