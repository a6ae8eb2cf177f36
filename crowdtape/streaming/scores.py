"""T6 as a stream: the decayed score of every ticker at the end of each hour it has deltas in.

State per ticker is one row of sums per hour, scaled to the hour's start, for as long as the window
reaches back. A timer per hour fires once the watermark has passed its end: it decays the hours inside
the window to that moment and emits the sums that ``sentiment.score`` turns into scores, the same
expressions as in batch. A second timer drops an hour when no window reaches it any more, so a ticker
that falls silent leaves nothing behind.

Deltas of one Arrow batch merge per (ticker, hour, channel) before the shuffle, so a ticker with a third
of all deltas sends rows by hours, not by deltas. A delta whose hour has been emitted is late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sentiment as S
from ..session import streaming_state

HOUR_MS = 3_600_000
_BY = ["ticker", "slot", "exact", "grp"]
_SUMS = ["w", "ws", "wa", "w2", "k"]
_HOURLY = "ticker string, slot long, exact boolean, grp int, w double, ws double, wa double, w2 double, k double, ts timestamp"
_GROUPS = S._GROUPS
_OUT = "ticker string, as_of long, burst double, " + ", ".join(f"{g}_{v} double" for g in _GROUPS for v in _SUMS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(_BY).aggregate([*[(v, "sum") for v in _SUMS], ("ts", "max")])
        yield from t.select([*_BY, *[f"{v}_sum" for v in _SUMS], "ts_max"]).rename_columns([*_BY, *_SUMS, "ts"]).combine_chunks().to_batches()


def hourly_sums(deltas: DataFrame) -> DataFrame:
    """Sums of the deltas of an Arrow batch per (ticker, hour, at its very start or later, channel group),
    scaled to the hour's start; ``ts`` is the newest of them."""
    d = S.own_deltas(deltas).filter(F.col("ts").isNotNull())
    chan, slot = F.coalesce("chan", F.lit("other")), F.date_trunc("hour", "ts")
    since = (F.unix_micros("ts") - F.unix_micros(slot)) / 86400e6
    i, s = S.impact_weight(F.col("impact")), S.direction_value(F.col("dir"))
    w = i * F.exp(S.DECAY * since)
    flat = d.select(
        "ticker", F.unix_millis(slot).alias("slot"), (F.col("ts") == slot).alias("exact"),
        F.when(chan == "social", 0).when(chan == "news", 1).otherwise(2).alias("grp"),
        w.alias("w"), (w * s).alias("ws"), (w * F.abs(s)).alias("wa"), (w * w).alias("w2"), F.lit(1.0).alias("k"), "ts")
    return flat.mapInArrow(_merged, _HOURLY)


class DecayedSums(StatefulProcessor):
    """Hourly sums per ticker; a timer one millisecond after an hour's end emits, one two milliseconds
    after the last window that needs an hour drops it."""

    def __init__(self, days: int, burst_hours: int):
        self.days, self.burst_hours = days, burst_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "slot long", "sums binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, new = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            if r.slot + HOUR_MS < passed:
                continue
            if r.slot not in new:
                there = self.hours.containsKey((r.slot,))
                new[r.slot] = np.frombuffer(self.hours.getValue((r.slot,))[0]).reshape(2, 3, 5).copy() if there else np.zeros((2, 3, 5))
                if not there:
                    self.handle.registerTimer(r.slot + HOUR_MS + 1)
                    self.handle.registerTimer(r.slot + (self.days * 24 + 1) * HOUR_MS + 2)
            new[r.slot][0 if r.exact else 1, r.grp] += (r.w, r.ws, r.wa, r.w2, r.k)
        for slot, sums in new.items():
            self.hours.updateValue((slot,), (sums.tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at % HOUR_MS == 2:
            slot = at - 2 - (self.days * 24 + 1) * HOUR_MS
            if self.hours.containsKey((slot,)):
                self.hours.removeKey((slot,))
            return iter(())
        as_of, total, burst = at - 1, np.zeros((3, 5)), 0.0
        for (slot,), (sums,) in self.hours.iterator():
            age = (as_of - slot) / HOUR_MS
            if not 0 <= age <= self.days * 24:
                continue
            one = np.frombuffer(sums).reshape(2, 3, 5)
            here = one[0] if age == 0 else one.sum(0)  # of the hour that begins now, only what is at its very start
            lost = np.exp(-S.DECAY * age / 24)
            total += here * (lost, lost, lost, lost * lost, 1.0)
            burst += here[0, 4] if age <= self.burst_hours else 0.0
        values = {f"{g}_{v}": float(total[a, b]) for a, g in enumerate(_GROUPS) for b, v in enumerate(_SUMS)}
        return iter([Row(ticker=key[0], as_of=as_of, burst=float(burst), **values)])

    def close(self) -> None:
        pass


def decayed_scores(deltas: DataFrame, days: int = 7, burst_hours: int = 6, late: str = "1 hour", channels=("all",)) -> DataFrame:
    """A stream of scores (ticker, as_of, channel, ...) from a stream of ``deltas`` (ticker, ts, who, dir,
    impact, chan), each final: its hour has ended ``late`` before the newest delta."""
    hourly = hourly_sums(deltas).withWatermark("ts", late)
    sums = hourly.groupBy("ticker").transformWithState(DecayedSums(days, burst_hours), _OUT, "Append", "EventTime")
    return S.score(sums.withColumn("as_of", F.timestamp_millis("as_of")), channels)


def run(deltas: DataFrame, checkpoint: str, out: str, **options) -> None:
    """Score all that has arrived and stop; the next run with the same folders goes on from there."""
    with streaming_state(deltas.sparkSession):
        q = decayed_scores(deltas, **options).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        q.format("parquet").option("path", out).start().awaitTermination()
