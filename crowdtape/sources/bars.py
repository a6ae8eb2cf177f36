"""Bars: resampling ticks, the stored bars table, and what a run still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume"]


def bars_from_ticks(
    ticks: DataFrame, interval: str, *, symbol: Column, ts: Column, price: Column, volume: Column,
    order: list[Column],
) -> DataFrame:
    """OHLCV per (symbol, bar start).  ``order`` breaks ties inside a bar and must be total.

    Every aggregate is mergeable, so a hot symbol is reduced on the map side before the shuffle.  A
    single number as order keeps the aggregation a hash aggregation; a struct would make it sort.
    """
    key = order[0] if len(order) == 1 else F.struct(*order)
    return (
        ticks.select(
            symbol.alias("symbol"), ts.alias("ts"), price.alias("_p"), volume.alias("_v"),
            key.alias("_k"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"),
            F.min("_p").alias("low"), F.max_by("_p", "_k").alias("close"),
            F.sum("_v").alias("volume"),
        )
        .withColumn("interval", F.lit(interval))
        .select(*BAR_COLUMNS)
    )


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by interval and month, clustered by symbol inside each file."""
    (
        bars.withColumn("ingested_at", F.current_timestamp())
        .withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("interval", "month", F.pmod(F.hash("symbol"), F.lit(64)))
        .sortWithinPartitions("symbol", "ts")
        .write.mode(mode).partitionBy("interval", "month").parquet(path)
    )


#: Stated, because an interval such as "1d" in a folder name would be taken for a number.
STORED = ("symbol string, ts timestamp, open double, high double, low double, close double, volume double, "
          "ingested_at timestamp, interval string, month string")


def read_bars(
    spark: SparkSession, path: str, interval: str | None = None, *, start=None, end=None,
    max_age: str | None = None, compacted: bool = False,
) -> DataFrame:
    """Prune by interval and month; ``max_age`` (an interval literal) drops stale downloads.
    When a bar was stored more than once the newest download wins; a ``compacted`` table holds each bar
    once and is read without that grouping."""
    df = spark.read.schema(STORED).parquet(path)
    if interval:
        df = df.filter(F.col("interval") == interval)
    if start is not None:
        df = df.filter((F.col("ts") >= start) & (F.col("month") >= F.date_format(F.lit(start), "yyyy-MM")))
    if end is not None:
        df = df.filter((F.col("ts") <= end) & (F.col("month") <= F.date_format(F.lit(end), "yyyy-MM")))
    if max_age:
        df = df.filter(F.col("ingested_at") >= F.current_timestamp() - F.expr(f"INTERVAL {max_age}"))
    if compacted:
        return df.select(*BAR_COLUMNS)
    return _newest(df).select(*BAR_COLUMNS)


def _newest(df: DataFrame) -> DataFrame:
    rest = [c for c in BAR_COLUMNS if c not in ("symbol", "interval", "ts")]
    return (
        df.groupBy("symbol", "interval", "ts")
        .agg(F.max_by(F.struct(*rest), "ingested_at").alias("b"), F.max("ingested_at").alias("ingested_at"))
        .select("symbol", "interval", "ts", "b.*", "ingested_at")
    )


def compact_bars(spark: SparkSession, path: str, to: str) -> None:
    """The table with each bar once, the newest download, in ``write_bars``'s layout."""
    df = _newest(spark.read.schema(STORED).parquet(path)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    (
        df.repartition("interval", "month", F.pmod(F.hash("symbol"), F.lit(64)))
        .sortWithinPartitions("symbol", "ts")
        .write.partitionBy("interval", "month").parquet(to)
    )


def interval_for_timeframe(timeframe: Column) -> Column:
    """W30."""
    t = F.lower(timeframe)
    return (
        F.when(t == "intraday", "15m").when(t == "swing_days", "1h")
        .when(t == "swing_weeks", "4h").otherwise("1d")
    )


def is_intraday(interval: Column) -> Column:
    return interval.isin("4h", "1h", "30m", "15m", "5m")


def intraday_start(start: Column, end: Column, limit_days: int = 59) -> Column:
    """The look-back of intraday bars is limited to ``limit_days`` up to the end day."""
    return F.greatest(start, F.date_trunc("day", end) + F.make_dt_interval(F.lit(1 - limit_days)))


# fixed values: longest span (seconds) served by each bar interval, and how far back it reaches
AUTO_INTERVAL = [
    (3 * 3600, "1m"), (2 * 86400, "5m"), (14 * 86400, "15m"), (60 * 86400, "1h"),
    (2 * 365 * 86400, "1d"),
]
DEGRADE = ["1m", "5m", "15m", "1h", "1d", "1wk"]
MAX_AGE_DAYS = {"1m": 30, "5m": 60}


def auto_interval(span_seconds: Column) -> Column:
    """Bar interval by the length of a window."""
    out = F.lit("1wk")
    for limit, name in reversed(AUTO_INTERVAL):
        out = F.when(span_seconds <= limit, name).otherwise(out)
    return out


def degrade_interval(interval: Column, age_days: Column) -> Column:
    """Minute bars only reach back so far; older windows use the next coarser bars."""
    out = interval
    for name in DEGRADE:
        if name in MAX_AGE_DAYS:
            coarser = DEGRADE[DEGRADE.index(name) + 1]
            out = F.when((out == name) & (age_days > MAX_AGE_DAYS[name]), coarser).otherwise(out)
    return out


def crop_last(bars: DataFrame, minutes: int, now: Column) -> DataFrame:
    """The bars of the last ``minutes`` before ``now`` (inclusive)."""
    return bars.filter((F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def needed_series(verdicts: DataFrame, interval: str = "auto") -> DataFrame:
    """Distinct (ticker, interval) a set of verdict rows needs."""
    chosen = interval_for_timeframe(F.col("timeframe")) if interval == "auto" else F.lit(interval)
    return (
        verdicts.filter(F.trim("ticker") != "").filter(F.col("implied_direction").isNotNull())
        .select("ticker", chosen.alias("interval")).distinct()
    )


def missing_series(needed: DataFrame, bars: DataFrame) -> DataFrame:
    """Needed series without a single stored bar."""
    have = bars.select(F.col("symbol").alias("ticker"), "interval").distinct()
    return needed.join(have, ["ticker", "interval"], "left_anti")
