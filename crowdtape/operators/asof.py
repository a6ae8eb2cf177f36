"""As-of and interval joins on an equality key and time.

Both split a key's timeline into buckets, so that no key is handled by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .scan import running

#: About what one task sorts when buckets are a number of rows: its memory does not grow with the input.
TASK_ROWS = 500_000


def depth_buckets(frames: Sequence[DataFrame], on: Sequence[str], depth: int, grid: str = "minute") -> DataFrame:
    """(key, _g, _b, _n): buckets of about ``depth`` rows over the timeline of every key, however its rows lie.

    ``frames`` have the key and ``_t``. Rows are counted per (key, grid cell), a mergeable histogram; a
    cell's bucket is its key's running count over the depth. Running counts go month by month plus what the
    months before add up to, so no task sees a whole key, and what months add up to is few rows.
    """
    cells = frames[0].select(*on, F.date_trunc(grid, "_t").alias("_g"))
    for f in frames[1:]:
        cells = cells.unionByName(f.select(*on, F.date_trunc(grid, "_t").alias("_g")))
    cells = stored(cells.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_n")), "histogram")
    months = _dealt(cells.withColumn("_month", F.date_trunc("month", "_g")), cells.count(), *on, "_month")
    placed = running(months, on, F.col("_month"), ["_g"], {"_sum": ("sum", F.col("_n"))})
    return placed.select(*on, "_g", F.floor((F.col("_sum") - F.col("_n")) / depth).alias("_b"), "_n")


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over so many tasks that each gets ``TASK_ROWS`` of the ``rows`` or fewer. Spark merges
    shuffle partitions down to the number of cores, and a task would sort what the input leaves to each."""
    spark, tasks = df.sparkSession, -(-rows // TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    columns: Sequence[str] | None = None,
    direction: str = "backward",
    strict: bool = False,
    tolerance: Column | None = None,
    bucket: str | int = "month",
    name: str = "asof",
) -> DataFrame:
    """Attach to each left row the nearest right row at or before (``backward``) or at or
    after (``forward``) its time, as a struct column ``name``; ``strict`` excludes equal times.

    Distinct (key, time) probes and the right rows are unioned and swept once per (key, bucket).
    What a bucket inherits from its neighbours is one row per bucket, reduced on the map side.
    ``tolerance`` (an interval Column) voids matches farther away than it.  Right rows must be
    unique per (key, time).  ``bucket`` is a unit of time, or a number of rows: then the buckets of a key
    hold about that many of its rows and probes (``depth_buckets``), which suits keys with a large share of
    all rows and uneven times.
    """
    on = list(on)
    back = direction == "backward"
    cols = list(columns or [c for c in right.columns if c not in on])
    if right_ts not in cols:
        cols = [right_ts, *cols]

    rows = right.select(
        *on, F.col(right_ts).alias("_t"), F.struct(*cols).alias("_v"),
    )
    probes = left.select(*on, F.col(left_ts).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    if isinstance(bucket, int):
        rows = rows.filter(F.col("_t").isNotNull())
        # met by rows and by probes; merged, as compressed files say little about the size in memory
        cells = stored(depth_buckets([rows, probes], on, bucket), "buckets")
        size = cells.agg(F.sum("_n")).first()[0] or 0
        cells = cells.drop("_n").hint("merge")
        rows, probes = (
            _dealt(df.withColumn("_g", F.date_trunc("minute", "_t")), size, *on, "_g").join(cells, [*on, "_g"]).drop("_g") for df in (rows, probes)
        )
    else:
        rows, probes = (df.withColumn("_b", F.date_trunc(bucket, F.col("_t"))) for df in (rows, probes))
    pick = F.max_by if back else F.min_by
    edge = rows.groupBy(*on, "_b").agg(pick("_v", "_t").alias("_edge"))
    asked = probes.select(*on, "_b").distinct().withColumn("_asked", F.lit(True))
    marks = (
        edge.withColumn("_asked", F.lit(None).cast("boolean"))
        .unionByName(asked, allowMissingColumns=True)
        .groupBy(*on, "_b")
        .agg(F.first("_edge", ignorenulls=True).alias("_edge"), F.max("_asked").alias("_asked"))
    )
    along = W.partitionBy(*on).orderBy(F.col("_b") if back else F.col("_b").desc())
    inherited = F.last("_edge", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    seeds = (
        marks.withColumn("_v", inherited).filter("_asked")
        .select(*on, "_b", "_v", F.lit(None).cast("timestamp").alias("_t"), F.lit(0).alias("_kind"))
    )
    rank_right, rank_probe = (2, 1) if strict else (1, 2)
    swept = (
        rows.withColumn("_kind", F.lit(rank_right))
        .unionByName(probes.withColumn("_kind", F.lit(rank_probe)), allowMissingColumns=True)
        .unionByName(seeds)
    )
    if isinstance(bucket, int):
        swept, left = _dealt(swept, size, *on, "_b"), _dealt(left, size, *on, left_ts)
    t = F.col("_t").asc_nulls_first() if back else F.col("_t").desc_nulls_first()
    w = W.partitionBy(*on, "_b").orderBy(t, "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = (
        swept.withColumn(name, F.last("_v", ignorenulls=True).over(w))
        .filter(F.col("_kind") == rank_probe)
        .select(*on, F.col("_t").alias(left_ts), name)
    )
    if tolerance is not None:
        near = (
            F.col(f"{name}.{right_ts}") >= F.col(left_ts) - tolerance if back
            else F.col(f"{name}.{right_ts}") <= F.col(left_ts) + tolerance
        )
        found = found.withColumn(name, F.when(near, F.col(name)))
    return left.join(found, [*on, left_ts], "left")


def interval_join(
    requests: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    *,
    lo: str,
    hi: str,
    ts: str = "ts",
    bucket_seconds: int = 86400,
    how: str = "inner",
) -> DataFrame:
    """Rows with ``lo <= ts <= hi`` of the same key, joined on (key, time bucket).

    The bucket makes it an equality join that AQE can split when a bucket is hot; a range condition
    alone would be a Cartesian product.
    """
    def slot(c):
        return F.floor(F.unix_seconds(c) / bucket_seconds)

    spread = requests.withColumn("_slot", F.explode(F.sequence(slot(F.col(lo)), slot(F.col(hi)))))
    placed = rows.withColumn("_slot", slot(F.col(ts)))
    joined = spread.join(placed, [*on, "_slot"], how)
    return joined.filter(F.col(ts).between(F.col(lo), F.col(hi))).drop("_slot")


def price_window(
    requests: DataFrame, bars: DataFrame, *, center: str = "ts", before: Column, after: Column,
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Every bar around a moment, with its distance from the centre and its return relative to
    the last bar at or before the centre inside the window.  ``before``/``after`` are intervals."""
    req = requests.withColumns({"_lo": F.col(center) - before, "_hi": F.col(center) + after})
    req = asof_join(
        req.withColumnRenamed(center, "center"), bars.select("symbol", "ts", "close"), ["symbol"],
        left_ts="center", right_ts="ts", tolerance=before, name="_t0",
    )
    out = interval_join(
        req, bars.drop("interval"), ["symbol"], lo="_lo", hi="_hi", ts="ts",
        bucket_seconds=bucket_seconds,
    )
    t0 = F.col("_t0.close")
    return out.withColumns(
        {
            "seconds_from_center": (
                (F.unix_micros("ts") - F.unix_micros("center")) / 1e6
            ),
            "t0_ts": F.col("_t0.ts"), "t0_close": t0,
            "return_from_t0": F.try_divide(F.col("close"), F.nullif(t0, F.lit(0.0))) - 1.0,
        }
    ).drop("_lo", "_hi", "_t0")
