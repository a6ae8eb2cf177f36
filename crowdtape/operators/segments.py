"""Split long ordered series into bounded groups without losing exactness.

A window ``partitionBy(symbol)`` puts a whole symbol on one task, so a symbol that holds a third of
the rows would stall the job.  Instead every series is cut into segments of about ``target_rows``
rows, and each segment also receives the last ``halo`` rows before it.  Trailing frames of up to
``halo`` rows are then computed inside (key, segment) groups exactly as over the whole series.

The cut points come from a count per (key, time bucket): a partial aggregate, far smaller than the
series, that AQE broadcasts when it is small and shuffles when it is not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEG, OWN, ORD, BLK = "_seg", "_own", "_ord", "_blk"
EMA_BLOCK = 1024
SERIES_HALO = 4 * EMA_BLOCK


def segment_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    *,
    halo: int = SERIES_HALO,
    target_rows: int = 65536,
    bucket: str = "month",
    block: int = EMA_BLOCK,
) -> DataFrame:
    """Add ``_seg`` (group), ``_own`` (false on halo copies), ``_ord`` (0-based position in the
    whole series) and ``_blk`` (fixed-length block of positions).

    ``bucket`` is a ``date_trunc`` unit fine enough that one key has a bounded number of rows in it.
    Rows must be unique per (keys, ts).  Filter on ``_own`` after computing the frames.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bkt", F.date_trunc(bucket, F.col(ts)))
    counts = bucketed.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    total = F.sum("_n").over(W.partitionBy(*keys))
    cuts = (
        counts.withColumn("_start", start)
        .withColumn("_total", total)
        .withColumn("_home", F.floor(F.col("_start") / target_rows))
        .withColumn(
            "_reach",
            F.greatest(
                F.col("_home"),
                F.floor(
                    (F.least(F.col("_start") + F.col("_n") + halo, F.col("_total")) - 1)
                    / target_rows
                ),
            ),
        )
        .select(
            *keys, "_bkt", "_start", "_home",
            F.explode(F.sequence("_home", "_reach")).alias(SEG),
        )
    )
    joined = bucketed.join(cuts, [*keys, "_bkt"])
    in_seg = W.partitionBy(*keys, SEG).orderBy(ts)
    return (
        joined.withColumn(OWN, F.col(SEG) == F.col("_home"))
        .withColumn(
            ORD,
            F.first("_start").over(in_seg.rowsBetween(W.unboundedPreceding, 0))
            + F.row_number().over(in_seg) - 1,
        )
        .withColumn(BLK, F.floor(F.col(ORD) / block))
        .drop("_bkt", "_start", "_home")
    )


def seg_window(keys: Sequence[str]):
    """Window over one segment in series order.  ``_blk`` leads the order (it is monotone in
    ``_ord``) so that block windows below reuse the same sort."""
    return W.partitionBy(*keys, SEG).orderBy(BLK, ORD)


def block_window(keys: Sequence[str]):
    return W.partitionBy(*keys, SEG, BLK).orderBy(ORD)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop halo copies and helper columns."""
    return df.filter(F.col(OWN)).drop(SEG, OWN, ORD, BLK)


def tail_rows(df: DataFrame, keys: Sequence[str], n: int, ts: str = "ts") -> DataFrame:
    """Last ``n`` rows of each key, with ``_rn`` = 1 for the newest.

    ``row_number <= n`` is planned with a per-partition group limit before the shuffle, so a hot key
    ships at most ``n`` rows per map task.
    """
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def check_block(alphas: Sequence[float], block: int = EMA_BLOCK) -> None:
    """A block must be long enough to forget what precedes its predecessor, yet short enough for
    the scaled sums to stay in double range."""
    for a in alphas:
        k = -math.log1p(-a) * block
        if not 38.0 <= k <= 650.0:
            raise ValueError(f"smoothing factor {a} does not fit a block of {block} rows")


def ewm_columns(
    df: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[Column, float, int]],
    block: int = EMA_BLOCK,
) -> DataFrame:
    """Exponential moving averages ``e_i = a*x_i + (1-a)*e_{i-1}`` as plain window sums.

    ``specs`` maps an output name to (value, smoothing factor, first position); the first position
    seeds the average.  Inside a block the recursion is a running sum of ``x_j * (1-a)^-p_j`` scaled
    back by ``(1-a)^p_i``; the previous block enters through its last value.  Anything older has
    weight below 1e-16 and cannot change a double.
    """
    check_block([a for _, a, _ in specs.values()], block)
    in_block = block_window(keys).rowsBetween(W.unboundedPreceding, 0)
    in_seg = seg_window(keys)
    pos = F.col(ORD) % block
    scaled = {}
    for name, (value, a, first) in specs.items():
        keep = F.lit(1.0 - a)
        weight = F.when(F.col(ORD) == first, F.lit(1.0)).otherwise(F.lit(a))
        term = F.when(F.col(ORD) >= first, value * weight * F.pow(keep, -pos))
        scaled[f"_l_{name}"] = F.pow(keep, pos) * F.coalesce(
            F.sum(term).over(in_block), F.lit(0.0)
        )
    df = df.withColumns(scaled)
    prior = in_seg.rowsBetween(W.unboundedPreceding, -1)
    out = {}
    for name, (_, a, first) in specs.items():
        carried = F.last(
            F.when(pos == block - 1, F.col(f"_l_{name}")), ignorenulls=True
        ).over(prior)
        out[name] = F.when(
            F.col(ORD) >= first,
            F.col(f"_l_{name}")
            + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(1.0 - a), pos + 1),
        )
    return df.withColumns(out).drop(*scaled)
