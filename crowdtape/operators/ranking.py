"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_bucket(value: Column) -> Column:
    """A coarse, order-preserving integer of a double: sign, power of two and a few leading bits.

    Needs no pass over the data, and equal values share a bucket, so ranks can be computed bucket by
    bucket.
    """
    size = F.abs(value)
    exp = F.floor(F.log2(F.when(size > 0, size)))
    lead = F.floor((size / F.pow(F.lit(2.0), exp) - 1.0) * 4096)
    code = F.greatest(F.lit(1), (exp + 1100) * 4096 + F.least(F.greatest(lead, F.lit(0)), F.lit(4095)))
    return F.when(value > 0, code).when(value < 0, -code).otherwise(F.lit(0)).cast("long")


def min_ranks(df: DataFrame, group: Sequence[str], values: dict[str, Column], ids: Sequence[str]) -> DataFrame:
    """For each name in ``values`` a ``rank`` (1 = highest, ties share the lowest rank) of the
    row inside its group.

    A rank is the number of higher rows in the group plus one.  Rows are first counted per distinct
    value, so a value that a third of all rows share is one row where ranks are worked out: whole buckets
    above are counted from a small table, the rest inside the (group, bucket) group of distinct values.
    All columns are unpivoted so that one shuffle ranks them together.
    """
    group, ids = list(group), list(ids)
    long = df.select(
        *group, *ids,
        F.explode(F.array(*[F.struct(F.lit(n).alias("n"), v.cast("double").alias("v")) for n, v in values.items()])).alias("x"),
    ).select(*group, *ids, "x.n", "x.v")
    each = long.groupBy(*group, "n", "v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_bucket(F.col("v")))
    counts = each.groupBy(*group, "n", "_b").agg(F.sum("_c").alias("_k"))
    above = W.partitionBy(*group, "n").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    start = counts.withColumn("_s", F.coalesce(F.sum("_k").over(above), F.lit(0))).drop("_k")
    w = W.partitionBy(*group, "n", "_b").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, -1)
    # both tables grow with the rows: merged, so that none is gathered and broadcast by the driver
    placed = each.join(start.hint("merge"), [*group, "n", "_b"]).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("n").alias("_n"), F.col("v").alias("_v"),
        (F.col("_s") + F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1).alias("rank"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("v").eqNullSafe(F.col("_v"))
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranked = long.join(placed.hint("merge"), same).select(*group, *ids, "n", "rank")
    return ranked.groupBy(*group, *ids).agg(
        *[F.max(F.when(F.col("n") == n, F.col("rank"))).alias(f"rank_{n}") for n in values]
    )
