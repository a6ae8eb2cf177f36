"""Running sums and maxima over a group of any size.

A running total inside (group, bucket) plus what the buckets before it add up to.  Only one row per
(group, bucket) is ever ordered by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FN = {"sum": F.sum, "max": F.max}


def running(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running ``sum``/``max`` columns: name -> (kind, value).  ``bucket`` must grow
    with ``order``, and ``order`` must be total."""
    keys = list(keys)
    b = df.withColumn("_b", bucket).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    totals = b.groupBy(*keys, "_b").agg(*[_FN[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_b", *[_FN[k](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in values.items()])
    here = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = b.join(carry, [*keys, "_b"])
    cols = {}
    for n, (k, _) in values.items():
        local, inherited = _FN[k](f"_v_{n}").over(here), F.col(f"_c_{n}")
        cols[n] = local + F.coalesce(inherited, F.lit(0)) if k == "sum" else F.greatest(local, inherited)
    drop = ["_b", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values]]
    return out.withColumns(cols).drop(*drop)
