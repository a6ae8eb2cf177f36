"""Expected processing time of a post from two token counts, fitted from mergeable sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["n", "s1", "s2", "s11", "s12", "s22", "sd", "s1d", "s2d"]


def duration_state(df: DataFrame, keys=()) -> DataFrame:
    """Sums that determine the fit; states of two batches add up field by field."""
    a, b, d = (F.col(c).cast("double") for c in ("article_tokens", "summary_tokens", "duration"))
    a, b = F.greatest(a, F.lit(0.0)), F.greatest(b, F.lit(0.0))
    good = df.filter(F.col("duration") > 0)
    return good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("s1"), F.sum(b).alias("s2"), F.sum(a * a).alias("s11"), F.sum(a * b).alias("s12"),
        F.sum(b * b).alias("s22"), F.sum(d).alias("sd"), F.sum(a * d).alias("s1d"), F.sum(b * d).alias("s2d"),
    )


def merge_states(states: DataFrame, keys=()) -> DataFrame:
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATE])


def duration_model(state: DataFrame) -> DataFrame:
    """Least squares of duration on both counts; a count that never varies gets coefficient 0."""
    n = F.col("n").cast("double")
    v11, v22, v12 = (F.col(p) - F.col(x) * F.col(y) / n for p, x, y in (("s11", "s1", "s1"), ("s22", "s2", "s2"), ("s12", "s1", "s2")))
    c1, c2 = F.col("s1d") - F.col("s1") * F.col("sd") / n, F.col("s2d") - F.col("s2") * F.col("sd") / n
    det = v11 * v22 - v12 * v12
    both = F.abs(det) > 1e-9
    b1 = F.when(both, F.try_divide(c1 * v22 - c2 * v12, det)).otherwise(F.coalesce(F.try_divide(c1, F.when(F.abs(v11) > 1e-9, v11)), F.lit(0.0)))
    b2 = F.when(both, F.try_divide(c2 * v11 - c1 * v12, det)).otherwise(
        F.when(F.abs(v11) > 1e-9, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(c2, F.when(F.abs(v22) > 1e-9, v22)), F.lit(0.0))))
    df = state.withColumns({"article_coefficient": b1, "summary_coefficient": b2})
    mean = lambda c: F.col(c) / n
    return df.withColumn("intercept", mean("sd") - F.col("article_coefficient") * mean("s1") - F.col("summary_coefficient") * mean("s2"))


def predicted_duration(article: Column, summary: Column) -> Column:
    """Prediction from a joined model row; where the line gives nothing positive, the mean time per
    token, then the plain mean."""
    line = F.col("intercept") + F.col("article_coefficient") * article + F.col("summary_coefficient") * summary
    rate = F.try_divide(F.col("sd"), F.col("s1") + F.col("s2")) * (article + summary)
    mean = F.try_divide(F.col("sd"), F.col("n"))
    pos = lambda c: F.when(c > 0, c)
    return F.coalesce(pos(line), pos(rate), pos(mean))
