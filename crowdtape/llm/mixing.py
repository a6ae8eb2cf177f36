"""Mixing sources to target weights by capped water-filling.

Each source's share of the budget is its weight's share, clamped at ``max_epochs`` times its size; what
the clamp frees is spread over the others by weight until no source exceeds its clamp. A source that
gets r epochs has each document taken floor(r) times and once more for the part of the source, in seeded
order, that fills the rest; the last gap is closed by the one document whose size comes nearest to it.

The order is that of md5(seed:doc_id), so reruns agree on any cluster, and rows of one doc_id are taken
alike. The place in that order where a source's fraction is full is found by bucket totals at three
levels of the hash, so no source is ever sorted as a whole. Null texts have size 0; a null source is a
source of its own, last in order; sources of size 0 get nothing. Result columns replace input columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, read, renamed, restored, stored, words

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def order_hash(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct) with ``place``, 0 up, by code point, null last; sorted by ranges."""
    parts = stored(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id()), "mix-ranks")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.join(before.select("_part", "_before"), "_part").select("source", (F.col("_before") + inside).alias("place"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``. Each round clamps every source above its
    limit at once and passes only three sums through the driver."""
    limit = F.lit(float(max_epochs)) * F.col("source_size")
    level = sources.withColumn("_full", F.lit(False))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped = -1
    while True:
        sums = level.agg(
            F.coalesce(F.sum(F.when(F.col("_full"), limit)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))), F.lit(0)).cast("double").alias("weights"),
            F.coalesce(F.sum(F.col("_full").cast("long")), F.lit(0)).alias("clamped")).first()
        if sums.clamped == clamped:
            break
        clamped = sums.clamped
        rest = F.lit(share * total - sums.taken) * F.col("weight")
        # the decision is a comparison with constants, so the plan stays as flat as the first
        now = F.lit(False) if sums.weights == 0 else (limit <= rest / F.lit(sums.weights))
        level = stored(level.withColumn("_full", F.col("_full") | now), "mix-level")
    target = F.when(F.col("_full") | F.lit(sums.weights == 0), limit).otherwise(
        F.lit(share * total - sums.taken) * F.col("weight") / F.lit(sums.weights or 1.0))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _full_bucket(sizes: DataFrame, plan: DataFrame, bucket: Column) -> DataFrame:
    """Per source, the bucket in which its running total reaches ``need``, and the rest then needed."""
    sums = sizes.withColumn("_b", bucket).groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    sums = sums.withColumn("_upto", F.sum("_s").over(Window.partitionBy("source").orderBy("_b")))
    hit = sums.join(plan.select(F.col("source").alias("_source"), "need"), F.col("source").eqNullSafe(F.col("_source")))
    hit = hit.filter((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("_s") < F.col("need")))
    return hit.groupBy("source").agg(F.min(F.struct("_b", (F.col("need") - (F.col("_upto") - F.col("_s"))).alias("rest"))).alias("_m")).select(
        "source", F.col("_m._b").alias("_b"), F.col("_m.rest").alias("need"))


def _inside(sizes: DataFrame, hit: DataFrame, bucket: Column) -> DataFrame:
    h = hit.select(F.col("source").alias("_source"), F.col("_b"))
    return sizes.withColumn("_here", bucket).join(h, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_here") == F.col("_b")), "left_semi").drop("_here")


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: size, target, whole repetitions, and the hash below which (``below``) and at which
    (``also``) documents are taken once more. ``sizes`` (source, size, h) should be a written table."""
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    wheel = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = ranked(totals.select("source")).withColumnRenamed("source", "_source")
    level = totals.join(placed, F.col("source").eqNullSafe(F.col("_source"))).select("source", "source_size", wheel.cast("long").alias("weight"))
    plan = water_fill(stored(level, "mix-weights"), share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    need = plan.filter("need > 0").select("source", "need")
    first = stored(_full_bucket(sizes, need, F.substring("h", 1, 3)), "mix-bucket")
    second_rows = _inside(sizes, first, F.substring("h", 1, 3))
    second = stored(_full_bucket(second_rows, first, F.substring("h", 1, 6)), "mix-bucket")
    place = stored(_full_bucket(_inside(second_rows, second, F.substring("h", 1, 6)), second, F.col("h")), "mix-place")
    # of what is not taken, the document nearest to the gap, if it brings the total nearer
    p = place.select(F.col("source").alias("_source"), F.col("_b").alias("below"), F.col("need").alias("gap"))
    left = sizes.join(p, F.col("source").eqNullSafe(F.col("_source"))).filter(
        (F.col("h") >= F.col("below")) & (F.col("size") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    close = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("h"))).alias("m")).select(
        F.col("source").alias("_closed"), F.col("m.h").alias("also"))
    out = plan.join(p.drop("gap"), F.col("source").eqNullSafe(F.col("_source")), "left").join(close, F.col("source").eqNullSafe(F.col("_closed")), "left")
    return stored(out.select("source", "source_size", "target", "whole", F.coalesce("below", F.lit("")).alias("below"), F.coalesce("also", F.lit("")).alias("also")), "mix-decided")


def times(h: Column) -> Column:
    """How often a document of hash ``h`` is taken, under its source's plan."""
    return (F.col("whole") + ((h < F.col("below")) | (h == F.col("also"))).cast("long")).alias("times")


def document_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), order_hash(F.col("doc_id"), seed).alias("h"))


def _planned(df: DataFrame, plan: DataFrame) -> DataFrame:
    return df.join(plan.withColumnRenamed("source", "_plan_source"), F.col("source").eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    plan = mix_plan(stored(document_sizes(docs, seed), "mix-sizes"), **how)
    df, to = renamed(docs)
    both = df.join(plan, df[to["source"]].eqNullSafe(plan["source"])).withColumn("_times", times(order_hash(F.col(to["doc_id"]), seed)))
    return restored(both.filter("_times > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))), to)


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS i FROM s),
c AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM r),
k AS (SELECT *, 2.0 * source_size <= rest * w / ws AS fits FROM c),
n AS (SELECT coalesce(min(i) FILTER (WHERE NOT fits), 1e18) AS i FROM k),
l AS (SELECT rest, ws FROM k, n WHERE k.i = n.i),
t AS (SELECT source, source_size, CAST(CASE WHEN k.i < n.i THEN 2.0 * source_size ELSE (SELECT rest FROM l) * w / (SELECT ws FROM l) END AS DOUBLE) AS target FROM k, n),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS need FROM p),
u AS (SELECT d.doc_id, d.size, d.h, q.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
v AS (SELECT *, need > 0 AND upto < need AS more, need - coalesce(max(CASE WHEN upto < need THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM u),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN need > 0 AND NOT more AND size > 0 AND abs(size - gap) < gap THEN abs(size - gap) ELSE 1e18 END, h) = 1
        AND need > 0 AND NOT more AND size > 0 AND abs(size - gap) < gap AS closing FROM v)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more OR closing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x"""


@query("op3_source_mix", SQL)
def op3_source_mix(spark, sf_dir):
    sizes = stored(document_sizes(read(spark, sf_dir, "documents")), "mix-sizes")
    df = _planned(sizes, mix_plan(sizes))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"))
