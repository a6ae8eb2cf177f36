"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive slices of their normalised text, most significant first. A group that
a slice leaves with one document is finished; a group whose texts have all ended holds equal texts, and
no digest decides about equality. Slices widen sixteenfold from level to level, so the levels grow with
the logarithm of the longest text. Every level counts its groups with partial aggregation and sends only
the documents of unfinished groups to the next, through a table in the shared folder; a group of any
size is spread over tasks, because a document only meets its group's one-row summary.

Texts are equal when identical after lower-casing A-Z. Null texts count as empty and are equal to each
other. Of equal texts the row with the largest id stays (null ids are the smallest); of rows that share
that id and text, one stays. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, read, renamed, restored, stored

FIRST_SLICE = 128
WIDENS = 16
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; whole-ASCII texts take the faster built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def radix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs``, its ``carry`` columns (all by default) and ``RESULT``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = text_col in carry  # then it travels once, with the row
    body = F.coalesce(F.col(text_col if carried else "_text"), F.lit(""))
    level = docs.select(
        *carry, *([] if carried else [text.alias("_text")]), F.col(id_col).alias("_id"),
        F.sha2(lower_ascii(text), 256).alias("text_sha256"), F.lit(0).cast("long").alias("_gid"))
    start, width, finished = 1, FIRST_SLICE, []
    while True:
        keyed = level.withColumn("_slice", lower_ascii(F.substring(body, start, width))).withColumn(
            "_ended", F.length(body) < start + width)
        key = ["_gid", "_slice", "_ended"]
        groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).filter("_n > 1")
        groups = stored(groups.withColumn("_next", F.monotonically_increasing_id()), "radix-groups")
        # a merge join at every size: one plan to reason about, and hot groups are split at run time
        met = keyed.join(groups.hint("merge"), key, "left").withColumn("_open", F.col("_n").isNotNull() & ~F.col("_ended"))
        met = stored(met.select(
            *carry, *([] if carried else [F.when(F.col("_open"), F.col("_text")).alias("_text")]), "_id", "text_sha256", "_open",
            F.when(F.col("_ended") & F.col("_n").isNotNull(), F.col("_next")).alias("_group"),
            F.coalesce("_next", F.lit(0).cast("long")).alias("_gid"), "_n", "_keep",
            F.monotonically_increasing_id().alias("_row")), "radix-level")
        finished.append(_decided(met.filter(~F.col("_open")), carry))
        level = met.filter("_open").select(*carry, *([] if carried else ["_text"]), "_id", "text_sha256", "_gid")
        if level.isEmpty():
            break
        start, width = start + width, width * WIDENS
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def _decided(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Which row stays: in a group, one row of the largest id."""
    largest = rows.filter(F.col("_group").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep")))
    stays = largest.groupBy("_group").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_stays"))
    alone = F.col("_group").isNull()
    return rows.join(stays, "_row", "left").select(
        *carry, F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("_n")).cast("long").alias("group_size"),
        (alone | F.coalesce("_stays", F.lit(False))).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts."""
    df, to = renamed(docs)
    return restored(radix_dedup(df, to["doc_id"], to["text"]).filter("kept"), to)


@query("op9_radix_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""")
def op9_radix_dedup(spark, sf_dir):
    return radix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
