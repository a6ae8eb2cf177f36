"""Reading quoted CSV whose fields hold line ends, without giving a file to one task.

The ``multiLine`` reader can't split a file. Here lines are read by ranges of bytes, as many tasks as there
are ranges, and joined to records in two passes: the parity of the quotes before a line says whether it
begins a record, and the number of such lines so far is its record. Both are running totals, inside a range
plus what the ranges before it add up to, so no file and no range order meets one task.

Inside quotes a quote is written twice (the form that ``escape='"'`` writes). Records that don't fit the
columns are kept whole in the rescue column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running

RESCUED = "_rescued"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, id, line): ``id`` grows inside a range."""
    df = spark.read.option("lineSep", "\n").text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                     F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def records(df: DataFrame) -> DataFrame:
    """(file, record, text) from ``lines``; records count from 1, the header included."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    df = running(df, ["file"], F.col("range"), ["id"], {"_quotes": ("sum", quotes)})
    df = df.withColumn("_starts", ((F.col("_quotes") - quotes) % 2 == 0).cast("long"))
    df = running(df, ["file"], F.col("range"), ["id"], {"record": ("sum", F.col("_starts"))})
    part = F.struct("range", "id", "line")
    whole = df.groupBy("file", "record").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.concat_ws("\n", F.transform("parts", lambda p: p["line"]))
    return whole.select("file", "record", F.regexp_replace(text, "\r$", "").alias("text"))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rescued: bool = False) -> DataFrame:
    """All-string rows of the CSV files under ``path``, each with a header. ``columns`` are their names in
    order (by default the header's). Rows with too few fields have nulls, and with ``rescued`` their text."""
    names = list(columns or spark.read.option("header", True).option("escape", '"').csv(path).columns)
    kind = ", ".join(f"`{c}` string" for c in [*names, RESCUED])
    options = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED, "maxCharsPerColumn": "-1"}
    rows = records(lines(spark, path)).filter((F.col("record") > 1) & (F.col("text") != ""))
    parsed = rows.select(F.from_csv("text", kind, options).alias("r"))
    return parsed.select(*[F.col("r")[c].alias(c) for c in names], *([F.col("r")[RESCUED].alias(RESCUED)] if rescued else []))
