"""Reading and writing the post log, stage history and delta log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.posts import PRESERVED_STAGES
from .split_csv import read_csv

# fixed values: the canonical columns of a raw post row
RAW_COLUMNS = [
    "scraped_at", "platform", "source", "post_id", "url", "title", "text", "final_url",
    "fetch_status", "domain",
]
REQUIRED_RAW = ["platform", "source", "post_id", "url", "title", "text", "scraped_at"]


def all_strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def blank_to_null(c: Column) -> Column:
    """Missing values have one form inside: NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def read_raw_posts(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All-string CSV with header; nulls become "", ``ts`` is the UTC time or NULL. A file is read by as
    many tasks as it has ranges, line ends inside quotes included."""
    df = read_csv(spark, path, columns)
    missing = [c for c in REQUIRED_RAW if c not in df.columns]
    if missing:
        raise ValueError(f"raw post log lacks columns {missing}")
    return with_parsed_time(df.na.fill(""))


def with_parsed_time(df: DataFrame, col: str = "scraped_at") -> DataFrame:
    return df.withColumn("ts", F.try_to_timestamp(blank_to_null(F.col(col))))


def union_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of columns, missing ones "" - by name, not position."""
    return old.unionByName(new, allowMissingColumns=True).na.fill("")


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    """Append files; nothing already stored is rewritten."""
    writer = df.write.mode("append").format(fmt)
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


# fixed values: what evidence matching reads of a post
EVIDENCE_COLUMNS = ["post_id", "platform", "source", "url", "title", "text", "scraped_at"]


def evidence_posts(posts: DataFrame) -> DataFrame:
    """The columns that evidence matching reads; a scan below reads no others."""
    return posts.select(*EVIDENCE_COLUMNS)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV with header, JSON lines or Parquet; nested columns travel as JSON in CSV."""
    if fmt == "csv":
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
        df.select(*flat).write.option("header", True).option("escape", '"').csv(path)
    else:
        df.write.format(fmt).save(path)


def canonical_row(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """S3: exactly these columns, as strings, no nulls."""
    def shaped(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")

    return df.select(*[shaped(c).alias(c) for c in columns])


def normalise_posts(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill id, platform, source, title and times from what a feed happens to send.

    A post without id, address or title gets a hash of its content as id, so that a re-run yields
    the same id.
    """
    def col(name):
        return blank_to_null(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")

    now = F.current_timestamp() if now is None else now
    platform = F.coalesce(col("platform"), F.lit("reddit"))
    content_id = F.concat_ws("-", platform, F.sha1(F.concat_ws("\u0001", col("source"), col("text"), col("scraped_at"))))
    post_id = F.coalesce(col("id"), col("post_id"), col("url"), col("title"), content_id)
    posted = F.try_to_timestamp(col("posted_at"))
    score = col("score")
    return df.select(
        post_id.alias("post_id"), platform.alias("platform"),
        F.coalesce(col("source"), col("label"), F.lit("")).alias("source"),
        F.coalesce(col("url"), F.lit("")).alias("url"),
        F.coalesce(col("title"), col("headline"), post_id).alias("title"),
        F.coalesce(col("author"), F.lit("")).alias("author"),
        F.coalesce(F.try_to_timestamp(col("scraped_at")), posted, now).alias("scraped_at"),
        posted.alias("posted_at"),
        F.when(score.rlike(r"^\d+$"), score.try_cast("double")).alias("score"),
        F.coalesce(col("text"), F.lit("")).alias("text"),
    )


def write_archive(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Gzipped JSON lines in files of bounded size."""
    df.write.mode("append").option("compression", "gzip").option(
        "maxRecordsPerFile", max_records
    ).json(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key over both frames.  ``max_by`` merges on the map side, so a key
    with very many versions needs no sort."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in version], *[F.col(c) for c in rest if c not in version])
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def append_stage(stages: DataFrame, post_id: Column, stage: str, payload: Column, at: Column) -> DataFrame:
    """History rows for stage output found on ``stages``."""
    return stages.select(
        post_id.alias("post_id"), F.lit(stage).alias("stage"), at.alias("created_at"), payload.alias("payload")
    )


def clear_analysis(
    stages: DataFrame, posts: DataFrame | None = None, keep: Sequence[str] = PRESERVED_STAGES,
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) stage rows; all posts, or only those listed in ``posts``."""
    doomed = ~F.col("stage").isin(list(keep))
    if posts is None:
        return stages.filter(~doomed), stages.filter(doomed)
    hit = posts.select("post_id").distinct().withColumn("_hit", F.lit(True))
    df = stages.join(hit, "post_id", "left")
    gone = doomed & F.coalesce("_hit", F.lit(False))
    return df.filter(~gone).drop("_hit"), df.filter(gone).drop("_hit")


def strip_extra(extras: DataFrame, key: str = "research") -> DataFrame:
    """Drop one key from each post's JSON blob, and tell which rows had it."""
    parsed = F.from_json("payload_json", "map<string,string>")
    return extras.withColumns(
        {
            "had_key": F.coalesce(F.map_contains_key(parsed, F.lit(key)), F.lit(False)),
            "payload_json": F.coalesce(
                F.to_json(F.map_filter(parsed, lambda k, _: k != key)), F.col("payload_json")
            ),
        }
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
