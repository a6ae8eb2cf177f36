"""The delta log as a clustered table whose readers open few files.

Every version of the log is a manifest: one row per data file with its range of tickers and times and its
rows. Appending writes new files and the next version; compaction rewrites the small ones, range-partitioned
by (ticker, time) and sorted, so that a ticker lies in few neighbouring files; a hot ticker is split by time.
Readers take the newest complete version, choose files by their ranges without opening the others, and let
Parquet's own statistics skip row groups. A failed append or compaction leaves the version before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, lo_ticker string, hi_ticker string, lo timestamp, hi timestamp, rows long, bytes long"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions in ascending order."""
    place, fs = _fs(spark, f"{path}/manifest/*/_SUCCESS")
    found = fs.globStatus(place) or []
    return sorted(int(s.getPath().getParent().getName().removeprefix("v")) for s in found)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    there = versions(spark, path)
    if not there:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{there[-1] if version is None else version}")


def _describe(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of the data files in a folder, from two columns."""
    m = F.col("_metadata")
    rows = spark.read.parquet(folder).select("ticker", "ts", m["file_path"].alias("file"), m["file_size"].alias("bytes"))
    return rows.groupBy("file").agg(
        F.min("ticker").alias("lo_ticker"), F.max("ticker").alias("hi_ticker"), F.min("ts").alias("lo"), F.max("ts").alias("hi"),
        F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))


def _publish(rows: DataFrame, path: str) -> int:
    new = (versions(rows.sparkSession, path) or [0])[-1] + 1
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{new}")
    return new


def append(df: DataFrame, path: str) -> int:
    """Add ``df(ticker, ts, ...)``; returns the new version."""
    spark, folder = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.sortWithinPartitions("ticker", "ts").write.parquet(folder)
    return _publish(manifest(spark, path).unionByName(_describe(spark, folder)), path)


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20, target_rows: int = 1 << 20) -> int:
    """Rewrite files of less than half the target, clustered; returns the new version. Files that are large
    enough, in bytes or rows, stay as they are, and with them the ranges they have. (A task sorts the rows of
    one file; sorted ids and times take few bytes in a file and many in memory.) Replaced files are found in
    the older versions until ``vacuum``."""
    now = manifest(spark, path)
    is_small = (F.col("bytes") < target_bytes // 2) & (F.col("rows") < max(1, target_rows // 2))
    small = now.filter(is_small)
    total = small.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"), F.count(F.lit(1)).alias("n")).first()
    if not total.n or total.n < 2:
        return (versions(spark, path) or [0])[-1]
    files = [r.file for r in small.select("file").collect()]  # names of the files to replace
    folder = f"{path}/data/{uuid.uuid4().hex}"
    parts = max(1, -(-int(total.b) // target_bytes), -(-int(total.r) // target_rows))
    spark.read.parquet(*files).repartitionByRange(parts, "ticker", "ts").sortWithinPartitions("ticker", "ts").write.parquet(folder)
    return _publish(now.filter(~is_small).unionByName(_describe(spark, folder)), path)


def chosen(spark: SparkSession, path: str, tickers: list[str] | None = None, since=None, until=None) -> DataFrame:
    """Manifest rows of the files that may hold these tickers and times."""
    m = manifest(spark, path)
    if tickers is not None:
        hit = F.lit(False)
        for t in tickers:
            hit = hit | F.lit(t).between(F.col("lo_ticker"), F.col("hi_ticker"))
        m = m.filter(hit)
    if since is not None:
        m = m.filter(F.col("hi") >= since)
    return m if until is None else m.filter(F.col("lo") <= until)


def read(spark: SparkSession, path: str, tickers: list[str] | None = None, since=None, until=None) -> DataFrame:
    """Rows of the log, from the files that may hold them; ``tickers`` is a list of a few."""
    files = [r.file for r in chosen(spark, path, tickers, since, until).select("file").collect()]
    if not files:
        every = [r.file for r in manifest(spark, path).select("file").limit(1).collect()]
        if not every:
            raise ValueError(f"no log at {path}")
        return spark.read.parquet(*every).limit(0)
    df = spark.read.parquet(*files)
    if tickers is not None:
        df = df.filter(F.col("ticker").isin(tickers))
    if since is not None:
        df = df.filter(F.col("ts") >= since)
    return df if until is None else df.filter(F.col("ts") <= until)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data files and manifests that only versions older than the last ``keep`` name; returns how many files."""
    there = versions(spark, path)
    old, kept = there[:-keep], there[-keep:]
    needed = manifest(spark, path, kept[0]).select("file") if kept else None
    for v in kept[1:]:
        needed = needed.unionByName(manifest(spark, path, v).select("file"))
    gone = 0
    for v in old:
        for r in manifest(spark, path, v).select("file").join(needed.distinct(), "file", "left_anti").collect():
            place, fs = _fs(spark, r.file)
            gone += bool(fs.delete(place, False))
        place, fs = _fs(spark, f"{path}/manifest/v{v}")
        fs.delete(place, True)
    return gone
