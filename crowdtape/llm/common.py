"""What the operators of this folder share: the shared scratch folder, table reading, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is the blank and the five controls from tab to carriage return; words are all else.
SPACE_CHARS = " \t\n\x0b\x0c\r"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without
    that setting gets a private one; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with no operator's own, and where each column went."""
    to = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*to.values()), to


def restored(df: DataFrame, to: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in to.items()])


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Few rows per Arrow batch, so that batches of very long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and
    gives the planner the table's true size."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text) -> F.Column:
    """The words of a text column as an array; null and blank texts have none."""
    body = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        body = F.replace(body, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(body, " "), "")
