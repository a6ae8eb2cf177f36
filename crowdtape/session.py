"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # windows are bound by CPU, not by bytes: do not merge small shuffle partitions below the number
    # of cores (the advisory size alone would put 50 MB of bars on a single task)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "crowdtape", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults every operator expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Runtime settings the operators rely on, for a session somebody else built: timestamps are
    compared as UTC instants, and partition merging keeps every core busy."""
    merging = "spark.sql.adaptive.coalescePartitions."
    for key in ("spark.sql.session.timeZone", merging + "parallelismFirst", merging + "minPartitionSize"):
        if spark.conf.get(key, None) != DEFAULTS[key]:
            spark.conf.set(key, DEFAULTS[key])


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  Only a local session that names none gets a private one;
    on a cluster every executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not current and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = current or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared folder so that a lost executor cannot force a replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as a table under the shared folder: columns and compressed, a fraction of the rows
    that a checkpoint writes, and a reader takes the columns it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: ``transformWithState`` asks for RocksDB. A store that is closed after its task leaves nothing on the
#: executor (each open one holds 4 MB for its manifest alone) and is loaded by whichever executor comes next.
STREAMING_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def streaming_state(spark: SparkSession):
    """Streams that are started inside keep their state as ``STREAMING_STATE`` says; the session's own
    settings come back afterwards."""
    was = {key: spark.conf.get(key, None) for key in STREAMING_STATE}
    for key, value in STREAMING_STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
