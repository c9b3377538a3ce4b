"""Session settings the gate is designed for, and the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FINE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

SETTINGS = {
    FINE: "1024",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast joins are chosen by Spark from measured sizes only, never above this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    # Rows carry whole bodies, so input splits stay small enough to decode within a task's memory.
    "spark.sql.files.maxPartitionBytes": str(64 << 20),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Plans are built from many small expressions; recording a call site for each triples the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app: str = "portcullis", **extra: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        b = b.config(key, value)
    return b


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is
    unset and everything runs in one process. Executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fine_shuffles(spark: SparkSession) -> None:
    """Shuffles begin with many partitions, which Spark joins to its advisory size: what a task sorts then has that size
    and does not grow with the input, whatever ``spark.sql.shuffle.partitions`` says."""
    if spark.conf.get(FINE, None) is None:
        spark.conf.set(FINE, SETTINGS[FINE])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the frame is stored in the shared folder, so several sinks can read it
    without recomputing it and a lost executor does not lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: like ``cut``, and Spark knows its bytes
    when it picks a join."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
