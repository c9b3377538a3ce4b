"""Settle window: act on a path once its version has been seen unchanged for long enough.

Observations are (path, version, ts); a NULL version says that the path is gone. The clock starts
at the first observation of a version, every version is reported once, a change starts again.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from portcullis.operators.spread import with_carry
from portcullis.session import checkpoint_dir

SETTLED_TYPE = "path string, version string, since timestamp_ntz, settled_at timestamp_ntz"


def time_block(ts: str, seconds: int) -> Column:
    return F.expr(f"unix_seconds(cast({ts} as timestamp)) div {seconds}L")


# --- finite logs --------------------------------------------------------------------------------
def settle_batch(obs: DataFrame, window_seconds: int, pass_no: str | None = None,
                 block_seconds: int = 86400) -> DataFrame:
    """(path, version, since, settled_at) of every version that settled, once each.

    A gap in ``pass_no``, where the log has one, means the path was absent in between. The previous
    version and the start of the run of equal versions are carried across time blocks, so a path
    with very many observations is spread over its blocks."""
    seen = F.struct(F.col("version").alias("v"), F.col(pass_no).alias("p") if pass_no else F.lit(0).alias("p"))
    rows = obs.withColumn("__seen", seen)
    block = time_block("ts", block_seconds)
    rows = with_carry(rows, ["path"], ["ts", "version"], block, "__seen", "__prev", include_current=False)
    same = F.col("__prev").isNotNull() & F.col("__prev.v").eqNullSafe(F.col("version"))
    if pass_no:
        same = same & (F.col(pass_no) - F.col("__prev.p") <= 1)
    rows = rows.withColumn("__start", F.when(~same, F.col("ts")))
    rows = with_carry(rows, ["path"], ["ts", "version"], block, "__start", "since", include_current=True)
    due = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(since as timestamp))") >= window_seconds * 1_000_000
    return (rows.filter(F.col("version").isNotNull()).groupBy("path", "version", "since")
            .agg(F.min(F.when(due, F.col("ts"))).alias("settled_at")).filter(F.col("settled_at").isNotNull()))


def prune_absent(known: DataFrame, last_pass: DataFrame) -> DataFrame:
    """Remembered paths the last pass still lists; the rest is forgotten."""
    return known.join(last_pass.select("path").distinct(), "path", "left_semi")


def once_per_change(messages: DataFrame, keys: list[str], block_seconds: int = 86400) -> DataFrame:
    """Messages (keys, ts, msg) that are new, differ from the last, or return after it was clear.
    An empty or NULL msg says that there was nothing to report."""
    rows = messages.withColumn("__m", F.struct(F.coalesce("msg", F.lit("")).alias("m")))
    rows = with_carry(rows, keys, ["ts", "msg"], time_block("ts", block_seconds), "__m", "__prev", include_current=False)
    said = F.coalesce("msg", F.lit(""))
    return rows.filter((said != "") & (said != F.coalesce("__prev.m", F.lit("")))).drop("__m", "__prev")


# --- streams ------------------------------------------------------------------------------------
class SettleProcessor(StatefulProcessor):
    """One small state per path: its version, since when, whether it was reported, late rows."""

    def __init__(self, window_seconds: int, silence: bool):
        self.window_us, self.silence = int(window_seconds * 1_000_000), silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "version string, since_us long, done boolean, late long")

    def _out(self, key, version, since, at):
        stamp = lambda us: pd.to_datetime(us, unit="us")
        return (key[0], version, stamp(since), stamp(at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got.assign(us=got["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "version"])
        state = self.state.get() if self.state.exists() else None
        version, since, done, late = state if state is not None else (None, None, False, 0)
        out = []
        for v, us in zip(got["version"], got["us"]):
            us = int(us)
            v = None if pd.isna(v) else v
            if since is not None and us < since:
                late += 1              # older than what is known: ignored and counted
            elif v is None:
                version, since, done = None, None, False
            elif v != version or since is None:
                version, since, done = v, us, False
                if self.silence:
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
                    self.handle.registerTimer((since + self.window_us) // 1000)
            if v is not None and v == version and not done and us - since >= self.window_us:
                done = True
                out.append(self._out(key, version, since, us))
        if since is None:
            self.state.clear()
        else:
            self.state.update((version, since, done, late))
        yield pd.DataFrame(out, columns=["path", "version", "since", "settled_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            version, since, done, late = self.state.get()
            if not done:
                self.state.update((version, since, True, late))
                out.append(self._out(key, version, since, since + self.window_us))
        yield pd.DataFrame(out, columns=["path", "version", "since", "settled_at"])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(obs: DataFrame, window_seconds: int, silence: bool = False, lateness: str = "1 hour") -> DataFrame:
    """Streaming form of ``settle_batch``. With ``silence`` a version also settles when nothing more
    is heard of it for the window, measured in event time."""
    if silence:
        obs = obs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return obs.groupBy("path").transformWithStateInPandas(
        statefulProcessor=SettleProcessor(window_seconds, silence), outputStructType=SETTLED_TYPE,
        outputMode="Append", timeMode="EventTime" if silence else "None")


def settle_files(spark: SparkSession, source: str, read, window_seconds: int, work: str | None = None) -> DataFrame:
    """Run the settle stream over what lies at ``source`` now and return what settled.

    ``source`` is a folder, a table written as one, or one file. ``read`` turns its rows into observations. State
    and output live in the shared folder, so a lost executor loses nothing."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    work = work or f"{checkpoint_dir(spark)}/settle-{uuid.uuid4().hex}"
    folder, _, name = source.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    is_folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    rows = stream.parquet(source) if is_folder else stream.option("pathGlobFilter", name).parquet(folder)
    done = (settle(read(rows), window_seconds).writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(SETTLED_TYPE).parquet(f"{work}/out")
