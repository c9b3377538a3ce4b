"""Streams of items and passes: scan as files arrive, one report per pass with work in it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from portcullis.operators.profiles import Profile
from portcullis.operators.verdict import run_header
from portcullis.operators.verify import still_current
from portcullis.plans.scan import scan_items
from portcullis.schema import severity_name
from portcullis.sources.items import stream_items
from portcullis.sources.tree import with_bodies


def gate_stream(spark: SparkSession, path: str, profile: Profile, **options) -> DataFrame:
    """Scan of files as they arrive or change. The checks are stateless; the stream's state holds the versions seen."""
    files = stream_items(spark, path, **options).withColumn("item_id", F.col("path"))
    return scan_items(files, profile)


def version_of(files: DataFrame) -> DataFrame:
    return files.select("item_id", "length", F.col("modificationTime").alias("modified"),
                        F.sha2("content", 256).alias("digest"))


def recheck(scanned: DataFrame) -> DataFrame:
    """Scanned files with whether they still are what was scanned: each is read again by its path, inside tasks."""
    before = scanned.select("item_id", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))
    now = with_bodies(scanned.select(F.col("item_id").alias("path"))).where("error IS NULL").withColumn("item_id", F.col("path"))
    return still_current(before, version_of(now))


def pass_writer(report_path: str, profile: Profile, act: Callable[[DataFrame], None] | None = None):
    """foreachBatch function: one JSON report per pass that had items, nothing for an empty pass.

    The report is written under the pass number, so a repeated pass replaces its own report."""
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # used three times; what a lost executor held is scanned again
        try:
            judged = batch.withColumn("path", F.col("item_id")) if "path" not in batch.columns else batch
            if judged.isEmpty():
                return
            now = F.current_timestamp()
            head = run_header(judged, tool="portcullis", version="0.1.0", command="watch", profile=profile.name,
                              started=now, finished=now)
            head.select(F.col("header").alias("value")).write.mode("overwrite").text(f"{report_path}/pass={number}")
            if act is not None:
                act(batch)
        finally:
            batch.unpersist()
    return write


def start_passes(scanned: DataFrame, report_path: str, profile: Profile, checkpoint: str,
                 act: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    return (scanned.writeStream.foreachBatch(pass_writer(report_path, profile, act))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def run_once(start: Callable[[], StreamingQuery], wait: Callable[[], None] = lambda: None) -> None:
    """One pass, one settle window, a second pass over the same checkpoint."""
    start().awaitTermination()
    wait()
    start().awaitTermination()


def pass_reports(items: DataFrame, width: str) -> DataFrame:
    """Batch form over verdict rows (ts, verdict): one row per time window with its counts."""
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    return (items.groupBy(F.window("ts", width).alias("w")).agg(
        F.max("verdict").alias("worst"), F.count("*").alias("files"),
        *[n(v).alias(f"n_{name}") for v, name in ((0, "pass"), (1, "warn"), (3, "fail"), (4, "block"))])
        .select(F.col("w.start").alias("pass_start"), severity_name(F.col("worst")).alias("verdict"), "files",
                "n_pass", "n_warn", "n_fail", "n_block"))
