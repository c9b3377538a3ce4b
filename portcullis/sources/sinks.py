"""Sinks: reports, quarantine and clean output. Nothing that exists is ever overwritten."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portcullis.operators.routing import plan_destinations, plan_quarantine
from portcullis.sources import ledger


def write_report(lines: DataFrame, path: str, column: str = "line") -> None:
    """JSON lines; an existing target is refused."""
    lines.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def write_document(pieces: DataFrame, path: str, segments: int | None = None) -> DataFrame:
    """Write the pieces of a report document as text files whose concatenation by name is the document; an existing
    target is refused. Returns the manifest, a row a file: (segment, name, start, bytes). Nothing is gathered: each
    task sorts and writes one range of the document; Spark picks how many unless ``segments`` says."""
    order = ["place", "section", "ordinal"]
    ranges = pieces.repartitionByRange(segments, *order) if segments else pieces.repartitionByRange(*order)
    ranges = ranges.sortWithinPartitions(*order)
    ranges.select(F.col("piece").alias("value")).write.mode("errorifexists").text(path)
    files = pieces.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    by_name = Window.orderBy("name")  # a row a file
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes")).select(
        F.row_number().over(by_name).alias("segment"), "name", (F.sum("bytes").over(by_name) - F.col("bytes")).alias("start"), "bytes")


def write_quarantine(items: DataFrame, root: str, store: str, run: str | None = None) -> DataFrame:
    """Move BLOCK items (path, verdict, content) to a store keyed by mirrored path; returns the plan rows as the
    QUARANTINED findings. The plan is made without bodies and stored, so what is reported is what was written even
    when a task has to be repeated; bodies are joined once, to be written. Runs may add at once, and a repeat of
    ``run`` answers as the first time (see ``ledger``)."""
    plan = ledger.add(
        items.sparkSession, store, run, lambda stored: plan_quarantine(items.drop("content"), root, store, stored),
        lambda made: made.filter("moved").select("key", "path").join(items.select("path", "content"), "path").select("key", "path", "content"))
    return plan.select("path", "dest", F.lit("QUARANTINED").alias("code"), "severity", "message")


def write_clean(items: DataFrame, root: str, store: str, run: str | None = None, **options) -> DataFrame:
    """Place accepted items (path, eligible, content) without clobbering; returns PLACED and OUTPUT_EXISTS rows.
    Bodies are joined to the finished plan; runs and repeats as in ``write_quarantine``."""
    plan = ledger.add(
        items.sparkSession, store, run,
        lambda stored: plan_destinations(items.drop("content"), root, store, existing=None if stored is None else stored.select("key"), **options),
        lambda made: (made.filter("placed").select(F.col("dest").alias("key"), "path").join(items.select("path", "content"), "path")
                      .select("key", "path", "content")))
    return plan.filter(F.col("code").isNotNull()).select("path", "dest", "code", "severity", "message")


def stored_items(spark: SparkSession, store: str) -> DataFrame:
    """key, path and content of everything that finished runs have moved or placed into a store."""
    rows = ledger.stored_rows(spark, store)
    return spark.createDataFrame([], "key string, path string, content binary") if rows is None else rows
