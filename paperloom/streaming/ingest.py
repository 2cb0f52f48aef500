"""Continuous ingest of a landing folder: the batch plan, run on what arrives. Batches have no counterpart to compare to; this is ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import upload_guard


def landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Files that arrive in ``path``, guarded, with the hash of their content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(path)
    named = files.withColumn("fileName", F.regexp_extract("path", "([^/]*)$", 1)).withColumn("contentType", F.lit(""))
    return upload_guard(named).withColumn("contentSha256", F.sha2("content", 256))


def once(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of files with one content within ``delay``; state older than that goes."""
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["contentSha256"])


def ingest(files: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs ``batch`` on accepted files; it must do the same again for the same batch id."""
    out = files.where("reject_code IS NULL").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) per tumbling window and type, late ones up to ``delay`` included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
