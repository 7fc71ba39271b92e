"""Streaming ingestion: new files in a folder become items once each.

This is an extension beyond the batch engine: a digest seen before within the
watermark is not processed again, as with the result cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.documents import admit

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_documents(spark: SparkSession, path: str, delay: str = "1 day", max_mb: int = 50) -> DataFrame:
    """A stream of admitted documents, each digest once within ``delay``."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]*)\z", 1)).withColumn("stated", F.lit(""))
    seen = named.withColumn("doc_key", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["doc_key"])
    return admit(seen, max_mb)


def ingest(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], delay: str = "1 day"):
    """Handles all documents that have come in, batch by batch, and stops."""
    stream = new_documents(spark, path, delay)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of event time, for streams and tables alike."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
