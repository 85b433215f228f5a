"""Structured Streaming: changed notes in micro-batches, and sessions with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_notes(spark: SparkSession, folder: str, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "3 seconds", pattern: str = "*.md") -> StreamingQuery:
    """work(notes, batch) on the notes that came or changed since the last batch: path, content, of each path the newest.

    A batch begins at most every so often, so many events on one path are one. Without `every` it does what is there and
    ends. A batch that failed is done again; work must bear that.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def once(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"))
        work(newest, number)

    writer = stream.select("path", "modificationTime", "content").writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A stream or table of events (ts, keys) to keys, start, calls of each session; events later than `late` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(F.count("*").alias("calls")).select(*keys, F.col("s.start").alias("start"), "calls")
