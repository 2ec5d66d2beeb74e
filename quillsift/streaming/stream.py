"""Structured Streaming around the same triage: an extension, since triage itself keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsift.plans.triage import facts, triage


def message_stream(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """New message files below path as a stream."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)


def once_per_message(stream: DataFrame, key: str, watermark: str = "1 hour", at: str = "modificationTime") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def verdict_counts(verdicts: DataFrame, at: str, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Verdicts per window of event time; late rows beyond the watermark are left out."""
    return verdicts.withWatermark(at, watermark).groupBy(F.window(at, window), "final_verdict").agg(F.count("*").alias("n"))


def start_triage(stream: DataFrame, key: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Triage each micro-batch and append the results as Parquet; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        found = facts(batch, key)
        result = triage(found, key).select(key, "final_verdict", "report")
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
