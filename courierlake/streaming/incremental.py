"""Structured Streaming: incremental ingest of an .eml tree, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ingest import upsert
from ..sources.eml import FILE, messages, parsed


def ingest_new(spark: SparkSession, base: str, table: str, checkpoint: str) -> None:
    """Ingest the files that came since the last call; the checkpoint is the resume state and the upsert makes a replay harmless."""
    files = spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(base)
    query = messages(files).writeStream.foreachBatch(lambda batch, _: upsert(parsed(batch), table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows with a watermark; works on batch and streaming frames."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("count"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Session windows by user."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("count"))
