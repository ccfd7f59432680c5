"""Streams that keep state: reply latency with timers, deduplication and sliding windows with watermarks.

Each gives what the same question gives over the whole table, whatever the
order in which messages come, as long as they come within the delay named; what
comes later is left out and counted by Spark (dropped rows of the query's
progress). Replayed input changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENCIES = "id long, x_gm_thrid long, replied_to string, from_email string, latency_seconds long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replies(StatefulProcessor):
    """Messages of a thread wait by (time, id) until the watermark has passed their time, then go in that order.

    State of a thread: the messages that wait, each once however often it
    comes, and the last one that went; so it holds the delay's messages only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "epoch long, id long", "from_email string")
        self.last = handle.getValueState("last", "epoch long, id long, from_email string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.last.get() if self.last.exists() else None
        for frame in rows:
            for epoch, mail, sender in zip(frame["internaldate_epoch"].tolist(), frame["id"].tolist(), frame["from_email"].tolist(), strict=True):
                if passed is not None and (epoch, mail) <= (passed[0], passed[1]):
                    continue  # gone before: a replay
                self.waiting.updateValue((epoch, mail), (sender if isinstance(sender, str) else None,))
                self.handle.registerTimer(epoch * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        due = sorted((at, value[0]) for at, value in self.waiting.iterator() if at[0] <= now) if self.waiting.exists() else []
        out = []
        passed = self.last.get() if self.last.exists() else None
        for (epoch, mail), sender in due:
            if passed is not None and sender is not None and passed[2] is not None and sender != passed[2]:
                out.append((mail, key[0], passed[2], sender, epoch - passed[0]))
            passed = (epoch, mail, sender)
            self.waiting.removeKey((epoch, mail))
        if due:
            self.last.update(passed)
        if out:
            yield pd.DataFrame(out, columns=["id", "x_gm_thrid", "replied_to", "from_email", "latency_seconds"])

    def close(self) -> None:
        pass


def reply_latencies(emails: DataFrame, late: str = "1 day") -> DataFrame:
    """Seconds between successive messages of a thread from different senders, as a stream; the session's state store must be RocksDB (see state_store)."""
    rows = emails.where("x_gm_thrid is not null and x_gm_thrid != 0").select("id", "x_gm_thrid", "from_email", "internaldate_epoch", F.timestamp_seconds("internaldate_epoch").alias("at"))
    return rows.withWatermark("at", late).groupBy("x_gm_thrid").transformWithStateInPandas(Replies(), outputStructType=LATENCIES, outputMode="Append", timeMode="EventTime")


def state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB: off the heap, and written as changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events once each by key; state is kept for the delay only. Works on batch and streaming frames."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = "1 day") -> DataFrame:
    """Counts by type in windows of `width` that begin every `step`; on a stream windows come when the watermark has passed their end (late: None if events have one)."""
    rows = events
    if late is not None:
        rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("count"))
