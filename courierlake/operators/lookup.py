"""Lookups by time, thread, message id, sender and id that read a small part of the mail table.

The lookup copy of a mail table is laid out by day and, within a day, by time.
A range of time opens the directories of its days; for equality on the columns of
BLOOMED, Parquet keeps a Bloom filter for each row group, so row groups that
can't hold the value are passed over. Messages of one thread or conversation are
near in time as a rule, so few row groups are left. The copy grows by appending.

It has the columns that tools list, filter and measure by, not the bodies: these
are nearly all bytes of a mail table and are read there, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import moment

#: Of the copy's layout; kept copies of another are made anew.
VERSION = 3
#: Columns that are looked up by value.
BLOOMED = ("id", "x_gm_thrid", "x_gm_msgid", "message_id", "from_email")
BODIES = ("raw", "plain_text", "markdown")
ROW_GROUP_BYTES = 16 << 20
#: Rows of a row group at most, and bytes of a filter for as many values; where a day has few, a filter is of
#: a half, quarter, eighth or sixteenth of these, as its values need.
VALUES = 20_000
FILTER_BYTES = 32 << 10


def day_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def append(emails: DataFrame, path: str) -> None:
    """Add messages to the lookup copy at path, without their bodies."""
    rows = emails.drop(*BODIES).withColumn("day", day_of(moment()))
    writer = rows.repartitionByRange("day", "internaldate_epoch", "id").sortWithinPartitions("day", "internaldate_epoch", "id").write
    writer = writer.mode("append").partitionBy("day").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", VALUES)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", FILTER_BYTES)
    for name in BLOOMED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The lookup copy at path; with epochs, the days from `first` to `last` alone (filters on the times themselves stay the caller's)."""
    rows = spark.read.option("mergeSchema", "false").parquet(path).withColumn("day", F.col("day").cast("string"))
    for at, test in ((first, "ge"), (last, "le")):
        if at is not None:
            bound = day_of(F.timestamp_seconds(F.lit(at)))
            rows = rows.where(F.col("day") >= bound if test == "ge" else F.col("day") <= bound)
    return rows.drop("day")
