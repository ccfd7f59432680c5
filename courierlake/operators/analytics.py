"""Tools that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import filled, iso, limit_of, moment, required
from ..functions.predicates import contains as holds


def count_emails(emails: DataFrame, mailbox=None, most: int = 1000) -> DataFrame:
    """Only an absent mailbox counts all; '' is the mailbox of that name."""
    rows = emails if mailbox is None else emails.where(F.col("mailbox") == mailbox)
    return rows.agg(F.count("*").alias("count"))


def get_email_stats(emails: DataFrame, most: int = 1000) -> DataFrame:
    """All figures in one aggregate; the average is an integer."""
    total = emails.agg(
        F.count("*").alias("total_emails"),
        F.countDistinct(F.when(filled(F.col("from_email")), F.col("from_email"))).alias("unique_senders"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.countDistinct("mailbox").alias("mailboxes"),
        F.min("internaldate_epoch").alias("first"),
        F.max("internaldate_epoch").alias("last"),
    )
    return total.select("total_emails", "unique_senders", "total_size_bytes", F.expr("coalesce(total_size_bytes div nullif(total_emails, 0), 0)").alias("average_size_bytes"), "mailboxes", iso(F.col("first")).alias("earliest"), iso(F.col("last")).alias("latest"))


def top(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return rows.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name).limit(n)


def get_top_senders(emails: DataFrame, limit=None, mailbox=None, most: int = 1000) -> DataFrame:
    rows = emails.where(filled(F.col("from_email")))
    return top(rows if not mailbox else rows.where(F.col("mailbox") == mailbox), "from_email", "from", limit_of(limit, 20, most))


def get_top_domains(emails: DataFrame, limit=None, most: int = 1000) -> DataFrame:
    """What follows the first @; the whole address without one."""
    rows = emails.where(filled(F.col("from_email"))).select(F.expr("substring(from_email, instr(from_email, '@') + 1)").alias("d"))
    return top(rows, "d", "domain", limit_of(limit, 10, most))


def get_mailbox_stats(emails: DataFrame, most: int = 1000) -> DataFrame:
    return emails.groupBy("mailbox").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "mailbox")


def get_email_activity_heatmap(emails: DataFrame, limit=None, most: int = 1000) -> DataFrame:
    """Counts by weekday (0 is Sunday) and hour, UTC."""
    rows = emails.select((F.dayofweek(moment()) - 1).alias("weekday"), F.hour(moment()).alias("hour"))
    return rows.groupBy("weekday", "hour").agg(F.count("*").alias("count")).orderBy("weekday", "hour").limit(limit_of(limit, 168, most))


def get_response_time_stats(emails: DataFrame, limit=None, most: int = 1000) -> DataFrame:
    """Threads of more than one message by their duration; hours are rounded in integers."""
    threads = emails.where("x_gm_thrid is not null and x_gm_thrid != 0").groupBy("x_gm_thrid")
    spans = threads.agg(F.count("*").alias("count"), F.min("internaldate_epoch").alias("first"), F.max("internaldate_epoch").alias("last")).where("count > 1")
    spans = spans.withColumn("duration_seconds", F.col("last") - F.col("first")).orderBy(F.desc("duration_seconds"), "x_gm_thrid").limit(limit_of(limit, 50, most))
    return spans.select("x_gm_thrid", "count", iso(F.col("first")).alias("first_email"), iso(F.col("last")).alias("last_email"), "duration_seconds", F.expr("cast((duration_seconds + 18) div 36 as double) / 100").alias("duration_hours"))


def get_email_frequency_by_sender(emails: DataFrame, sender_email=None, limit=None, most: int = 1000) -> DataFrame:
    rows = emails.where(holds(F.col("from_email"), str(required(sender_email, "sender_email"))))
    days = rows.groupBy(F.date_format(moment(), "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("count"))
    return days.orderBy("date").limit(limit_of(limit, 365, most))


def get_seasonal_trends(emails: DataFrame, limit=None, most: int = 1000) -> DataFrame:
    rows = emails.select(F.year(moment()).alias("year"), F.month(moment()).alias("month"), F.date_format(moment(), "MMMM").alias("month_name"))
    months = rows.groupBy("year", "month", "month_name").agg(F.count("*").alias("count"))
    return months.orderBy("year", "month").limit(limit_of(limit, 24, most))
