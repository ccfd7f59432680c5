"""The emails table: columns, types and the base projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identity of a message.
IDENTITY = ("address", "mailbox", "uidvalidity", "uid")
#: Columns of the list tools.
BASE = ("id", "address", "mailbox", "uid", "uidvalidity", "message_id", "x_gm_msgid", "date", "internaldate", "internaldate_epoch", "from", "subject", "rfc822_size")

EMAILS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("address", T.StringType()),
        T.StructField("mailbox", T.StringType()),
        T.StructField("uidvalidity", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("x_gm_thrid", T.LongType()),
        T.StructField("x_gm_msgid", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("internaldate", T.TimestampType()),
        T.StructField("internaldate_epoch", T.LongType()),
        T.StructField("rfc822_size", T.LongType()),
        T.StructField("from_email", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to_emails", T.StringType()),
        T.StructField("cc_emails", T.StringType()),
        T.StructField("bcc_emails", T.StringType()),
        T.StructField("envelope_reply_to", T.StringType()),
        T.StructField("envelope_in_reply_to", T.StringType()),
        T.StructField("envelope_references", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("has_attachments", T.BooleanType()),
        T.StructField("labels_json", T.StringType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("plain_text", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


#: Version of this schema; a stored table says which it has.
VERSION = 2


def missing(df: DataFrame) -> list[str]:
    """Columns of the schema that a table lacks or has in another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in EMAILS if have.get(f.name) != f.dataType]


def migrated(df: DataFrame) -> DataFrame:
    """A table of an older version with the columns of this one: new ones are null, others are cast."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EMAILS), *(c for c in df.columns if c not in EMAILS.names))


def with_id(df: DataFrame) -> DataFrame:
    """A surrogate key that depends on the identity only, so that a rerun gives it again."""
    return df.withColumn("id", F.xxhash64(*IDENTITY))
