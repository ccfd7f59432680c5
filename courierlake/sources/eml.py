"""The .eml tree: <base>/<address>/<folder slug>/<uidvalidity>/<uid>.eml."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mail import PARSED, parse_message
from ..schema import with_id

FILE = "path string, modificationTime timestamp, length long, content binary"
COLUMNS = [n.strip("`") for n in re.findall(r"(`?\w+`?) \w+(?:,|$)", PARSED)]
PATH = r"/([^/]+)/([^/]+)/(\d+)/(\d+)\.eml$"


def messages(files: DataFrame) -> DataFrame:
    """Identity and raw bytes from files as the binaryFile source gives them."""
    part = [F.regexp_extract("path", PATH, i) for i in range(1, 5)]
    rows = files.where(F.col("path").rlike(PATH))
    return rows.select(part[0].alias("address"), part[1].alias("mailbox"), part[2].cast("long").alias("uidvalidity"), part[3].cast("long").alias("uid"), F.col("modificationTime").alias("internaldate"), F.col("content").alias("raw"))


def parsed(rows: DataFrame, text_mode: str = "utf8") -> DataFrame:
    """The emails table of raw messages; parse_error tells what could not be read.

    What the server said of a message (labels, thread, receive time, size) is
    taken from the columns of rows, else from the headers of an archived file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = pd.DataFrame([parse_message(bytes(r) if r is not None else b"", text_mode) for r in f["raw"]], columns=COLUMNS)
            for name in ("date", "told_internaldate"):
                made[name] = pd.to_datetime(made[name], utc=True).dt.tz_localize(None)
            for name in ("told_thrid", "told_msgid", "told_size"):
                made[name] = made[name].astype("Int64")
            yield pd.concat([f.reset_index(drop=True), made], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInPandas(run, f"{fields}, {PARSED}")
    size = F.octet_length("raw").cast("long")

    def said(name: str, header: str, otherwise: Column) -> Column:
        return F.coalesce(*([F.col(name)] if name in rows.columns else []), F.col(header), otherwise)

    known = {
        "x_gm_thrid": said("x_gm_thrid", "told_thrid", F.lit(None).cast("long")),
        "x_gm_msgid": said("x_gm_msgid", "told_msgid", F.lit(None).cast("long")),
        "labels_json": said("labels_json", "told_labels", F.lit("[]")),
        "rfc822_size": said("rfc822_size", "told_size", size),
        "internaldate": F.coalesce("told_internaldate", "internaldate", F.timestamp_seconds(F.lit(0))),
    }
    out = out.withColumns(known).withColumns({"internaldate_epoch": F.unix_seconds("internaldate"), "size_bytes": size, "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    return with_id(out.drop(*(c for c in COLUMNS if c.startswith("told_"))))


def read_eml(spark: SparkSession, base: str, text_mode: str = "utf8") -> DataFrame:
    """All messages below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(base)
    return parsed(messages(files), text_mode)
