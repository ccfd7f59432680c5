"""The emails table of an SQLite file, read in slices of its row numbers.

The file must lie where every executor can open it; it is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EMAILS, with_id

SLICE = 5_000
#: Columns that this table derives itself.
OWN = ("id", "size_bytes")


class SourceSchemaError(Exception):
    """The file has no emails table, or it lacks columns that identify a message."""


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(path: str) -> list[str]:
    with opened(path) as db:
        have = [r[1] for r in db.execute("pragma table_info(emails)")]
    lost = [c for c in ("address", "mailbox", "uidvalidity", "uid", "raw") if c not in have]
    if lost:
        raise SourceSchemaError(f"emails lacks {', '.join(lost)}")
    return have


def value(kind: T.DataType, x: object) -> object:
    if x is None:
        return None
    if isinstance(kind, T.TimestampType):
        when = datetime.fromtimestamp(x, UTC) if isinstance(x, int | float) else datetime.fromisoformat(str(x).replace(" UTC", "+00:00"))
        return (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
    if isinstance(kind, T.BooleanType):
        return x in (1, True, "1", "t", "true")
    if isinstance(kind, T.BinaryType):
        return x if isinstance(x, bytes) else str(x).encode()
    if isinstance(kind, T.LongType):
        return int(x)
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """All messages of the file in the columns of this version; the id is derived from their identity."""
    have = columns_of(path)
    fields = [f for f in EMAILS if f.name in have and f.name not in OWN]
    with opened(path) as db:
        last = db.execute("select coalesce(max(rowid), 0) from emails").fetchone()[0]
    names = ", ".join(f'"{f.name}"' for f in fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in frame["id"]:
                with opened(path) as db:
                    rows = db.execute(f"select {names} from emails where rowid > ? and rowid <= ?", (int(first) * SLICE, (int(first) + 1) * SLICE)).fetchall()
                made = {f.name: pd.Series([value(f.dataType, r[i]) for r in rows], dtype="Int64" if isinstance(f.dataType, T.LongType) else "boolean" if isinstance(f.dataType, T.BooleanType) else "datetime64[ns]" if isinstance(f.dataType, T.TimestampType) else "object") for i, f in enumerate(fields)}
                yield pd.DataFrame(made)

    n = -(-last // SLICE)
    rows = spark.range(0, n, 1, max(1, n)).mapInPandas(run, T.StructType(fields))
    rows = rows.withColumn("size_bytes", F.octet_length("raw").cast("long"))
    for f in EMAILS:
        if f.name not in rows.columns and f.name != "id":
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return with_id(rows).withColumn("parse_error", F.lit(None).cast("string"))
