"""Idempotent writes of the emails table, partitioned by address and mailbox."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import IDENTITY, VERSION, migrated

#: Where a table keeps its schema version; Spark passes over names that begin with an underscore.
VERSION_FILE = "_courierlake.json"
STAGED = ".staged-"


class IngestError(Exception):
    """A strict run met a message that it could not read."""


class SchemaVersionError(Exception):
    """The table was written by a newer version."""


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    files, p = hadoop_path(spark, path)
    files.delete(p, True)


def version(spark: SparkSession, path: str) -> int | None:
    """The schema version that the table says it has."""
    files, p = hadoop_path(spark, f"{path.rstrip('/')}/{VERSION_FILE}")
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"]
    finally:
        stream.close()


def mark(spark: SparkSession, path: str) -> None:
    """Write the schema version beside the data, once."""
    if version(spark, path) == VERSION:
        return
    files, p = hadoop_path(spark, f"{path.rstrip('/')}/{VERSION_FILE}")
    out = files.create(p, True)
    out.write(bytearray(json.dumps({"version": VERSION}).encode()))
    out.close()


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path in this version's columns, or None if there is none yet or nothing is left of it."""
    files, p = hadoop_path(spark, path)
    if not files.exists(p):
        return None
    have = version(spark, path)
    if have is not None and have > VERSION:
        raise SchemaVersionError(f"{path} has schema version {have}, this is {VERSION}")
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    return migrated(found)


def unseen(rows: DataFrame, have: DataFrame | None) -> DataFrame:
    """Messages whose identity is not stored."""
    return rows if have is None else rows.join(have.select(*IDENTITY), list(IDENTITY), "left_anti")


def latest(rows: DataFrame, *first: str) -> DataFrame:
    """One row of each identity: by the named columns, then the latest receive time, then the bytes."""
    order = Window.partitionBy(*IDENTITY).orderBy(*(F.desc(c) for c in first), F.desc("internaldate_epoch"), F.md5("raw"))
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", *first)


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Overwrite the partitions of rows by way of a staged copy, so a plan may read what it replaces.

    The copy goes when its rows are in place. If they can't be written, it stays, and
    restore() puts them in place later.
    """
    staged = f"{path.rstrip('/')}{STAGED}{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    put(spark, staged, path)


def put(spark: SparkSession, staged: str, path: str) -> None:
    """Overwrite the partitions that a staged copy has rows for, then drop the copy."""
    try:
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("address", "mailbox").parquet(path)
    except Exception as e:
        raise IngestError(f"{path} may be incomplete; its rows are in {staged}, and restore() puts them back") from e
    delete(spark, staged)


def restore(spark: SparkSession, path: str) -> int:
    """Put in place the whole staged copies that failed runs left beside the table at path; returns how many."""
    files, p = hadoop_path(spark, path)
    found = [str(f.getPath()) for f in files.globStatus(hadoop_path(spark, f"{path.rstrip('/')}{STAGED}*")[1]) or []]
    n = 0
    for staged in found:
        if files.exists(hadoop_path(spark, f"{staged}/_SUCCESS")[1]):
            put(spark, staged, path)
            n += 1
        else:  # never finished, and nothing was overwritten
            delete(spark, staged)
    return n


def upsert(rows: DataFrame, path: str, recreate: bool = False, strict: bool = False) -> None:
    """Add messages that are not stored; with recreate, the new version of a stored one wins.

    New messages are appended and nothing that is stored is read but its
    identities; only recreate rewrites the partitions that get rows. compact()
    joins the files that many small appends leave.
    """
    spark = rows.sparkSession
    if strict and not rows.where("parse_error is not null").isEmpty():
        raise IngestError("a message could not be read")
    have = stored(spark, path)
    if have is None or not recreate:
        latest(unseen(rows, have)).write.mode("append").partitionBy("address", "mailbox").parquet(path)
    else:
        old = have.join(rows.select("address", "mailbox").distinct(), ["address", "mailbox"], "left_semi")
        both = old.withColumn("version", F.lit(0)).unionByName(rows.withColumn("version", F.lit(1)), allowMissingColumns=True)
        replace(spark, latest(both, "version"), path)
    mark(spark, path)


def compact(spark: SparkSession, path: str, most: int = 16) -> int:
    """Rewrite partitions of more than `most` files, one address and mailbox as few files each; returns how many partitions."""
    have = stored(spark, path)
    if have is None:
        return 0
    files = have.select("address", "mailbox", F.input_file_name().alias("file")).distinct()
    many = [(r["address"], r["mailbox"]) for r in files.groupBy("address", "mailbox").count().where(F.col("count") > most).collect()]
    for address, mailbox in many:
        here = have.where((F.col("address") == address) & (F.col("mailbox") == mailbox))
        replace(spark, here.repartition(F.floor(F.col("uid") / 100_000)), path)
    return len(many)


def purge(spark: SparkSession, path: str, address: str, mailbox: str, uidvalidity: int) -> int:
    """Drop one generation of a folder, and a partition left empty; returns how many messages went."""
    have = stored(spark, path)
    if have is None:
        return 0
    here = have.where((F.col("address") == address) & (F.col("mailbox") == mailbox))
    gone = here.where(F.col("uidvalidity") == uidvalidity).count()
    left = here.where(F.col("uidvalidity") != uidvalidity)
    if not gone:
        return 0
    if left.isEmpty():
        part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        delete(spark, f"{path}/address={part.escapePathName(address)}/mailbox={part.escapePathName(mailbox)}")
    else:
        replace(spark, left, path)
    return gone
