"""What the corpus operators have in common: scratch tables and bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir

#: Text bytes that a Python worker handles at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Spark drops the shuffle files of a finished execution if this is true.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch between Spark and a Python worker; each is held several times on both sides.
ARROW_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Scratch folders and tables of the settled() call in progress; each thread has its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession, kind: str = "cut") -> str:
    """A new name in the shared folder."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    Spark drops the job's shuffle files when it ends, so that the phases of an
    operator never hold disk together.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.rsplit("/", 1)[1].startswith("cut-"):
            delete(df.sparkSession, name)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a table in the shared folder; everything else that it left there is deleted, and all of it if it fails.

    Calls may be nested, and other threads may make calls of their own.
    """
    outer, own = _made.get(), []
    token = _made.set(own)
    kept = None
    try:
        out = cut(make())
        kept = own[-1]
    finally:
        _made.reset(token)
        for name in own:
            if name != kept:
                delete(spark, name)
    if outer is not None:
        outer.append(kept)
    return out


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ARROW_BYTES: Spark's own bound is sixteen times that, and texts reach it."""
    spark.conf.set(BATCHES, str(ARROW_BYTES))


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """The columns an operator reads, whatever else the table has; a null text is empty."""
    small_batches(df.sparkSession)
    return df.select(
        *([df[carry]] if carry else []),
        df[key].cast("long").alias("doc_id"),
        F.coalesce(df[text].cast("string"), F.lit("")).alias("text"),
    )


KEY = ["doc_id", "twin"]


def told_apart(docs: DataFrame, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows as id_text() with `twin`, which tells rows of one doc_id with other texts apart; and rows with a doc_id, equal ones once.

    Where no doc_id repeats, twin is 0. Otherwise it is a hash of the text, and
    only texts whose row repeats are shuffled to be kept once.
    """
    own = id_text(docs, carry=carry)
    if own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        own = own.withColumn("twin", F.lit(0).cast("long"))
        return own, own.where("doc_id is not null").select(*KEY, "text")
    own = own.withColumn("twin", F.xxhash64("text"))
    known = own.where("doc_id is not null").select(*KEY, "text")
    again = cut(known.groupBy(*KEY).count().where("count > 1").select(*KEY))
    if again.isEmpty():
        return own, known
    once = known.join(again, KEY, "left_anti")
    return own, cut(once.unionByName(known.join(again, KEY, "left_semi").dropDuplicates(KEY)))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named column holds about `most` bytes in each."""
    for batch in batches:
        values = batch.column(column)
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(values).to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
