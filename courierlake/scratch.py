"""The shared folder that derived tables live in, and tables kept there by what they were made from."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="courierlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def kept(spark: SparkSession, kind: str, sources: list[str], make: Callable[[str], None]) -> str:
    """A folder made from the files of sources by make(folder); made once for their present names, sizes and times.

    make() works in a folder of its own name, which gets its final name when it
    is done: a folder that is there is whole, and of two at once the first counts.
    """
    told = []
    for source in sources:
        files, p = files_of(spark, source)
        listed = files.listFiles(p, True)
        while listed.hasNext():
            f = listed.next()
            told.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    name = hashlib.sha256("\n".join([kind, *sorted(told)]).encode()).hexdigest()[:32]
    path = f"{scratch_dir(spark)}/{kind}-{name}"
    own, done = files_of(spark, path)
    if not own.exists(done):
        begun = f"{path}.{uuid.uuid4().hex}"
        make(begun)
        _, at = files_of(spark, begun)
        if own.exists(done) or not own.rename(at, done):
            own.delete(at, True)
    return path
