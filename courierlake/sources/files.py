"""Files in a folder that driver and executors share, by way of Arrow's file systems."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared(spark: SparkSession, path: str) -> str:
    """The whole address of a path, as Arrow opens it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", whole)


class Folder:
    def __init__(self, address: str) -> None:
        self.files, self.path = pafs.FileSystem.from_uri(address)

    def names(self) -> set[str]:
        found = self.files.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return {f.base_name for f in found if f.type == pafs.FileType.File}

    def holds(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.path}/{name}").type == pafs.FileType.File

    def write(self, name: str, data: bytes) -> None:
        """Write under a temporary name and rename, so that a reader sees all of a file or nothing."""
        self.files.create_dir(self.path, recursive=True)
        part = f"{self.path}/.{name}.{uuid.uuid4().hex}.tmp"
        try:
            with self.files.open_output_stream(part, compression=None) as f:
                f.write(data)
            self.files.move(part, f"{self.path}/{name}")
        except BaseException:
            if self.files.get_file_info(part).type == pafs.FileType.File:
                self.files.delete_file(part)
            raise
