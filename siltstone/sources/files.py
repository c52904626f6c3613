"""Small files and folders through Hadoop's file systems, so collections live wherever Spark can read."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Schemes of stores that show an object only when it is whole.
OBJECT_STORES = {"s3a", "s3", "gs", "oss", "cosn", "obs", "swift"}


class Files:
    """The file system that holds ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        self._bytes = spark.sparkContext._jvm.java.io.ByteArrayOutputStream
        #: Why a commit could not be written; from then on whether it stands is unknown, so there are no more writes.
        self.broken = ""

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, folder: str) -> int:
        """Bytes under a folder; 0 if it doesn't exist."""
        path = self._path(folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def read(self, path: str) -> str:
        """The text of a file."""
        source, out = self._fs.open(self._path(path)), self._bytes()
        self._io.copyBytes(source, out, 65536, True)
        return out.toString("UTF-8")

    def create(self, path: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one already, so of two writers one wins.

        Where files show before they are closed, the text is written beside first and then gets its name, which fails where
        there is such a file. Object stores show an object once it is whole and may copy on a rename: there the name itself
        is created, not to be replaced.
        """
        data, target = bytearray(text.encode()), self._path(path)
        try:
            scheme = self._fs.getUri().getScheme()
            if scheme in OBJECT_STORES:
                return self._exclusive(target, data)
            beside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
            self._write(self._fs.create(beside, True), data)
            made = self._link(beside, path) if scheme == "file" else not self._fs.exists(target) and self._fs.rename(beside, target)
            if self._fs.exists(beside):
                self._fs.delete(beside, False)
        except Exception as e:
            self.broken = str(e)[:300]
            raise
        return made

    @staticmethod
    def _write(out, data: bytearray) -> None:
        out.write(data)
        out.close()

    def _exclusive(self, target, data: bytearray) -> bool:
        try:
            self._write(self._fs.create(target, False), data)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _link(self, beside, path: str) -> bool:
        """On a local file system a rename would replace; a second name for the file never does."""
        try:
            os.link(beside.toUri().getPath(), self._path(path).toUri().getPath())
        except FileExistsError:
            return False
        return True

    def remove(self, path: str) -> bool:
        """Deletes a file or folder with all it holds."""
        return self._fs.delete(self._path(path), True)
