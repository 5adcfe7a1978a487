"""Small files through Hadoop's file systems, so an index may lie wherever Spark can write."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession

from ..errors import AlreadyExists


# Hadoop's names of stores and the names by which Arrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened(uri: str):
    """(Arrow file system, path) of a path as Spark writes it, for Python workers."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition(":")
    if not sep:
        return fs.FileSystem.from_uri(uri)
    rest = "//" + rest if rest.startswith("/") and not rest.startswith("//") else rest
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def create(self, path: str, data: bytes) -> None:
        """Exclusive and whole: the bytes go to a hidden file that is then renamed; an existing target is refused."""
        fs, p = self._at(path)
        if fs.exists(p):
            raise AlreadyExists(path)
        hidden = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        try:
            stream.write(data)
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(hidden, p, how)
        except Py4JJavaError as e:
            fs.delete(hidden, False)
            if "exist" in str(e.java_exception).lower():
                raise AlreadyExists(path) from e
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
