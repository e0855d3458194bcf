"""Small file operations on whatever file system a path lives on (local, HDFS, object store)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def read_line(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def write_line(spark: SparkSession, path: str, line: str, replace: bool = False) -> bool:
    """Write a one-line file; False, and nothing written, if there is one already (unless ``replace``).

    Of several writers at once one creates the file: no rename is needed, only that creating a file
    fails where it exists, as on HDFS, local disks and object stores with conditional writes.
    """
    try:
        stream = _fs(spark, path).create(_path(spark, path), replace)
    except Py4JJavaError as failure:
        if not replace and exists(spark, path):
            return False
        raise failure
    try:
        stream.write(bytearray((line + "\n").encode()))
    finally:
        stream.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    return sorted(f.getPath().getName() for f in _fs(spark, folder).listStatus(_path(spark, folder)))


def remove(spark: SparkSession, path: str) -> None:
    """Remove one file."""
    _fs(spark, path).delete(_path(spark, path), False)


class NumberedLines:
    """A one-line value that changes by writing the next numbered file; the largest number counts.

    A file is never changed: a reader sees the old value or the new one, and of two writers that
    follow the same value one wins. A file left empty by a writer that died is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def latest(self) -> tuple[int, str | None]:
        """(number of the last file, the value in force); (0, None) at first."""
        found = [n for n in names(self.spark, self.folder) if n.isdigit()]
        for name in reversed(found):
            line = read_line(self.spark, f"{self.folder}/{name}")
            if line:
                return int(found[-1]), line
        return (int(found[-1]) if found else 0), None

    def follow(self, number: int, line: str) -> bool:
        """Write the value after file ``number``; False if another writer has done so."""
        return write_line(self.spark, f"{self.folder}/{number + 1:012d}", line)

    def forget_before(self, number: int) -> None:
        """Remove files that no longer count, so that the folder stays small."""
        for name in names(self.spark, self.folder):
            if name.isdigit() and int(name) < number:
                remove(self.spark, f"{self.folder}/{name}")
