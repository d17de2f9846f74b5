"""Small file-system steps that Spark's writers have no word for, through Hadoop's file systems.

Any scheme that Spark reads works. Only names and a few bytes pass here, never table data.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def depth(spark: SparkSession, path: str) -> int:
    """How many folders deep a path is, counted from the root of its file system."""
    where, fs = _at(spark, path)
    return fs.makeQualified(where).depth()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with ``text``; false if it exists already.

    The test and the creation are one step of the file system (on object stores without one, two writers can
    both succeed; such a store needs a lock of its own). A reader may see the file empty for a moment.
    """
    where, fs = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as failure:
        if fs.exists(where):
            return False
        raise failure
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None if it is absent."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is absent."""
    where, fs = _at(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or a folder with all it holds; false if it is absent."""
    where, fs = _at(spark, path)
    return fs.delete(where, True)
