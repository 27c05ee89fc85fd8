"""Small files and folders on any file system that Spark knows, by its own client on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    files, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def create(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there already is an error."""
    files, where = _at(spark, path)
    files.create(where, False).close()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds."""
    files, where = _at(spark, path)
    files.delete(where, True)
