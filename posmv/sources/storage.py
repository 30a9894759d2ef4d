"""Folders that stand for topics: created, emptied and listed through the file system that Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def ensure(spark: SparkSession, *paths: str, recreate: bool = False) -> list[str]:
    """Make folders that are missing; with recreate, empty those that are there. Returns what was made."""
    made = []
    for path in paths:
        fs, where = _at(spark, path)
        if recreate and fs.exists(where):
            fs.delete(where, True)
        if not fs.exists(where):
            fs.mkdirs(where)
            made.append(path)
    return made
