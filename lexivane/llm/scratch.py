"""Scratch tables below the shared folder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, through Spark's own file systems."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
