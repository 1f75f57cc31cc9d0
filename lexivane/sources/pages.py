"""Tables of already fetched web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Scan fetched pages; with a ``status`` column only bodies of status 200 are kept."""
    pages = spark.read.parquet(path)
    return pages if status is None else pages.filter(F.col(status) == 200)
