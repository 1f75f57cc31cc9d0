"""A stored table of row-wise results that follows its input: only changed rows are computed anew.

Each version is a folder of rows with the digest of what they were made from. An update joins the
digests of the input with those of the last version; rows with the same digest are carried over,
new and changed ones are computed, rows that are gone are left out. A version counts once its
folder is complete, so an update that was cut short is simply made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest complete version below ``path``; 0 if there is none."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(fs_path(f"{path}/version=*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)


def update_rows(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    id_col: str = "id",
    made_by: str = "",
) -> DataFrame:
    """``compute`` of every row of ``source``, written as the next version and returned with the
    version that each row was computed in as ``computed_in``.

    ``compute`` keeps one row per row and the id. Its result for a row may depend on that row
    alone; what else it depends on (a model, its settings) is named by ``made_by``, and all rows are
    computed again when that name changes. Ids must be unique and not NULL.
    """
    others = [c for c in source.columns if c != id_col]
    digest = F.sha2(F.to_json(F.struct(F.lit(made_by).alias("_made_by"), *others), {"ignoreNullFields": "false"}), 256)
    keyed = source.withColumn("_digest", digest)
    version = latest_version(spark, path)
    if version:
        old = spark.read.parquet(f"{path}/version={version}")
        known = old.select(F.col(id_col), "_digest")
        fresh = keyed.join(known, [id_col, "_digest"], "left_anti")
        kept = old.join(keyed.select(id_col, "_digest"), [id_col, "_digest"], "left_semi")
    else:
        fresh, kept = keyed, None
    made = compute(fresh.drop("_digest")).join(fresh.select(id_col, "_digest"), id_col)
    made = made.withColumn("computed_in", F.lit(version + 1))
    table = made if kept is None else made.unionByName(kept)
    target = f"{path}/version={version + 1}"
    table.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).drop("_digest")
