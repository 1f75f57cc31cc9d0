"""Silhouette of a large set from a sample of each label, with bounds of its error.

Some rows of every label, drawn by a hash of the id, get their exact silhouette against all
rows, which takes time linear in the rows. The mean of the labels' means, weighted by the
labels' rows, estimates the silhouette of the whole set without bias; the spread inside the
labels gives its standard error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivane.operators import blocks as B
from lexivane.operators.labels import encode_labels
from lexivane.operators.quality import _checked, _label_sums

PER_LABEL = 200
Z = 2.576  # standard errors to either side: 99 % of all samples
CELLS = 4_000_000  # sums (drawn row by label) that a task holds


def silhouette_interval(
    df: DataFrame,
    per_label: int = PER_LABEL,
    z: float = Z,
    id_col: str = "id",
    vec: str = "embedding",
    label: str = "label",
    broadcast_bytes: int = B.BROADCAST_BYTES,
    cells: int = CELLS,
    seed: int = 42,
) -> DataFrame:
    """One row ``silhouette, low, high, rows_drawn, rows``.

    Rows without vector or label are left out, a row alone under its label scores 0, as in
    :func:`lexivane.operators.quality.silhouette`; with ``per_label`` rows or fewer under every
    label the result is exact. Drawn rows are broadcast in chunks of bounded size, and all
    rows are scanned once per chunk.
    """
    if per_label < 2:
        raise ValueError("per_label must be at least 2")
    coded = encode_labels(
        df.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"), F.col(label).alias("label"))
        .filter(F.col("embedding").isNotNull() & F.col("label").isNotNull()),
        "label",
        "code",
    ).select("id", "embedding", "code")
    counts = coded.groupBy("code").agg(F.count("*").alias("n"))
    order = W.partitionBy("code").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    drawn = coded.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_label).drop("_n")
    size, n_labels = B.extent_of(drawn), counts.count()
    n_chunks = max(size.blocks(broadcast_bytes), -(-size.rows * n_labels // cells), 1)
    sums = reduce(DataFrame.unionByName, [_sums(coded, drawn.filter(B.block_id("id", n_chunks) == i)) for i in range(n_chunks)])
    total = sums.groupBy("id", "own", "code").agg(F.sum("total").alias("total")).join(counts, "code")
    same = F.col("own") == F.col("code")
    scored = total.groupBy("id", "own").agg(
        F.max(F.when(same, F.try_divide("total", F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b")
    )
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    strata = scored.groupBy(F.col("own").alias("code")).agg(F.avg(score).alias("mean"), F.coalesce(F.var_samp(score), F.lit(0.0)).alias("var"), F.count("*").alias("m"))
    joined = strata.join(counts, "code")
    n, m = F.col("n"), F.col("m")
    whole = joined.agg(F.sum("n").alias("rows"), F.sum("m").alias("rows_drawn"), F.count("*").alias("k"),
                       F.sum(n * F.col("mean")).alias("s"), F.sum(n * n * F.col("var") / m * (1 - m / n)).alias("v"))
    value = F.col("s") / F.col("rows")
    error = z * F.sqrt("v") / F.col("rows")
    checked = _checked(F.col("k"), F.col("rows"), value)
    return whole.select(checked.alias("silhouette"), (checked - error).alias("low"), (checked + error).alias("high"), "rows_drawn", "rows")


def _sums(coded: DataFrame, drawn: DataFrame) -> DataFrame:
    """Sum of distances from each drawn row to the rows of each label, per task."""
    table = drawn.toArrow()
    kind = coded.schema["id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(
        (table["id"].to_numpy(), B.as_matrix(table["embedding"]), table["code"].to_numpy()) if table.num_rows else None
    )

    def measure(batches):
        if shared.value is None:
            return
        ids, matrix, own = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                codes = batch.column("code").to_numpy(zero_copy_only=False)
                others = batch.column("id").to_numpy(zero_copy_only=False)
                labels, sums = _label_sums(ids, matrix, others, B.as_matrix(batch.column("embedding")), codes)
                for code, column in zip(labels.tolist(), sums.T):
                    held[code] = held[code] + column if code in held else column
        for code, column in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(own), pa.array(np.full(len(ids), code)), pa.array(column)], ["id", "own", "code", "total"]
            )

    return coded.mapInArrow(measure, f"id {kind}, own long, code long, total double")
