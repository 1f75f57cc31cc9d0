"""Quality of a labelled vector set: F1, silhouette, Calinski-Harabasz, reconstruction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.vectors import vec_sqdist
from lexivane.operators import blocks as B
from lexivane.operators.labels import encode_labels
from lexivane.schemas import METRICS

# Fixed value: the axis scale of the one metric that is not of order one.
CALINSKI_SCALE = 1000

# Distances taken together: a few hundred kilobytes of them.
TILE_ROWS, TILE_COLUMNS = 128, 1024

# Sums (row by label) that a task holds before it sends them on.
HELD_SUMS = 4_000_000


def reconstruction_mse(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared component error, as one row ``mse``."""
    return df.agg(F.avg(vec_sqdist(a, b) / F.size(a)).alias("mse"))


def weighted_f1(df: DataFrame, label: str = "label", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Support-weighted F1 over long ``(label, truth 0/1, pred 0/1)`` rows, as one row ``f1``."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    counts = df.groupBy(label).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    support = (tp + fn).cast("double")
    weighted = F.try_divide(F.sum(f1 * support), F.sum(support))
    return counts.agg(F.coalesce(weighted, F.lit(0.0)).alias("f1"))


def _checked(clusters, rows, value):
    """Cluster scores need 2 to n-1 clusters."""
    message = "a cluster score needs between 2 and n-1 labels"
    bad = (clusters < 2) | (clusters > rows - 1)
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def calinski_harabasz(df: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Between-to-within dispersion ratio, as one row ``calinski``.

    One pass with a summary per label (combined map-side, so a dominant label is no
    hot spot), then a second aggregation over the labels alone.
    """
    summary = Summarizer.metrics("count", "mean", "variance").summary(
        array_to_vector(F.col(vec).cast("array<double>"))
    )
    per_label = df.groupBy(label).agg(summary.alias("s")).select(
        F.col("s.count").cast("double").alias("n"),
        F.col("s.mean").alias("mean"),
        F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda t, x: t + x).alias("spread"),
    )
    # sum(n * |mean - grand mean|^2), read off the weighted variance of the label means,
    # which the summary divides by (sum(n) - sum(n^2) / sum(n)).
    means = Summarizer.metrics("variance").summary(F.col("mean"), F.col("n"))
    totals = per_label.agg(
        means.alias("m"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum((F.col("n") - 1) * F.col("spread")).alias("within"),
    )
    k, n, w = F.col("clusters"), F.col("rows"), F.col("within")
    scatter = F.aggregate(vector_to_array("m.variance"), F.lit(0.0), lambda t, x: t + x)
    between = scatter * (n - F.col("squares") / n)
    ratio = F.when(w == 0, F.lit(1.0)).otherwise((between / (k - 1)) / (w / (n - k)))
    return totals.select(_checked(k, n, ratio).alias("calinski"))


def silhouette_rows(
    df: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    label: str = "label",
    broadcast_bytes: int = B.BROADCAST_BYTES,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """Exact Euclidean silhouette of every row: ``(id, label, silhouette)``.

    Distances are summed per label inside the block that computes them; only
    ``(row, label)`` sums leave a task. A row alone under its label scores 0.
    """
    coded = encode_labels(
        df.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"), F.col(label).alias("label"))
        .filter(F.col("embedding").isNotNull() & F.col("label").isNotNull()),
        "label",
        "code",
    )
    size = B.extent_of(coded)
    kind = coded.schema["id"].dataType
    sums_schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("own", T.LongType()),
            T.StructField("code", T.LongType()),
            T.StructField("total", T.DoubleType()),
        ]
    )
    if size.fits(broadcast_bytes):
        return _silhouette_scan(coded, kind)
    panels = B.panels(coded, size, block_bytes)
    # Placed by id once, all that follows stays within a partition.
    sums = B.meet(panels, panels, size, _gather_sums, sums_schema).repartition("id")
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"))
    per_label = sums.groupBy("id", "own", "code").agg(F.sum("total").alias("total")).join(counts, "code")
    own = F.col("own") == F.col("code")
    mean_own = F.max(F.when(own, F.try_divide("total", F.col("n") - 1)))
    mean_other = F.min(F.when(~own, F.col("total") / F.col("n")))
    by_row = per_label.groupBy("id").agg(
        F.max(F.when(own, F.col("label"))).alias("label"), mean_own.alias("a"), mean_other.alias("b")
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return by_row.select("id", "label", F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def silhouette(
    df: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    label: str = "label",
    mode: str = "exact",
    **limits: int,
) -> DataFrame:
    """Mean silhouette, as one row ``silhouette``.

    ``exact`` uses Euclidean distances and takes time quadratic in the rows. ``fast`` is
    Spark's evaluator: squared distances, for which label summaries suffice, so it is
    linear; its values differ from the exact ones.
    """
    if mode == "fast":
        coded = encode_labels(df, label, "_code").select(
            array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
            F.col("_code").cast("double").alias("prediction"),
        )
        value = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(coded)
        return df.sparkSession.createDataFrame([(value,)], "silhouette double")
    if mode != "exact":
        raise ValueError(f"unknown silhouette mode {mode!r}")
    rows = silhouette_rows(df, id_col, vec, label, **limits)
    # Labels are counted through their combined groups, not as a distinct over rows.
    per_label = rows.groupBy("label").agg(F.sum("silhouette").alias("s"), F.count(F.lit(1)).alias("n"))
    totals = per_label.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return totals.select(_checked(F.col("k"), F.col("n"), F.col("s") / F.col("n")).alias("silhouette"))


class LabelSums:
    """Rows in label order, ready for the sum of distances from others to those of each label."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, codes: np.ndarray):
        order = np.argsort(codes, kind="stable")
        matrix = matrix[order]
        self.labels, self.starts = np.unique(codes[order], return_index=True)
        self.right = np.vstack([matrix.T, (matrix**2).sum(axis=1), np.ones(len(ids))])
        ids = ids[order]
        self.by_id = np.argsort(ids, kind="stable")
        self.ids = ids[self.by_id]

    @staticmethod
    def left(matrix: np.ndarray) -> np.ndarray:
        """What ``of`` multiplies by: the same for all others that a matrix meets."""
        return np.hstack([-2.0 * matrix, np.ones((len(matrix), 1)), (matrix**2).sum(axis=1, keepdims=True)])

    def of(self, ids: np.ndarray, matrix: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
        """One row per id, one column per label; the distance of a row to itself is 0."""
        left = self.left(matrix) if left is None else left
        lo = np.searchsorted(self.ids, ids, side="left")
        times = np.where(ids == ids, np.searchsorted(self.ids, ids, side="right") - lo, 0)
        r = np.repeat(np.arange(len(ids)), times)
        c = self.by_id[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(len(r))]
        sums = np.zeros((len(ids), len(self.labels)))
        for begin in range(0, self.right.shape[1], TILE_COLUMNS):
            end = min(self.right.shape[1], begin + TILE_COLUMNS)
            part = np.ascontiguousarray(self.right[:, begin:end])
            first = int(np.searchsorted(self.starts, begin, side="right")) - 1
            last = int(np.searchsorted(self.starts, end, side="left"))
            cuts = np.maximum(self.starts[first:last] - begin, 0)
            here = (c >= begin) & (c < end)
            own_r, own_c = r[here], c[here] - begin
            for start in range(0, len(ids), TILE_ROWS):
                distance = left[start : start + TILE_ROWS] @ part
                np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
                own = slice(*np.searchsorted(own_r, [start, start + TILE_ROWS]))
                distance[own_r[own] - start, own_c[own]] = 0.0
                sums[start : start + TILE_ROWS, first:last] += np.add.reduceat(distance, cuts, axis=1)
        return sums


def _label_sums(ids, matrix, other_ids, other, codes, left=None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of distances from each row to the rows of each label in ``other``."""
    sums = LabelSums(other_ids, other, codes)
    return sums.labels, sums.of(ids, matrix, left)


def _gather_sums(panel: B.Panel):
    """Sums of a panel's rows over the panels it meets; many labels are sent in parts."""
    held: dict[int, np.ndarray] = {}
    left = LabelSums.left(panel.matrix)

    def end() -> pa.RecordBatch:
        codes = np.array(list(held), np.int64)
        totals = np.concatenate(list(held.values())) if held else np.empty(0)
        columns = [np.tile(panel.ids, len(codes)), np.tile(panel.codes, len(codes)), np.repeat(codes, len(panel.ids)), totals]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "own", "code", "total"])

    def add(other: B.Panel) -> pa.RecordBatch | None:
        labels, sums = _label_sums(panel.ids, panel.matrix, other.ids, other.matrix, other.codes, left)
        for code, column in zip(labels.tolist(), sums.T):
            held[code] = held[code] + column if code in held else column
        return end() if len(held) * len(panel.ids) > HELD_SUMS else None

    return add, end


def _silhouette_scan(coded: DataFrame, kind: T.DataType) -> DataFrame:
    """The whole set fits in a broadcast: every task scores its own rows."""
    table = coded.select("id", "embedding", "code").toArrow()
    codes = table["code"].to_numpy()
    shared = coded.sparkSession.sparkContext.broadcast(
        (LabelSums(table["id"].to_numpy(), B.as_matrix(table["embedding"]), codes), np.unique(codes, return_counts=True)[1])
    )
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("label", coded.schema["label"].dataType),
            T.StructField("silhouette", T.DoubleType()),
        ]
    )

    def score(batches):
        others, counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            own = np.searchsorted(others.labels, batch.column("code").to_numpy(zero_copy_only=False))
            sums = others.of(ids, B.as_matrix(batch.column("embedding")))
            at = np.arange(len(ids))
            with np.errstate(invalid="ignore", divide="ignore"):
                a = sums[at, own] / (counts[own] - 1)
                means = sums / counts
                means[at, own] = np.inf
                b = means.min(axis=1)
                s = (b - a) / np.maximum(a, b)
            s = np.where(counts[own] > 1, np.nan_to_num(s), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(s)], schema.names
            )

    return B.spread(coded.select("id", "embedding", "label", "code")).mapInArrow(score, schema)


def melt_metrics(df: DataFrame) -> DataFrame:
    """One row per vector set and metric."""
    return df.unpivot("name", ["f1", "silhouette", "calinski"], "Metric", "Score")


def rescale_metric(df: DataFrame, metric: str = "calinski", divisor: float = CALINSKI_SCALE) -> DataFrame:
    """Divide the scores of one metric, leaving the others."""
    scaled = F.when(F.col("Metric") == metric, F.col("Score") / divisor).otherwise(F.col("Score"))
    return df.withColumn("Score", scaled)


def compare_spaces(
    spaces: dict[str, DataFrame], id_col: str = "id", vec: str = "embedding", label: str = "label", mode: str = "exact"
) -> DataFrame:
    """Silhouette and Calinski-Harabasz of each vector set, unscaled: ``(name, silhouette, calinski)``.

    ``mode`` is that of :func:`silhouette`.
    """
    rows = []
    for name, df in spaces.items():
        s = silhouette(df, id_col, vec, label, mode=mode).select(F.lit("silhouette").alias("m"), F.col("silhouette").alias("v"))
        c = calinski_harabasz(df, vec, label).select(F.lit("calinski").alias("m"), F.col("calinski").alias("v"))
        rows.append(s.unionByName(c).withColumn("name", F.lit(name)))
    table = rows[0]
    for other in rows[1:]:
        table = table.unionByName(other)
    return table.groupBy("name").agg(
        F.max(F.when(F.col("m") == "silhouette", F.col("v"))).alias("silhouette"),
        F.max(F.when(F.col("m") == "calinski", F.col("v"))).alias("calinski"),
    )


def metrics_row(spark, name: str, f1: float, silhouette: float, calinski: float) -> DataFrame:
    return spark.createDataFrame([(name, float(f1), float(silhouette), float(calinski))], METRICS)
