"""Exact cosine search through a stored index of cells.

Vectors of length one are dealt to the nearest of some centres and stored cell by cell, with
each cell's radius: the widest angle between its centre and one of its vectors. By the triangle
inequality for angles no vector of a cell is closer to a query than the query's angle to the
centre less the radius, so cells that cannot hold a result are neither read nor compared. The
results equal those of :func:`lexivane.operators.search.search_batch` for any centres; how
much is skipped depends on the data: much where vectors cluster, nothing where they have no
structure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexivane.operators import blocks as B
from lexivane.operators.search import MIN_SCORE, TOP_K, Best, _unit
from lexivane.session import cut

MAX_CELLS = 4096  # centres are broadcast
SAMPLE_ROWS = 50_000  # vectors, drawn by a hash of the id, on which centres are fitted
LEAST_QUERIES = 256  # of a panel
SLACK = 1e-6  # on bounds, for the rounding of angles


@dataclass(frozen=True)
class CellSearch:
    """Hits as of ``search_batch``; cells and vectors that were read, and all there are."""

    hits: DataFrame
    cells_read: int
    cells: int
    rows_read: int
    rows: int


def build_cells(
    corpus: DataFrame, path: str, n_cells: int | None = None, id_col: str = "id", vec: str = "embedding", seed: int = 42,
    block_bytes: int = B.BLOCK_BYTES,
) -> None:
    """Write the index of a corpus below ``path``: ``rows`` by cell, and ``centres``.

    By default the number of cells is the square root of that of the vectors, at most
    ``MAX_CELLS``. Vectors that are NULL or of length zero score nowhere and are left out.
    Cells beyond ``block_bytes`` are stored and compared in several parts.
    """
    spark = corpus.sparkSession
    squares = F.aggregate(F.col("embedding"), F.lit(0.0), lambda t, x: t + x * x)
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("embedding").isNotNull() & (squares > 0))
    size = B.extent_of(rows)
    wanted = n_cells or min(MAX_CELLS, max(1, math.isqrt(size.rows)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    if size.rows:
        points = drawn.select(array_to_vector("embedding").alias("features")).persist()
        fitted = KMeans(k=max(2, wanted), seed=seed, maxIter=10, distanceMeasure="cosine").fit(points)
        points.unpersist()
        centres = _unit(np.array(fitted.clusterCenters()))[:wanted]
        centres = centres[np.isfinite(centres).all(axis=1)]
    else:
        centres = np.ones((1, 1))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cosines = _unit(B.as_matrix(batch.column("embedding"))) @ shared.value.T
                cell = cosines.argmax(axis=1)
                best = cosines[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(best)], ["id", "embedding", "cell", "cosine"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = cut(rows.mapInArrow(assign, f"id {kind}, embedding array<double>, cell int, cosine double"))
    per_part = max(1, block_bytes // (8 * max(1, size.dim)))
    about = dealt.groupBy("cell").agg(F.min("cosine").alias("cosine"), F.count("*").alias("n"), F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    about = cut(about)
    part = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    placed = dealt.drop("cosine").join(F.broadcast(about.select("cell", "parts")), "cell").withColumn("part", part).drop("parts")
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known = listed.join(about, "cell", "left").withColumn("id_kind", F.lit(kind))
    known.na.fill({"n": 0, "parts": 1, "cosine": 1.0}).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_cells(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    top_k: int = TOP_K,
    min_score: float = MIN_SCORE,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    block_bytes: int = B.BLOCK_BYTES,
) -> CellSearch:
    """The ``top_k`` rows above ``min_score`` of each query: first from its most promising cell,
    then from all cells whose bound exceeds what was found there."""
    about = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)  # at most MAX_CELLS
    total, id_kind = sum(r.n for r in about), about[0].id_kind
    about = [r for r in about if r.n]
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("embedding"))
    squares = F.aggregate(F.col("embedding"), F.lit(0.0), lambda t, x: t + x * x)
    asked = asked.filter(F.col("embedding").isNotNull() & (squares > 0))
    size = B.extent_of(asked)
    if about and size.rows and len(about[0].centre) != size.dim:
        raise ValueError(f"vectors of {len(about[0].centre)} components cannot be compared with queries of {size.dim}")
    cells = np.array([r.cell for r in about], np.int32)
    centres = np.array([r.centre for r in about]) if about else np.zeros((0, size.dim))
    radii = np.arccos(np.clip([r.cosine for r in about], -1, 1))
    shared = spark.sparkContext.broadcast((cells, centres, radii))
    kind = asked.schema["query_id"].dataType.simpleString()

    def visits(matrix: np.ndarray, need: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which cells (columns) a query (row) must visit."""
        cells, centres, radii = shared.value
        unit, chosen = _unit(matrix), np.zeros((len(matrix), len(cells)), bool)
        for rows in B.tiles(len(matrix), 8 * len(cells)):
            near = np.arccos(np.clip(unit[rows] @ centres.T, -1, 1))
            bound = np.cos(np.maximum(0, near - radii)) + SLACK
            # first round: the nearest centre's cell; then all others that may hold a result
            nearest = np.arange(len(cells)) == near.argmin(axis=1)[:, None]
            there = np.where((first[rows] < 0)[:, None], nearest, cells != first[rows, None])
            chosen[rows] = there & (bound > need[rows, None])
        return chosen

    def listed(waiting: DataFrame, each: bool) -> DataFrame:
        """The cells to visit, of each query or once per batch."""

        def list_cells(batches):
            cells = shared.value[0]
            for batch in batches:
                if batch.num_rows and len(cells):
                    numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("need", "first"))
                    row, col = np.nonzero(visits(B.as_matrix(batch.column("embedding")), *numbers))
                    if not each:
                        col = np.unique(col)
                        row = np.zeros(len(col), np.int64)
                    ids = batch.column("query_id").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cells[col])], ["query_id", "cell"])

        return waiting.select("query_id", "embedding", "need", "first").mapInArrow(list_cells, f"query_id {kind}, cell int")

    def compare(waiting: DataFrame) -> tuple[DataFrame, set[int]]:
        """Panels of queries meet panels of the stored rows; no query is sent to each of its cells."""
        waiting = cut(waiting)
        wanted = {r.cell for r in listed(waiting, False).select("cell").distinct().collect()}
        stored = spark.read.schema(f"id {id_kind}, embedding array<double>, part int, cell int").parquet(f"{path}/rows").where(F.col("cell").isin(sorted(wanted)))  # other cells are not read
        extent = B.Extent(sum(r.n for r in about if r.cell in wanted), size.dim)
        schema = f"query_id {kind}, id {id_kind}, similarity_score double"
        # need and first travel as two further components
        numbered = F.concat("embedding", F.array(F.col("need"), F.col("first").cast("double")))
        panel_bytes = max(8 * (size.dim + 2) * LEAST_QUERIES, min(block_bytes, size.bytes // B.LEAST_PANELS))
        queries = B.panels(waiting.select(F.col("query_id").alias("id"), numbered.alias("embedding")), size, panel_bytes)
        rows = B.panels(stored.select("id", "embedding", F.col("cell").cast("long").alias("code")), extent, block_bytes, in_place=True)

        def begin(panel: B.Panel):
            matrix, need, first = panel.matrix[:, :-2], panel.matrix[:, -2], panel.matrix[:, -1]
            chosen, best = visits(matrix, need, first), Best(panel.ids, _unit(matrix), top_k, min_score)

            def add(other: B.Panel) -> None:
                unit = _unit(other.matrix)
                for cell in np.unique(other.codes):
                    asking, here = np.flatnonzero(chosen[:, np.searchsorted(shared.value[0], cell)]), other.codes == cell
                    if len(asking):
                        best.meet(other.ids[here], unit[here], asking)

            def end() -> pa.RecordBatch:
                found = best.found()
                # what cannot be among the best of its query any more stays here
                good = found["similarity_score"] >= need[best.row]
                return pa.RecordBatch.from_pydict({name: column[good] for name, column in found.items()})

            return add, end

        return cut(B.meet(queries, rows, extent, begin, schema)), wanted

    opening, seen = compare(asked.withColumn("need", F.lit(float(min_score))).withColumn("first", F.lit(-1)))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity_score"), "id")
    ranked = opening.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    # a cell must be able to beat or, as ids break ties, to equal the worst place of a full list
    reached = ranked.filter(F.col("rank") == top_k).select("query_id", (F.col("similarity_score") - 2 * SLACK).alias("reached"))
    started = cut(listed(asked.withColumn("need", F.lit(-2.0)).withColumn("first", F.lit(-1)), True)).select("query_id", F.col("cell").alias("first"))
    waiting = asked.join(started, "query_id").join(reached, "query_id", "left")
    need = F.greatest(F.lit(float(min_score)), F.coalesce("reached", F.lit(float(min_score))))
    others, more = compare(waiting.withColumn("need", need).select("query_id", "embedding", "need", "first"))
    hits = opening.unionByName(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    read = seen | more
    return CellSearch(
        hits.select("query_id", "rank", "id", "similarity_score"), len(read), len(about), sum(r.n for r in about if r.cell in read), total
    )
