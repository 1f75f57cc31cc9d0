"""Dense vector blocks: the shared ground of search, neighbour graph and silhouette.

Work over pairs of rows is done as matrix products inside Arrow batches, and only the
reduced result (k best, sums per label) leaves a task. Two plans are offered:

* one side small (size checked against ``BROADCAST_BYTES``): it is broadcast and the
  other side is scanned where it lies, however large it is;
* otherwise both sides are packed into panels of bounded size by a hash of the id, which are
  checkpointed once; every panel of one side meets all panels of the other, one after the
  other. No vector is shuffled again, however many panels there are, and no key of the data
  decides the placement, so skewed labels or copies cannot make a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import cut

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
TILE_CELLS = 4 * 1024 * 1024

# A panel: its vectors as doubles, and how many there should be at least to occupy the cores.
PANEL_BYTES = 2 * 1024 * 1024
LEAST_PANELS = 32
# Panels of the other side that a task goes through.
SIDE_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Extent:
    """Number of vectors and their common dimension."""

    rows: int
    dim: int

    @property
    def bytes(self) -> int:
        return self.rows * self.dim * 8

    def fits(self, limit: int) -> bool:
        return self.bytes <= limit

    def blocks(self, block_bytes: int) -> int:
        return max(1, -(-self.bytes // block_bytes))


def extent_of(df: DataFrame, vec: str = "embedding") -> Extent:
    """Count the vectors and check that they agree in dimension (one partial aggregation)."""
    row = df.agg(
        F.count(vec).alias("n"), F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")
    ).first()
    if row.n and row.lo != row.hi:
        raise ValueError(f"vectors of {row.lo} to {row.hi} components cannot be compared")
    return Extent(row.n, row.hi or 0)


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column to a (rows, dim) matrix of doubles; NULLs and mixed widths are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pc.list_value_length(column)
    if column.null_count or len(column) and pc.min(widths) != pc.max(widths):
        raise ValueError("vectors must not be NULL and must agree in width")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_lists(matrix: np.ndarray) -> pa.Array:
    """A (rows, dim) matrix to a list column."""
    rows, dim = matrix.shape
    offsets = np.arange(0, rows * dim + 1, dim, dtype=np.int32) if dim else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def tiles(rows: int, columns: int) -> Iterator[slice]:
    """Row slices that keep a score matrix within ``TILE_CELLS``."""
    step = max(1, TILE_CELLS // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Even out a small table over all cores, for work that is heavy per row.

    Only for tables that passed a size check: what is moved is bounded by it.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def block_id(key: str, n_blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


@dataclass(frozen=True)
class Panel:
    """Rows that travel together."""

    number: int
    ids: np.ndarray
    matrix: np.ndarray
    codes: np.ndarray | None


def panels(df: DataFrame, size: Extent, block_bytes: int, in_place: bool = False) -> DataFrame:
    """Rows ``(id, embedding[, code])`` packed into panels, checkpointed; ``in_place``: where they
    lie, each time they are read.

    A panel holds ``PANEL_BYTES``; fewer, though not below ``block_bytes``, if there would not
    be ``LEAST_PANELS``. Rows of one id that outgrow a panel begin another.
    """
    few = min(size.blocks(min(block_bytes, PANEL_BYTES)), LEAST_PANELS)
    n = max(size.blocks(PANEL_BYTES), few)
    most = max(1, 2 * PANEL_BYTES // (8 * max(1, size.dim)))
    coded = "code" in df.columns
    columns = ["id", "embedding"] + (["code"] if coded else [])

    def pack(batches):
        held, rows, made = [], 0, 0

        def packed():
            table = pa.Table.from_batches(held).combine_chunks()
            number = (TaskContext.get().partitionId() << 32) + made
            data = [as_matrix(table["embedding"]).tobytes()]
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _one(table["id"]))
            arrays = [pa.array([number], pa.int64()), ids, pa.array(data, pa.large_binary())]
            if coded:
                arrays.append(pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), _one(table["code"])))
            return pa.RecordBatch.from_arrays(arrays, ["panel", "ids", "data", "codes"][: len(arrays)])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if rows + part.num_rows > most:
                    yield packed()
                    held, rows, made = [], 0, made + 1
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed()

    kind = df.schema["id"].dataType.simpleString()
    schema = f"panel long, ids array<{kind}>, data binary" + (", codes array<long>" if coded else "")
    rows = df.select(*columns)
    return rows.mapInArrow(pack, schema) if in_place else cut(rows.repartition(n, "id").mapInArrow(pack, schema))


def meet(left: DataFrame, right: DataFrame, right_size: Extent, begin, schema) -> DataFrame:
    """Let every panel of ``left`` meet all panels of ``right``, and gather what comes of it.

    ``begin(panel)`` is called for each panel of ``left`` and gives two functions: one that takes a
    panel of ``right`` and may return a batch of results, and one that returns the last batch.
    A task keeps one panel at a time and reads ``SIDE_BYTES`` of the other side, once for all the panels
    of ``left`` it goes through; enough tasks are left to occupy the cores.
    """
    left = left.coalesce(max(LEAST_PANELS, 2 * left.sparkSession.sparkContext.defaultParallelism))
    others = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns)).coalesce(right_size.blocks(SIDE_BYTES))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition
    pairs = left.join(others.withColumn("_place", place).hint("shuffle_replicate_nl"))  # a product of partitions; nothing is shuffled
    width = len(left.columns)
    # Python keeps a panel of the left side, so it is sent with the first one of the other side alone.
    once = [F.when(F.col("_place") == 0, F.col(c)).alias(c) for c in left.columns[1:]]
    pairs = pairs.select(left.columns[0], *once, *(f"_{c}" for c in right.columns))

    def gather(batches):
        number = add = end = None
        for batch in batches:
            for row in range(batch.num_rows):
                here = batch.column(0)[row].as_py()
                if here != number:
                    if end is not None:
                        yield end()
                    number = here
                    # Kept beyond its batch, which it must not keep as well.
                    add, end = begin(_panel([c.take(pa.array([row])) for c in batch.columns[:width]], 0))
                out = add(_panel(batch.columns[width:], row))
                if out is not None:
                    yield out
        if end is not None:
            yield end()

    return pairs.mapInArrow(gather, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return pa.concat_arrays(joined.chunks) if isinstance(joined, pa.ChunkedArray) else joined


def _panel(columns: list[pa.Array], row: int) -> Panel:
    ids = columns[1][row].values.to_numpy(zero_copy_only=False)
    matrix = np.frombuffer(columns[2][row].as_buffer(), np.float64).reshape(len(ids), -1)
    codes = columns[3][row].values.to_numpy(zero_copy_only=False) if len(columns) > 3 else None
    return Panel(columns[0][row].as_py(), ids, matrix, codes)


def present(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The vectors of a column that are not NULL, and where they stand."""
    at = np.flatnonzero(~np.asarray(column.is_null()))
    return column.take(pa.array(at)), at


def scatter(lists: pa.Array, at: np.ndarray, rows: int) -> pa.Array:
    """Put results back to where their rows stand; the others are NULL."""
    where = np.full(rows, -1)
    where[at] = np.arange(len(at))
    return lists.take(pa.array(where, mask=where < 0))


def k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores per row, ties by ascending id.

    Scores of minus infinity never qualify. Returned in (row, rank) order.
    """
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = (scores >= floor) & np.isfinite(scores)
    else:
        keep = np.isfinite(scores)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    within = np.arange(len(rows)) - starts[rows]
    return rows[within < k], cols[within < k]
