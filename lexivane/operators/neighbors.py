"""k-nearest-neighbour graph under Euclidean distance, exact or through hash tables.

The exact graph costs a distance per pair of rows, whatever the plan. Beyond some ten
million rows use :func:`knn_graph_lsh`: rows are only compared when they fall on the same
side of a set of random planes in one of several tables, which saves work if the planes are many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexivane.operators import blocks as B
from lexivane.session import cut

# Fixed value: neighbours per row.
NEIGHBORS = 15

# Relative error of a squared distance that comes from a matrix product.
NOISE = 1e-12

# Pairs whose products are taken together: a few hundred kilobytes of them.
TILE_ROWS, TILE_COLUMNS = 128, 1024

# Bucket sizes (three integers each) that may be broadcast.
MAX_BROADCAST_COUNTS = 1_000_000


def knn_graph(
    df: DataFrame,
    k: int = NEIGHBORS,
    id_col: str = "id",
    vec: str = "embedding",
    broadcast_bytes: int = B.BROADCAST_BYTES,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """``(id, neighbor_id, distance, rank)``: the k closest other rows, ties by id.

    Both plans give the same rows, whatever the lengths of the vectors.
    """
    rows = _comparable(df, id_col, vec)
    size = B.extent_of(rows)
    schema = _schema(rows)
    if size.fits(broadcast_bytes):
        return _ranked(_scan(rows, k, schema), k)
    kept, settled = collapse_copies(rows, k)
    panels = B.panels(kept, size, block_bytes)
    partial = B.meet(panels, panels, size, lambda panel: _gather(panel, k, schema.names), schema)
    return _ranked(partial.unionByName(settled), k)


def _comparable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Rows that have distances: a vector that is NULL, or has a NULL, NaN or infinite
    component, is set aside; it neither gets neighbours nor is one."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    nearest = W.partitionBy("id").orderBy("distance", "neighbor_id")
    return partial.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def collapse_copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows that still need a search, and the finished neighbours of all others.

    Of the rows with one and the same vector only the k + 1 lowest ids can be anybody's
    neighbour, as ties go by id. Any further copy has the k lowest ids as its neighbours,
    at distance 0. The rank limit works map-side, so a vector shared by a third of all
    rows costs no more than another; adaptive execution splits its side of the join.
    """
    keyed = rows.withColumn("_hash", F.xxhash64("embedding"))
    copies = W.partitionBy("_hash", "embedding").orderBy("id")
    kept = cut(keyed.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1))
    crowded = (
        kept.groupBy("_hash", "embedding")
        .agg(F.sort_array(F.collect_list("id")).alias("_ids"))  # k + 1 at most
        .filter(F.size("_ids") > k)
    )
    others = keyed.join(crowded, ["_hash", "embedding"]).filter(F.col("id") > F.element_at("_ids", -1))
    settled = others.select(
        "id", F.explode(F.slice("_ids", 1, k)).alias("neighbor_id"), F.lit(0.0).alias("distance")
    )
    return kept.select("id", "embedding"), settled


def knn_graph_lsh(
    df: DataFrame,
    k: int = NEIGHBORS,
    tables: int = 8,
    bits: int | None = None,
    id_col: str = "id",
    vec: str = "embedding",
    block_bytes: int = B.BLOCK_BYTES,
    seed: int = 42,
) -> DataFrame:
    """Like ``knn_graph``, among the rows that lie in the same or in adjoining buckets of some table.

    Buckets adjoin if one plane parts them. Neighbours that never meet so are missed, so a row may get other or fewer ones; all
    distances are exact. A bucket is never cut short: one that outgrows a block is split
    into blocks, and all pairs of its blocks are worked off as separate groups. ``bits``
    planes make a bucket; by default as many as let buckets fill one block on average,
    which keeps the work proportional to the rows. With so few planes that the tables would bring
    together more pairs than there are, every pair is looked at once, by panels, and counts if its rows
    meet in some table: the same neighbours.
    """
    rows = _comparable(df, id_col, vec)
    size = B.extent_of(rows)
    rows_per_block = max(1, block_bytes // (8 * max(1, size.dim)))
    if bits is None:
        bits = max(1, math.ceil(math.log2(max(1, size.rows) / rows_per_block)))
    if not 1 <= bits <= 30:
        raise ValueError("bits must be between 1 and 30")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    centre = rows.select(mean.alias("m")).first().m.toArray() if size.rows else np.zeros(1)
    planes = np.random.default_rng(seed).standard_normal((size.dim or 1, tables * bits))

    @arrow_udf("array<int>")
    def buckets(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        side = (B.as_matrix(vectors) - centre) @ planes > 0
        codes = side.reshape(-1, tables, bits) @ (1 << np.arange(bits))
        return B.as_lists(codes.astype(np.int32))

    kept, settled = collapse_copies(rows, k)
    if tables * (bits + 1) >= 2**bits and tables * bits < 64 and _one_row_per_id(kept):
        sides = F.aggregate(buckets("embedding"), F.lit(0).cast("long"), lambda all_, b: F.shiftleft(all_, bits) + b)
        packed = B.panels(kept.withColumn("code", sides), size, max(1, min(block_bytes, size.bytes // B.LEAST_PANELS)))
        schema = _schema(rows)
        partial = B.meet(packed, packed, size, lambda panel: _gather(panel, k, schema.names, Adjoining(tables, bits)), schema)
        return _ranked(partial.unionByName(settled), k)
    coded = kept.select("id", "embedding", F.posexplode(buckets("embedding")).alias("table", "bucket"))
    counts = coded.groupBy("table", "bucket").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("n_blocks")
    )
    others = counts.select("table", F.col("bucket").alias("_other"), F.col("n_blocks").alias("_other_blocks"))
    # There are at most tables * 2^bits counts; many of them are joined, not broadcast.
    if tables * 2**bits <= MAX_BROADCAST_COUNTS:
        counts, others = F.broadcast(counts), F.broadcast(others)
    near = F.array(F.col("bucket"), *[F.col("bucket").bitwiseXOR(F.lit(1 << i)) for i in range(bits)])
    placed = coded.join(counts, ["table", "bucket"]).withColumn("_other", F.explode(near)).join(others, ["table", "_other"])

    def cell(bucket: str, block) -> Column:
        return F.shiftleft(F.col(bucket).cast("long"), 32) + block

    own = F.pmod(F.xxhash64("id"), F.col("n_blocks").cast("long"))
    blocks = F.sequence(F.lit(0), F.col("_other_blocks") - 1)
    paired = (
        placed.withColumn("_block", cell("bucket", own))
        .withColumn("_at", F.explode(blocks))
        .withColumn("_to", cell("_other", F.col("_at")))
        .withColumn("lo", F.least("_block", "_to"))
        .withColumn("hi", F.greatest("_block", "_to"))
        .select("id", "embedding", "table", "_block", "lo", "hi")
    )
    found = paired.groupBy("table", "lo", "hi").applyInArrow(_block(k), _schema(rows))
    # The same pair may meet in several tables. Placed by id, both steps need one shuffle.
    once = found.repartition("id").groupBy("id", "neighbor_id").agg(F.min("distance").alias("distance"))
    return _ranked(once.unionByName(settled), k)


def _one_row_per_id(rows: DataFrame) -> bool:
    """Of a repeated id several rows may be neighbours of one row, which then has fewer different ones among k."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    return found.n == found.ids


@dataclass(frozen=True)
class Adjoining:
    """Whether two rows lie in the same or in adjoining buckets of some table, by all their buckets in one number."""

    tables: int
    bits: int

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        apart, bucket = one ^ other, np.int64((1 << self.bits) - 1)
        met = np.zeros(apart.shape, bool)
        for table in range(self.tables):
            planes = (apart >> np.int64(table * self.bits)) & bucket
            met |= planes & (planes - 1) == 0  # one plane or none
        return met


def _schema(rows: DataFrame) -> T.StructType:
    kind = rows.schema["id"].dataType
    return T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("neighbor_id", kind),
            T.StructField("distance", T.DoubleType()),
        ]
    )


class Nearest:
    """The k nearest of all rows met so far for each row of a matrix, never the row itself.

    A product gives each squared distance with an error below ``NOISE`` of that pair's own
    squared lengths. Every row that could be among the k best within its own error is
    measured exactly, and the exact distances decide; ids break ties. ``bound`` is a squared
    distance that k rows met so far do not exceed, so most pairs cost no more than their
    product; products are taken in tiles that stay in a core's cache. With ``codes``, only rows
    count whose code is one that ``allowed`` lets meet it.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, codes: np.ndarray | None = None, allowed: Adjoining | None = None):
        self.ids, self.matrix, self.k, self.codes, self.allowed = ids, matrix, k, codes, allowed
        self.squares = (matrix**2).sum(axis=1)
        self.left = np.hstack([-2.0 * matrix, np.ones((len(ids), 1))])
        self.bound = np.full(len(ids), np.inf)
        self.row, self.distance = np.empty(0, np.int64), np.empty(0)
        self.other = ids[:0]
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def meet(self, other_ids: np.ndarray, other: np.ndarray, other_codes: np.ndarray | None = None) -> None:
        squares = (other**2).sum(axis=1)
        right = np.hstack([other, (1 - NOISE) * squares[:, None]])
        for lo in range(0, len(other_ids), TILE_COLUMNS):
            columns = slice(lo, min(len(other_ids), lo + TILE_COLUMNS))
            part = np.ascontiguousarray(right[columns].T)
            for start in range(0, len(self.ids), TILE_ROWS):
                rows = slice(start, min(len(self.ids), start + TILE_ROWS))
                least = self.left[rows] @ part  # and (1 - NOISE) * squares of the row
                own = (1 - NOISE) * self.squares[rows]
                if least.shape[1] > self.k and np.isinf(self.bound[rows]).any():
                    most = least + own[:, None] + 2 * NOISE * (self.squares[rows, None] + squares[columns])
                    most[self.ids[rows, None] == other_ids[columns]] = np.inf
                    if self.allowed:
                        most[~self.allowed(self.codes[rows, None], other_codes[None, columns])] = np.inf
                    self.bound[rows] = np.fmin(self.bound[rows], np.partition(most, self.k - 1, axis=1)[:, self.k - 1])
                at = np.flatnonzero(least <= (self.bound[rows] - own)[:, None])
                at = at[np.isfinite(least.ravel()[at])]
                r, c = at // least.shape[1] + start, at % least.shape[1] + lo
                if self.allowed:
                    met = self.allowed(self.codes[r], other_codes[c])
                    r, c = r[met], c[met]
                self._measure(r, c, other_ids, other)
            if self.n_waiting > len(self.ids) * self.k:
                self._settle()

    def _measure(self, r: np.ndarray, c: np.ndarray, other_ids: np.ndarray, other: np.ndarray) -> None:
        apart = self.ids[r] != other_ids[c]
        r, c = r[apart], c[apart]
        exact = np.empty(len(r))
        for part in B.tiles(len(r), self.matrix.shape[1]):
            exact[part] = np.sqrt(((self.matrix[r[part]] - other[c[part]]) ** 2).sum(axis=1))
        self.waiting.append((r, other_ids[c], exact))
        self.n_waiting += len(r)

    def _settle(self) -> None:
        held = [(self.row, self.other, self.distance), *self.waiting]
        r, other, exact = (np.concatenate(column) for column in zip(*held))
        order = np.lexsort((other, exact, r))
        r, other, exact = r[order], other[order], exact[order]
        first = np.searchsorted(r, np.arange(len(self.ids)))
        rank = np.arange(len(r)) - first[r]
        full = rank == self.k - 1
        self.bound[r[full]] = np.fmin(self.bound[r[full]], exact[full] ** 2 * (1 + NOISE))
        best = rank < self.k
        self.row, self.other, self.distance = r[best], other[best], exact[best]
        self.waiting, self.n_waiting = [], 0

    def found(self) -> list[np.ndarray]:
        """Ids, their neighbours' ids and distances, nearest first."""
        self._settle()
        return [self.ids[self.row], self.other, self.distance]


def _nearest(ids, matrix, other_ids, other, k) -> list[np.ndarray]:
    """The k nearest rows of ``other`` for each row, never the row itself."""
    near = Nearest(ids, matrix, k)
    near.meet(other_ids, other)
    return near.found()


def _gather(panel: B.Panel, k: int, names: list[str], allowed: Adjoining | None = None):
    near = Nearest(panel.ids, panel.matrix, k, panel.codes, allowed)

    def add(other: B.Panel) -> None:
        near.meet(other.ids, other.matrix, other.codes)

    def end() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in near.found()], names)

    return add, end


def _block(k: int):
    def nearest(table: pa.Table) -> pa.Table:
        ids, matrix = table["id"].to_numpy(), B.as_matrix(table["embedding"])
        lower = table["_block"].to_numpy() == table["lo"][0].as_py()
        if lower.all():
            sides = [(lower, lower)] if table["lo"][0] == table["hi"][0] else []
        else:
            sides = [(lower, ~lower), (~lower, lower)] if lower.any() else []
        found = [_nearest(ids[a], matrix[a], ids[b], matrix[b], k) for a, b in sides]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [ids[:0], ids[:0], np.empty(0)]
        return pa.table(columns, names=["id", "neighbor_id", "distance"])

    return nearest


def _scan(rows: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """The whole set fits in a broadcast: every task ranks its own rows."""
    table = rows.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(
        (table["id"].to_numpy(), B.as_matrix(table["embedding"]))
    )

    def nearest(batches):
        other_ids, other = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                columns = _nearest(ids, B.as_matrix(batch.column("embedding")), other_ids, other, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.names)

    return B.spread(rows).mapInArrow(nearest, schema)
