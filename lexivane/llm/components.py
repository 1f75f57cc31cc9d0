"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node.

    Each round gives every node the least of itself and its neighbours as parent, follows that
    parent's parent, and replaces the edges by those between parents. With keys that are
    digests the number of nodes falls by a constant factor a round. The edges and parents of a
    round are checkpointed; nothing is collected.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    assigned = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        above = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(above, "p").select("node", F.col("pp").alias("p")))
        if assigned is None:
            assigned = parent.select("node", F.col("p").alias("root"))
        else:
            up = parent.select(F.col("node").alias("root"), "p")
            assigned = cut(assigned.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if edges.isEmpty():
            return assigned
