"""Neighbour descent, blocked products, the cell index and the silhouette estimate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.operators import panels
from lexivane.operators import cells as cells_module
from lexivane.operators.cells import build_cells, search_cells
from lexivane.operators.descent import descend
from lexivane.operators.estimate import silhouette_interval
from lexivane.operators.neighbors import knn_graph
from lexivane.operators.quality import silhouette
from lexivane.operators.search import search_batch


def clustered(spark, n=900, dims=8, groups=12, seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[np.arange(n) % groups] + spread * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, v.tolist(), int(i % groups)) for i, v in enumerate(x)], "id long, embedding array<double>, label int"), x


# --- neighbour descent -----------------------------------------------------------------


def test_descent_finds_the_neighbours(spark):
    df, x = clustered(spark)
    found = descend(df, 10)
    got = found.graph.collect()
    exact = {(r.id, r.neighbor_id): r.distance for r in knn_graph(df, 10).collect()}
    assert sum((r.id, r.neighbor_id) in exact for r in got) >= 0.97 * len(exact)
    assert all(r.distance == pytest.approx(np.linalg.norm(x[r.id] - x[r.neighbor_id])) for r in got[:500])
    ranks = {}
    for r in got:
        assert r.id != r.neighbor_id
        ranks.setdefault(r.id, []).append((r.rank, r.distance))
    assert len(ranks) == 900 and all([k for k, _ in sorted(v)] == list(range(1, 11)) for v in ranks.values())
    assert found.pairs < 900 * 899 / 2


def test_descent_with_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 0.0]) for i in range(30)]
    rows += [(200, None), (201, [float("nan"), 0.0]), (202, [None, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {}
    for r in descend(df, 4).graph.collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbor_id))
    exact = {}
    for r in knn_graph(df, 4).collect():
        exact.setdefault(r.id, []).append((r.distance, r.neighbor_id))
    assert set(got) == set(exact)
    assert all(sorted(got[i]) == sorted(exact[i]) for i in range(60))
    assert sum(len(set(got[i]) & set(exact[i])) for i in range(100, 130)) >= 0.9 * 120
    assert descend(df.limit(0), 4).graph.count() == 0
    assert descend(df.filter("id = 3"), 4).graph.count() == 0


# --- blocked products ------------------------------------------------------------------


@pytest.mark.parametrize("cell_bytes,split", [(1 << 26, False), (8 * 5 * 40, True)])
def test_blocked_product(spark, cell_bytes, split):
    rng = np.random.default_rng(5)
    n, m = 60, 5
    dense = np.diag(rng.random(n) + 0.5)
    for _ in range(150):
        i, j = rng.integers(0, n, 2)
        dense[i, j] = dense[j, i] = rng.random()
    dense[7, :] = dense[:, 7] = rng.random(n) + 0.1  # a row with an entry everywhere
    entries = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    cells = panels.deal(spark.createDataFrame(entries, "src long, dst long, w double"), m, cell_bytes)
    assert cells.split == split
    y, z = rng.normal(size=(n, m)), rng.normal(size=(n, m))
    held = spark.createDataFrame([(i, y[i].tolist(), z[i].tolist()) for i in range(n)], "id long, y array<double>, z array<double>")
    state = cells.rows.join(held, "id")
    for _ in range(2):  # the result is a state again
        state = panels.multiply(cells, state, 0.7, -0.3, 0.2)
        y, z = z, 0.7 * dense @ z - 0.3 * z + 0.2 * y
    got = {r.id: r for r in state.collect()}
    assert len(got) == n
    assert np.allclose([got[i].z for i in range(n)], z) and np.allclose([got[i].y for i in range(n)], y)
    assert np.allclose(panels.gram(state, "y", "z"), y.T @ z)


# --- cell index ------------------------------------------------------------------------


def hits(df):
    return sorted((r.query_id, r.rank, r.id, r.similarity_score) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000}])
def test_cells_give_the_same_hits(spark, tmp_path, options):
    df, x = clustered(spark, 600, groups=20)
    df = df.unionByName(spark.createDataFrame([(1000 + i, [0.0] * 8, 0) for i in range(3)] + [(2000, None, 0)], df.schema))
    df = df.unionByName(df.filter("id < 5").withColumn("id", F.col("id") + 3000))  # copies tie
    asked = df.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    asked = asked.unionByName(spark.createDataFrame([(9000, [1.0] + [0.0] * 7), (9001, (-x[0]).tolist())], asked.schema))
    build_cells(df, str(tmp_path / "cells"), **options)
    for k, score in ((10, 0.5), (3, 0.98), (700, -1.0)):
        found = search_cells(spark, str(tmp_path / "cells"), asked, k, score, **options)
        assert hits(found.hits) == hits(search_batch(df, asked, k, score))
        assert found.rows == 605 and found.rows_read <= 605
    few = search_cells(spark, str(tmp_path / "cells"), asked.filter("query_id < 20"), 5, 0.9)
    assert few.rows_read < 0.5 * few.rows and few.cells_read < few.cells
    with pytest.raises(ValueError):
        search_cells(spark, str(tmp_path / "cells"), spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"))


def test_cells_send_no_query_to_each_cell(spark, tmp_path, monkeypatch):
    """Without structure every query visits every cell; what is kept in between does not follow that."""
    x = np.random.default_rng(4).normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    build_cells(df, str(tmp_path / "cells"), n_cells=15)
    kept, cut = [], cells_module.cut
    monkeypatch.setattr(cells_module, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    found = search_cells(spark, str(tmp_path / "cells"), asked, 2, -1.0)
    assert found.cells_read == found.cells > 10
    assert max(df.count() for df in kept) <= 2 * 300
    assert hits(found.hits) == hits(search_batch(df, asked, 2, -1.0))


def test_cells_of_nothing(spark, tmp_path):
    df, _ = clustered(spark, 5, groups=2)
    build_cells(df.limit(0), str(tmp_path / "none"))
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    found = search_cells(spark, str(tmp_path / "none"), asked)
    assert found.hits.count() == 0 and found.rows == 0
    build_cells(df, str(tmp_path / "five"))
    assert search_cells(spark, str(tmp_path / "five"), asked.limit(0)).hits.count() == 0


# --- silhouette estimate ---------------------------------------------------------------


def test_interval_covers_the_silhouette(spark):
    df, _ = clustered(spark, 1500, groups=6, spread=0.8)
    df = df.withColumn("label", F.when(F.col("id") == 3, 99).otherwise(F.col("label")))
    exact = silhouette(df).first().silhouette
    for limits in ({}, {"broadcast_bytes": 8 * 8 * 100}, {"cells": 500}):
        r = silhouette_interval(df, per_label=60, **limits).first()
        assert r.low <= exact <= r.high and r.high - r.low < 0.06 and (r.rows_drawn, r.rows) == (361, 1500)
    whole = silhouette_interval(df, per_label=300).first()
    assert whole.low == whole.high == pytest.approx(exact)


# --- products by records of blocks -------------------------------------------------------


def test_products_send_packed_rows_between_many_blocks(spark, monkeypatch):
    """Several products in a row, a record per block and one shuffle per product; a row with an entry everywhere."""
    monkeypatch.setattr(panels, "LEAST_ROWS", 10)
    rng = np.random.default_rng(11)
    n, m = 300, 4
    dense = np.diag(rng.random(n) + 0.5)
    for i, j in rng.integers(0, n, (900, 2)):
        dense[i, j] = dense[j, i] = rng.random()
    dense[7, :] = dense[:, 7] = rng.random(n) + 0.1
    entries = [(f"r{i}", f"r{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    cells = panels.deal(spark.createDataFrame(entries, "src string, dst string, w double"), m)
    assert cells.n_blocks == panels.LEAST_BLOCKS  # however much a cell may hold, all cores have some
    y, z = rng.normal(size=(n, m)), rng.normal(size=(n, m))
    held = spark.createDataFrame([(f"r{i}", y[i].tolist(), z[i].tolist()) for i in range(n)], "id string, y array<double>, z array<double>")
    state = panels.pack(cells, cells.rows.join(held, "id"))
    done = panels.products(cells, state, [(0.7, -0.3, 0.2), (1.0, 0.0, 0.0), (0.5, 0.0, -1.0)])
    assert done.rdd.getNumPartitions() == cells.n_blocks and done.count() == cells.n_blocks
    for a, b, c in ((0.7, -0.3, 0.2), (1.0, 0.0, 0.0), (0.5, 0.0, -1.0)):
        y, z = z, a * dense @ z + b * z + c * y
    got = {r.id: r for r in panels.unpack(cells, panels.combine(done, lambda y, z: (2 * y, z))).collect()}
    assert np.allclose([got[f"r{i}"].y for i in range(n)], 2 * y) and np.allclose([got[f"r{i}"].z for i in range(n)], z)
    assert np.allclose(panels.gram(done, "y", "z"), y.T @ z)


def test_entries_of_a_piece_in_parts(monkeypatch):
    """Rows cut anywhere by the bound on what is multiplied at once."""
    monkeypatch.setattr(panels.B, "TILE_CELLS", 8 * 3 * 2)  # three entries at a time
    rng = np.random.default_rng(2)
    dense = rng.random((9, 12)) * (rng.random((9, 12)) < 0.6)
    i, j = np.nonzero(dense)
    shuffled = rng.permutation(len(i))
    table = panels.pa.table({"block": [0] * len(i), "other": [1] * len(i), "i": i[shuffled], "j": j[shuffled], "w": dense[i, j][shuffled]})
    piece, send = panels._piece(table).to_pylist()
    z = rng.normal(size=(12, 2))
    block = panels._Block(0, np.zeros((9, 2)), np.zeros((9, 2)), (2.0, 0.0, 0.0))
    block.piece = [np.frombuffer(piece[c], t) for c, t in zip(("one", "two", "three", "four"), (np.int32, np.int64, np.int32, np.float64))]
    block.add(z[np.frombuffer(send["one"], np.int32)])
    assert np.allclose(block.z, 2 * dense @ z)
