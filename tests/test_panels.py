"""Panels: what travels does not follow the block size, results equal brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planview import plan_of
from lexivane.operators import blocks as B
from lexivane.operators.neighbors import Nearest, knn_graph
from lexivane.operators.quality import LabelSums, silhouette_rows
from lexivane.operators.search import Best, search_batch

TINY = {"broadcast_bytes": 0, "block_bytes": 8 * 8 * 4}  # four vectors a block


@pytest.fixture(scope="module")
def rows(spark):
    """400 vectors of whole numbers, so that distances tie; some are copies."""
    matrix = np.random.default_rng(5).integers(-2, 3, (400, 8)).astype(float)
    matrix[300:330] = matrix[0]
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(matrix)], "id long, embedding array<double>, label int"), matrix


def test_panels_do_not_follow_the_block_size(rows):
    df, matrix = rows
    size = B.extent_of(df)
    packed = B.panels(df.select("id", "embedding"), size, 8 * 8 * 4).collect()
    assert size.blocks(8 * 8 * 4) == 100 and len(packed) <= B.LEAST_PANELS
    assert sorted(i for p in packed for i in p.ids) == list(range(400))
    by_id = {i: v for p in packed for i, v in zip(p.ids, np.frombuffer(p.data).reshape(-1, 8))}
    assert all(np.array_equal(by_id[i], v) for i, v in enumerate(matrix))


def test_rows_of_one_id_begin_another_panel(spark, monkeypatch):
    monkeypatch.setattr(B, "PANEL_BYTES", 8 * 10)
    df = spark.range(100).select(F.lit(7).alias("id"), F.array(F.col("id").cast("double")).alias("embedding"))
    packed = B.panels(df, B.extent_of(df), 8).collect()
    assert sorted(len(p.ids) for p in packed) == [20] * 5
    assert len({p.panel for p in packed}) == 5


def test_neighbors_by_panels(rows):
    df, matrix = rows
    found = knn_graph(df, k=5, **TINY)
    assert "CartesianProduct" in plan_of(found)
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {i: np.lexsort((np.arange(400), d[i]))[:5].tolist() for i in range(400)}
    got = {i: [] for i in range(400)}
    for r in found.orderBy("id", "rank").collect():
        got[r.id].append(r.neighbor_id)
        assert r.distance == d[r.id, r.neighbor_id]
    assert got == want


def test_search_by_panels_sends_no_queries_to_the_driver(rows, monkeypatch):
    df, _ = rows
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    whole = {tuple(r) for r in search_batch(df, asked, 4, 0.1).collect()}
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("queries at the driver"))
    assert {tuple(r) for r in search_batch(df, asked, 4, 0.1, **TINY).collect()} == whole


def test_silhouette_by_panels(rows, monkeypatch):
    df, _ = rows
    whole = {r.id: r.silhouette for r in silhouette_rows(df).collect()}
    parts = {r.id: r.silhouette for r in silhouette_rows(df, **TINY).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-6 for i in whole)


@pytest.mark.parametrize("seed", range(4))
def test_kernels_across_tiles(seed, monkeypatch):
    """Scaled lengths, repeated ids and many small tiles."""
    from lexivane.operators import neighbors, quality, search

    for module in (neighbors, quality, search):
        monkeypatch.setattr(module, "TILE_ROWS", 7)
        monkeypatch.setattr(module, "TILE_COLUMNS", 11)
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-3, 4, (n, 5)) * 10.0 ** rng.integers(-3, 4, (n, 1)) for n in (40, 300))
    ids, others, k = rng.integers(0, 60, 40), rng.integers(0, 200, 300), 6
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    d[ids[:, None] == others] = np.inf
    near = Nearest(ids, a, k)
    for lo in range(0, 300, 90):
        near.meet(others[lo : lo + 90], b[lo : lo + 90])
    want = [np.lexsort((others, row))[:k] for row in d]
    got_ids, got, distance = near.found()
    assert np.array_equal(got, np.concatenate([others[w] for w in want]))
    assert np.array_equal(distance, np.concatenate([row[w] for row, w in zip(d, want)]))
    codes = rng.integers(0, 20, 300)
    d[np.isinf(d)] = 0.0
    sums = LabelSums(others, b, codes)
    expected = np.stack([d[:, codes == c].sum(axis=1) for c in np.unique(codes)], axis=1)
    assert np.allclose(sums.of(ids, a), expected, rtol=1e-6, atol=1e-3)
    unit_a, unit_b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (a, b))
    best = Best(np.arange(40), unit_a, k, -0.3)
    for lo in range(0, 300, 90):
        best.meet(others[lo : lo + 90], unit_b[lo : lo + 90])
    found = best.found()
    for q in range(40):
        scores = np.round(unit_a[q] @ unit_b.T, 12)
        top = [i for i in np.lexsort((others, -scores)) if scores[i] > -0.3][:k]
        assert found["id"][found["query_id"] == q].tolist() == others[top].tolist()


def test_a_panel_that_is_kept_does_not_keep_its_batch(rows):
    """A task keeps one panel of the left side while batches of up to 64 MiB go by."""
    df, _ = rows
    size = B.extent_of(df)
    packed = B.panels(df.select("id", "embedding"), size, 8 * 8 * 4)

    def begin(panel):
        held = panel.ids
        while isinstance(held, np.ndarray):
            held = held.base
        held = held.buffers()[1]
        while held.parent is not None:
            held = held.parent

        def end():
            return pa.RecordBatch.from_arrays([pa.array([panel.ids.nbytes]), pa.array([held.size])], ["own", "held"])

        return lambda other: None, end

    found = B.meet(packed, packed, size, begin, "own long, held long").collect()
    assert len(found) > 1 and all(r.held <= r.own + 64 for r in found)


def test_the_other_side_is_read_once_for_several_panels(spark, rows, monkeypatch):
    """100 panels went through 100 tasks, each of which read the other side anew."""
    df, _ = rows
    monkeypatch.setattr(B, "PANEL_BYTES", 8 * 8 * 2)
    size = B.extent_of(df)
    left = B.panels(df.select("id", "embedding"), size, 8 * 8 * 4)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    other = df.select("id", "embedding").coalesce(1).mapInArrow(counted, "id long, embedding array<double>")
    right = B.panels(other, size, 8 * 8 * 4, in_place=True)

    def begin(panel):
        met = []

        def end():
            ids = np.repeat(panel.ids, len(met))
            columns = [pa.array(ids), pa.array(np.tile(met, len(panel.ids)).astype(np.int64)), pa.array(np.repeat(panel.matrix.sum(axis=1), len(met)))]
            return pa.RecordBatch.from_arrays(columns, ["id", "met", "total"])

        return lambda panel: met.extend(panel.ids.tolist()), end

    found = B.meet(left, right, size, begin, "id long, met long, total double").distinct()
    sums = df.select("id", F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x).alias("total"))
    assert found.join(sums, ["id", "total"]).count() == 400 * 400
    assert 0 < read.value <= 400 * max(B.LEAST_PANELS, 2 * spark.sparkContext.defaultParallelism)


def test_a_panel_makes_its_side_of_the_product_once(monkeypatch):
    from lexivane.operators import quality

    made, plain = [], LabelSums.left
    monkeypatch.setattr(LabelSums, "left", staticmethod(lambda matrix: made.append(len(matrix)) or plain(matrix)))
    rng = np.random.default_rng(3)
    matrix, codes = rng.standard_normal((90, 4)), rng.integers(0, 3, 90)
    parts = [B.Panel(n, np.arange(n, 90, 3), matrix[n::3], codes[n::3]) for n in range(3)]
    add, end = quality._gather_sums(parts[0])
    for part in parts:
        add(part)
    found = {(r["id"], r["code"]): r["total"] for r in end().to_pylist()}
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(axis=2))
    assert found == pytest.approx({(i, c): d[i, codes == c].sum() for i in range(0, 90, 3) for c in range(3)})
    assert made == [30]
