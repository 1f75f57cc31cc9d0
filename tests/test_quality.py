import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.operators import quality as Q
from lexivane.operators.scaling import add_noise, standardize

SMALL = {"broadcast_bytes": 0, "block_bytes": 64 * 8 * 60}


def points(spark, *pairs):
    rows = [(i, [float(v)], l) for i, (v, l) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def four(spark):
    return points(spark, (0, 0), (1, 0), (10, 1), (11, 1))


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id").cache()


def test_weighted_f1(spark):
    rows = [("a", 1, 1), ("a", 1, 1), ("a", 0, 1), ("b", 1, 0), ("b", 1, 0)]
    df = spark.createDataFrame(rows, "label string, truth int, pred int")
    assert Q.weighted_f1(df).first().f1 == pytest.approx(0.4)
    nothing = spark.createDataFrame([("a", 0, 0)], df.schema)
    assert Q.weighted_f1(nothing).first().f1 == 0.0


def test_four_points(four):
    assert Q.calinski_harabasz(four).first()[0] == pytest.approx(200)
    assert Q.silhouette(four).first()[0] == pytest.approx(np.mean([9.5 / 10.5, 8.5 / 9.5]))


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "block_bytes": 16}])
def test_singleton_scores_zero(spark, limits):
    df = points(spark, (0, 0), (1, 0), (10, 1), (11, 1), (50, 2))
    by_id = {r.id: r.silhouette for r in Q.silhouette_rows(df, **limits).collect()}
    assert by_id[4] == 0 and by_id[0] == pytest.approx(9.5 / 10.5) and len(by_id) == 5


@pytest.mark.parametrize("labels", [(0, 0, 0), (0, 1, 2)])
def test_too_few_or_many_labels(spark, labels):
    df = points(spark, *zip((0, 1, 2), labels))
    for score in (Q.silhouette, Q.calinski_harabasz):
        with pytest.raises(Exception, match="between 2 and n-1"):
            score(df).collect()


def test_published_values(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    assert round(Q.calinski_harabasz(df).first()[0], 6) == 1.055317
    assert round(Q.silhouette(df).first()[0], 6) == -0.012707
    assert round(Q.silhouette(df, **SMALL).first()[0], 6) == -0.012707


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_silhouette_brute_force_with_a_dominant_label(vectors, limits):
    skewed = vectors.withColumn("label", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("label")))
    rows = skewed.orderBy("id").collect()
    x, y = np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    expected = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == l].mean() for l in set(y) - {y[i]})
        expected.append((b - a) / max(a, b))
    got = [r.silhouette for r in Q.silhouette_rows(skewed, **limits).orderBy("id").collect()]
    assert np.allclose(got, expected, atol=1e-7)


def test_fast_mode_is_another_measure(vectors):
    fast = Q.silhouette(vectors, mode="fast").first()[0]
    assert -1 <= fast <= 1 and fast != Q.silhouette(vectors).first()[0]


def test_standardize(spark):
    df = spark.createDataFrame([(i, [float(v), 5.0, 0.1]) for i, v in enumerate((1, 2, 3))], "id long, embedding array<double>")
    rows = [r.embedding for r in standardize(df).orderBy("id").collect()]
    assert np.allclose(rows, [[-1.224745, 0, 0], [0, 0, 0], [1.224745, 0, 0]], atol=1e-6)


def test_noise_is_repeatable_and_normal(vectors):
    noisy = add_noise(vectors, out="noisy")
    again = add_noise(vectors.repartition(5), out="noisy")
    assert noisy.select("id", "noisy").exceptAll(again.select("id", "noisy")).isEmpty()
    rows = noisy.collect()
    diff = np.array([np.array(r.noisy) - np.array(r.embedding) for r in rows])
    assert abs(diff.mean()) < 0.003 and abs(diff.std() - 0.1) < 0.003
    assert abs(np.corrcoef(diff[:, 0], diff[:, 1])[0, 1]) < 0.15


def test_metric_tables(spark):
    df = Q.metrics_row(spark, "m", 0.5, 0.1, 200)
    rows = {r.Metric: r.Score for r in Q.rescale_metric(Q.melt_metrics(df)).collect()}
    assert rows == {"f1": 0.5, "silhouette": 0.1, "calinski": 0.2}


def test_reconstruction_mse(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert Q.reconstruction_mse(df, "a", "b").first().mse == 1.0


def test_compare_spaces(vectors):
    half = vectors.withColumn("embedding", F.slice("embedding", 1, 32))
    rows = {r.name: r for r in Q.compare_spaces({"base": vectors, "half": half}).collect()}
    assert rows["base"].calinski == Q.calinski_harabasz(vectors).first()[0]
    assert rows["half"].silhouette == pytest.approx(Q.silhouette(half).first()[0])
