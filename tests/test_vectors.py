import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import search, vectors
from docquarry.operators.vectors import VectorIndex


def rows(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    """600 vectors around eight centers, half of them around one, with repeats."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 12))
    which = np.where(rng.random(600) < 0.5, 0, rng.integers(0, 8, 600))
    made = centers[which] + 0.4 * rng.normal(size=(600, 12))
    made[500:520] = made[0]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id long, embedding array<float>").checkpoint()


@pytest.fixture(scope="module")
def queries(points):
    return points.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def test_exact_search_equals_a_scan(spark, points, queries, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=4, slice_size=40)  # the large cell is dealt over several slices
    index.add(points)
    want = rows(search.dense_topk(points, queries, 7))
    assert rows(index.topk(queries, 7, exact=True)) == want
    assert rows(index.topk(queries, 7, probes=1, exact=True)) == want


def test_probed_cells_find_nine_in_ten(spark, points, queries, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(points)
    want = {r[:3:2] for r in rows(search.dense_topk(points, queries, 7))}
    got = {r[:3:2] for r in rows(index.topk(queries, 7))}
    assert len(want & got) >= 0.9 * len(want)


def test_many_queries_go_in_blocks(spark, points, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(points)
    assert rows(index.topk(queries, 5, exact=True)) == rows(search.dense_topk(points, queries, 5))


def test_changes_and_repeated_batches(spark, points, queries, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=4)
    index.add(points.where("id < 300"), batch=0)
    turned = points.where("id % 4 = 0").withColumn("embedding", F.reverse("embedding"))
    gone = points.where("id % 9 = 1").select("id")
    index.add(turned, gone, batch=1)
    index.add(points, batch=1)  # has come already
    now = points.where("id < 300 and id % 4 <> 0").unionByName(turned).join(gone.where("id % 4 <> 0"), "id", "left_anti")
    assert rows(index.topk(queries, 5, exact=True)) == rows(search.dense_topk(now, queries, 5))
    assert index.cells.read().agg(F.sum("n")).first()[0] == now.count() == index.points.read().count() == index.places.read().count()


def test_odd_vectors(spark, tmp_path):
    made = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (7, [0.5]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [-1.0, 0.0])]
    points = spark.createDataFrame(made, "id long, embedding array<double>").withColumn("extra", F.lit("x"))
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 0.0]), (None, [1.0, 0.0])], "query_id long, vector array<double>")
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=2)
    index.add(points)
    assert rows(index.topk(asked, 9, exact=True)) == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 2, 0.0), (0, 4, 9, -1.0)]


def test_empty_tables(spark, points, queries, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=2)
    index.add(points.limit(0))
    assert index.topk(queries, 3, exact=True).count() == 0
    index.add(points.where("id < 5"))
    assert index.topk(queries.limit(0), 3).count() == 0
    assert rows(index.topk(queries, 3, exact=True)) == rows(search.dense_topk(points.where("id < 5"), queries, 3))


def test_a_new_fit_keeps_the_points(spark, points, queries, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index", buckets=2)
    index.add(points.where("id < 6"))
    index.add(points)
    new = index.refitted(f"{tmp_path}/new")
    assert new.cells.read().count() > index.cells.read().count()
    assert rows(new.topk(queries, 3, exact=True)) == rows(search.dense_topk(points, queries, 3))
