"""Block products against expressions over all pairs, with ties, copies and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn, products


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8)).astype(np.float32)
    x[50:90] = x[7]  # copies: ties go by key
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(300), x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0] * 3), (903, [float("nan")] * 8), (904, [1.0, None] * 4)]
    points = spark.createDataFrame(rows + odd, "key long, vector array<float>")
    return points, points.where("key % 3 = 0 and key < 900").select(F.col("key").alias("query_id"), F.col("vector").alias("query"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.distance, 9)) for r in df.collect())


def test_nearest_equals_pairs_and_sends_k_rows_a_task(frames, monkeypatch):
    points, asked = frames
    clean = points.where("key < 900")
    want = rows(knn.knn_pairs(clean, asked, 6))
    monkeypatch.setattr(products, "ROWS", 32)
    monkeypatch.setattr(products, "ASKED", 16)
    assert rows(knn.knn_sql(points, asked, 6)) == rows(knn.knn_batched(points, asked, 6)) == want
    assert rows(knn.knn_sql(points, asked, 6, threshold=0.5)) == rows(knn.knn_pairs(clean, asked, 6, threshold=0.5))
    sent = products.nearest(products.spread(points).coalesce(2), asked, 6)
    assert sent.count() <= 2 * 6 * asked.count()  # all pairs would be 300 a query


def test_two_phase_sends_few_rows_and_segments_keep_recall(frames, monkeypatch):
    points, asked = frames
    clean = points.where("key < 900")
    bits = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    pairs = clean.join(asked, F.lit(True)).withColumn("far", F.aggregate(F.zip_with(bits("vector"), bits("query"), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x))
    pairs.createOrReplaceTempView("two_phase_pairs")
    near = asked.sparkSession.sql("select * from (select *, row_number() over (partition by query_id order by far, key) r from two_phase_pairs) where r <= 40")
    from tessera.functions import vectors

    want = rows(knn.best(near.select("query_id", "key", vectors.cosine(F.col("vector"), F.col("query")).alias("distance")), 5))
    monkeypatch.setattr(products, "ROWS", 32)
    assert rows(knn.knn_two_phase(points, asked, 8, 5, 8)) == want
    truth = knn.knn_batched(points, asked, 5)
    monkeypatch.setattr(knn, "SEGMENT", 40)
    assert knn.recall_at_k(knn.knn_two_phase_segments(points, asked, 8, 5, 4), truth, 5).first().recall >= 0.9


def test_fit_sample_and_units_are_cheap_and_sound(frames):
    from tessera.functions import vectors
    from tessera.operators import ann

    points, _ = frames
    x = ann._sample(points)
    assert x.shape == (300, 8) and np.allclose((x * x).sum(1), 1)
    plan = points.select(vectors.normalized(F.col("vector")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert "/ namedlambdavariable" in plan or "/ lambda" in plan  # the norm is bound once, not added up for each component


def test_int8_bounds_are_exact_ranks_over_many_parts(spark):
    x = np.random.default_rng(5).standard_normal((10_500, 64)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<float>").repartition(8)
    low, high = knn.int8_bounds(points, 0.95).first()
    flat = np.sort(x.ravel())
    rank = lambda p: flat[int(np.ceil(p * len(flat))) - 1]
    assert (np.float32(low), np.float32(high)) == (rank(0.025), rank(0.975))
