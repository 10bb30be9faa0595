"""k-means of several starts against planted clusters and the cost of one start after the other."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from candlemill.operators import centres, discovery


def test_costs_no_more_than_the_best_of_ten_single_fits(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 10, (6, 4))
    x = np.vstack([m + rng.normal(0, 1, (n, 4)) for m, n in zip(middle, (300, 20, 80, 150, 40, 10))])
    x = np.vstack([x, np.repeat(x[:1], 200, axis=0)])  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "series_id long, vector array<double>")
    found, sizes, cost = centres.best_centres(df, 6, range(42, 52))
    data = df.where("vector is not null").select(array_to_vector("vector").alias("features")).cache()
    single = min(KMeans(k=6, seed=s).fit(data).summary.trainingCost for s in (42, 43, 44))
    assert cost <= single * (1 + 1e-6) and sizes.sum() == len(x)
    near = ((x[:, None] - found) ** 2).sum(2)
    np.testing.assert_allclose(near.min(1).sum(), cost, rtol=1e-9)
    for i in range(6):
        np.testing.assert_allclose(found[i], x[near.argmin(1) == i].mean(0), atol=1e-4)


def test_few_and_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(99, [3.0, 2.0])], "series_id long, vector array<double>")
    assert [r["centre"] for r in discovery.kmeans(df, 5).orderBy("cluster").collect()] == [[1.0, 2.0], [3.0, 2.0]]
    assert discovery.kmeans(df.limit(0), 3).count() == 0


def test_batches_may_draw_no_seeds(spark):
    """Of 400 vectors in batches of 8 a round draws some four, so most batches draw none."""
    rows = [(i, [float(i % 20), float(i // 20)]) for i in range(400)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        found, sizes, _ = centres.best_centres(spark.createDataFrame(rows, "series_id long, vector array<double>"), 2, range(42, 44))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(found) == 2 and sizes.sum() == 400
