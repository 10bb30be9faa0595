"""Distance joins and average linkage of windows, held against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.operators import linkage, neighbours

WINDOWS = "series_id long, tail array<double>"
ODD = [(2000, None), (2001, []), (2002, [float("nan")]), (2003, [0.5, None]), (2004, [float("inf"), 1.0])]


def one(a, b, radius):
    """Warped distance of one pair, cell by cell."""
    n, m = len(a), len(b)
    band, cost = max(radius, abs(n - m)), {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost.get(x, np.inf) for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return cost[n, m]


def matrix(values, radius=1):
    d = np.zeros((len(values), len(values)))
    for n in {len(v) for v in values}:
        for m in {len(v) for v in values}:
            rows, cols = [i for i, v in enumerate(values) if len(v) == n], [i for i, v in enumerate(values) if len(v) == m]
            a, b = np.array([values[i] for i in rows]).T, np.array([values[i] for i in cols]).T
            for k, i in enumerate(rows):
                d[i, cols] = neighbours.warped(np.repeat(a[:, k : k + 1], len(cols), axis=1), b, radius)
    return d


def walks(seed, count, sizes, scale=0.1):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.round(np.cumsum(rng.normal(0, scale, rng.choice(sizes))), 3)] for _ in range(count)]


def test_warped_is_that_of_a_loop():
    values = walks(1, 30, [1, 2, 5, 8])
    for radius in (0, 1, 3):
        want = [[one(a, b, radius) for b in values] for a in values]
        np.testing.assert_allclose(matrix(values, radius), want)


@pytest.mark.parametrize("sizes,within,radius", [([8], 0.3, 1), ([4, 5, 8], 0.2, 1), ([1, 2, 3], 0.05, 0), ([6], 0.0, 2)])
def test_near_windows_match_all_pairs(spark, sizes, within, radius):
    values = walks(2, 160, sizes)
    values += values[:20] + [[1e6, 3.0] * 3, [1e6, 3.0 + 1e-3] * 3]  # copies, and windows far from the others
    d = matrix(values, radius)
    rows = list(enumerate(values)) + ODD
    got = {r["series_id"]: (r["class_id"], r["n_links"]) for r in neighbours.near_windows(spark.createDataFrame(rows, WINDOWS), within, radius).collect()}
    for i, v in enumerate(values):
        assert got[i] == (values.index(v), int((d[i] <= within).sum()) - 1), i
    assert all(got[i] == (None, 0) for i, _ in ODD) and len(got) == len(rows)
    assert neighbours.near_windows(spark.createDataFrame([], WINDOWS), within, radius).count() == 0


def test_few_pairs_are_warped(spark):
    """Of 4,000 walks scaled to 0..1 the index leaves less than 5 % of all pairs, and every near one."""
    values = [list(map(float, (v - v.min()) / (v.max() - v.min()))) for v in map(np.array, walks(3, 4000, [8], 1.0))]
    classes, _ = neighbours.different(spark.createDataFrame(list(enumerate(values)), WINDOWS))
    met = neighbours.candidates(*neighbours.bounds_of(classes, 1), 0.2).where("a < b")
    n, met = classes.count(), met.toPandas()
    assert len(met) < 0.05 * n * (n - 1) / 2
    d = matrix(values[:600])
    near = {(i, j) for i in range(600) for j in range(i + 1, 600) if d[i, j] <= 0.2}
    assert near and near <= set(zip(met["a"], met["b"]))


def test_nearest_match_all_pairs(spark):
    values = walks(4, 120, [4, 6])
    values += values[:5]
    d = matrix(values[:120])
    np.fill_diagonal(d, np.inf)
    frame = spark.createDataFrame(list(enumerate(values)) + ODD, WINDOWS)
    got = neighbours.nearest_windows(frame, 3).collect()
    want = {(i, r + 1, int(j)) for i in range(120) for r, j in enumerate(np.lexsort((np.arange(120), d[i]))[:3])}
    assert {(r["id"], r["rank"], r["neighbour"]) for r in got} == want
    assert neighbours.nearest_windows(frame.where("series_id < 2"), 5).count() == 2
    assert neighbours.nearest_windows(frame.where("series_id < 1"), 5).count() == 0 == neighbours.nearest_windows(frame.limit(0), 5).count()


@pytest.mark.parametrize("sizes", [[6], [4, 5, 6]])
def test_linkage_in_rounds_is_that_of_the_matrix(spark, sizes):
    rng = np.random.default_rng(5)
    centres = walks(6, 12, [6], 0.3)
    values = [[float(x) for x in np.array(centres[rng.integers(12)])[: rng.choice(sizes)] + rng.normal(0, 0.03)] for _ in range(150)]
    values = [[x + float(e) for x, e in zip(v, rng.normal(0, 0.02, len(v)))] for v in values]
    copies = rng.integers(0, 150, 30)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values + [values[i] for i in copies])] + ODD, WINDOWS)
    weight = np.ones(150) + np.bincount(copies, minlength=150)
    want = linkage.average_linkage(matrix(values), 7, weight)
    got = {r["series_id"]: r["cluster"] for r in linkage.linked_windows(frame, 7, last=30).collect()}
    assert len(got) == 180 and [got[i] for i in range(150)] == want.tolist()  # both number clusters by their first window
    assert all(got[150 + k] == got[i] for k, i in enumerate(copies.tolist()))


def test_linkage_of_few_and_of_equally_far_windows(spark):
    frame = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(12)], WINDOWS)
    assert len({r["cluster"] for r in linkage.linked_windows(frame, 3, last=4).collect()}) == 3
    assert [r["cluster"] for r in linkage.linked_windows(frame.where("series_id < 2"), 5).orderBy("series_id").collect()] == [0, 1]
    assert linkage.linked_windows(frame.limit(0), 3).count() == 0
    same = frame.withColumn("tail", F.array(F.lit(1.0)))
    assert {r["cluster"] for r in linkage.linked_windows(same, 3).collect()} == {0}
