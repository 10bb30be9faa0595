"""L4 clusters do their whole job: steps until the centres stand still, every member, one cluster of few candidates."""

import numpy as np

from candlemill.operators import centres, discovery

SCHEMA = "series_id long, n_peaks long, n_valleys long, peak_valley_ratio double, total_variation double, trend_direction long"


def test_steps_go_on_until_the_centres_stand_still(spark):
    """Evenly strewn vectors take far more than 20 steps; then every centre is the mean of the vectors nearest to it."""
    x = np.random.default_rng(3).normal(600, 120, (3000, 1))
    found, sizes, _ = centres.best_centres(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series_id long, vector array<double>"), 10, range(42, 44))
    near = np.abs(x - found[:, 0]).argmin(1)
    assert sizes.sum() == 3000
    np.testing.assert_allclose(found[:, 0], [x[near == i].mean() for i in range(10)], atol=1e-3)


def test_patterns_have_all_their_members_and_features(spark):
    rows = [(i, 5 * (1 + i % 2), 4 * (1 + i % 2), 1.25, 1000.0 * (1 + i % 2) + i / 100, 1) for i in range(20)] + [(99, 50, 40, 1.25, 9e5, -1)]
    got = discovery.cluster_complex(spark.createDataFrame(rows, SCHEMA), max_clusters=3).collect()
    assert sorted(r["members"] for r in got) == [list(range(0, 20, 2)), list(range(1, 20, 2))]
    for r in got:
        assert r["cluster_size"] == len(r["members"]) and (r["representative"], *r[4:]) == rows[r["representative"]]


def test_candidates_for_one_cluster_are_one(spark):
    rows = [(i, 5, 4, 1.25, 10.0 * i * i, 1) for i in range(5)]  # 5 // 3: one cluster; two would leave some out
    got = discovery.cluster_complex(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["pattern_id"], r["cluster_size"], r["members"]) for r in got] == [("L4-C000", 5, [0, 1, 2, 3, 4])]
    few = discovery.cluster_complex(spark.createDataFrame(rows[:2], SCHEMA)).orderBy("pattern_id").collect()
    assert [(r["pattern_id"], r["members"], r["total_variation"]) for r in few] == [("L4-0", [0], 0.0), ("L4-1", [1], 10.0)]
