"""What a round of linkage computes anew, and what it shuffles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_neighbours import WINDOWS, matrix, walks

from candlemill.operators import linkage, neighbours


def test_only_clusters_near_to_a_merge_are_asked_again(spark, monkeypatch):
    """Every round's nearest clusters are those of all mean distances, though most clusters are asked once."""
    values = walks(11, 120, [5, 6])
    classes, _ = neighbours.different(spark.createDataFrame(list(enumerate(values)), WINDOWS))
    members, near, merges, d, asked = linkage.stored(classes.withColumn("c", F.col("id")), "members"), None, None, matrix(values), []
    real = linkage._by_blocks
    monkeypatch.setattr(linkage, "_by_blocks", lambda a, *rest: asked.append(a.count()) or real(a, *rest))
    for _ in range(3):
        near = linkage._nearest(members, near, merges, 120, 1)
        of = {r["id"]: r["c"] for r in members.collect()}
        groups = {c: [i for i in of if of[i] == c] for c in set(of.values())}
        got = {r["a"]: r["d"] for r in near.collect()}
        want = {a: min(d[np.ix_(groups[a], groups[b])].mean() for b in groups if b != a) for a in groups}
        assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)
        merges = linkage._round(near)
        members = linkage.stored(linkage._renamed(members, merges), "members")
    assert asked[0] == 120 and max(asked[1:]) < 100


def test_no_windows_are_in_no_cluster(spark):
    assert linkage.linked_windows(spark.createDataFrame([], WINDOWS), 3).count() == 0


@pytest.mark.parametrize("sizes", [[1, 2], [1], [4, 6]])
def test_bounds_and_single_pairs_are_those_of_all_windows(sizes):
    """No mean distance is below its bound, and those of some pairs are those of the matrix, weights and windows of one value included."""
    rng, sides = np.random.default_rng(4), []
    for count in (60, 40):
        rows = [{"c": int(rng.integers(20)), "v": v, "w": int(rng.integers(1, 4))} for v in walks(int(rng.integers(99)), count, sizes, 0.5)]
        sides.append(linkage._clusters_of(pa.array(rows, pa.struct({"c": pa.int64(), "v": pa.list_(pa.float64()), "w": pa.int64()}))))
    least, (p, q) = linkage._least(*sides), np.indices((len(sides[0][2]), len(sides[1][2]))).reshape(2, -1)
    some = rng.random(len(p)) < 0.4
    mean = linkage._means_of(*sides, p, q, 1).reshape(least.shape)
    assert (least <= mean + 1e-9).all() and np.allclose(linkage._means_of(*sides, p[some], q[some], 1), mean[p[some], q[some]])
    for n, a in enumerate(sides[0][2].to_pylist()):
        for k, b in enumerate(sides[1][2].to_pylist()):
            own, other = ([r for r in s[0].to_pylist() if r["c"] == c] for s, c in zip(sides, (a, b)))
            d = matrix([r["v"] for r in own + other])[: len(own), len(own) :]
            assert mean[n, k] == pytest.approx(np.average(d, weights=np.outer([r["w"] for r in own], [r["w"] for r in other])))
