"""Average linkage in few rounds."""

import numpy as np
import pytest
from test_neighbours import WINDOWS, matrix, walks

from candlemill.operators import linkage


@pytest.mark.parametrize("clusters", [2, 9])
def test_a_far_pair_merged_early_is_cut(spark, monkeypatch, clusters):
    """Far windows that are each other's nearest merge in the first round; the cut takes them apart again. Few rounds lead to the matrix."""
    values = walks(8, 140, [5, 6]) + [[1e3, 1e3], [2e3, 2e3], [5e3] * 4, [9e3] * 4]
    rounds, real = [], linkage._round
    monkeypatch.setattr(linkage, "_round", lambda *a: rounds.append(1) or real(*a))
    got = {r["series_id"]: r["cluster"] for r in linkage.linked_windows(spark.createDataFrame(list(enumerate(values)), WINDOWS), clusters, last=40).collect()}
    want = linkage.average_linkage(matrix(values), clusters)
    first = {c: n for n, c in enumerate(dict.fromkeys(want.tolist()))}
    assert [got[i] for i in range(len(values))] == [first[c] for c in want.tolist()] and 1 <= len(rounds) <= 9


def test_the_tree_of_a_matrix_is_that_of_single_merges():
    d = np.random.default_rng(0).random((60, 60))
    d = np.triu(d, 1) + np.triu(d, 1).T
    label = np.arange(60)
    for i, j, _ in linkage.average_tree(d, np.ones(60))[: 60 - 5]:
        label[label == j] = i
    assert np.unique(label, return_inverse=True)[1].tolist() == linkage.average_linkage(d, 5).tolist()
