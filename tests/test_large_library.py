"""Scanning a large library by balls finds what comparing every pair finds."""

import datetime

import numpy as np
import pytest

from candlemill.operators import matching, recognition
from candlemill.sources import state

DAY = datetime.date(2024, 1, 1)


def shapes(n, size, seed, kinds=40):
    """Noisy copies of a few walks, as a library that has grown for long holds them."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((kinds, size)).cumsum(axis=1)
    return base[rng.integers(0, kinds, n)] + 0.1 * rng.standard_normal((n, size))


def similarity(a, b, correlated):
    def unit(x):
        return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.zeros(len(x))

    a, b = unit(a), unit(b)
    if correlated:
        return (np.corrcoef(a, b)[0, 1] + 1) / 2 if a.std() > 0 and b.std() > 0 else 0.0
    return max(0.0, 1 - np.linalg.norm(a - b) / np.sqrt(len(a)))


@pytest.mark.parametrize("correlated", [False, True])
@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.75, 0.9, 0.97, 1.0])
def test_balls_are_exact(correlated, threshold):
    prototypes, windows = shapes(300, 12, 1), shapes(60, 12, 1, 30)
    prototypes[7], windows[3], windows[4] = 5.0, 2.0, prototypes[11] * 3 + 1  # constants, and an equal shape
    balls = matching.Balls.of(prototypes, np.arange(300), correlated)
    row, number, similar, compared = balls.hits(windows, threshold)
    all_pairs = np.array([[similarity(w, p, correlated) for p in prototypes] for w in windows])
    sure = {(i, j) for i, j in np.argwhere(all_pairs >= threshold + 1e-7)}
    got = set(zip(row.tolist(), number.tolist()))
    assert sure <= got and all(all_pairs[i, j] >= threshold - 1e-7 for i, j in got)
    assert np.allclose(similar, all_pairs[row, number], atol=1e-7) and len(got) == len(row)
    assert (compared <= 300).all() and (threshold < 0.97 or compared.mean() < 150)


def test_a_library_of_200_000_patterns(spark):
    size, n = 20, 200_000
    prototypes = shapes(n, size, 5, 2_000)
    tails = shapes(30, size, 5, 2_000)
    library = spark.createDataFrame([(f"p{i}", 2 + i % 2, 1, p) for i, p in enumerate(prototypes.tolist())], state.LIBRARY_SCHEMA)
    rows = [(k, DAY + datetime.timedelta(i), i + 1, float(c)) for k, t in enumerate(tails) for i, c in enumerate(t)]
    bars = spark.createDataFrame(rows, "series_id long, trade_date date, seq long, close double")
    found = {(r["series_id"], int(r["pattern_id"][1:])) for r in recognition.scan(bars, library, threshold=0.95).collect()}
    want = set()
    for correlated in (False, True):
        at = np.flatnonzero(np.arange(n) % 2 == int(correlated))
        p, t = (matching.shapes_of(x, correlated)[0] for x in (prototypes[at], tails))
        near = (t @ p.T + 1) / 2 if correlated else 1 - np.sqrt(((t[:, None] - p[None]) ** 2).sum(2)) / np.sqrt(size)
        want |= {(int(i), int(at[j])) for i, j in np.argwhere(near >= 0.95)}
    assert found == want and found
    work = recognition.scan_work(bars, library, threshold=0.95).agg({"pairs": "sum", "compared": "sum"}).first()
    assert work["sum(pairs)"] == 30 * n and work["sum(compared)"] < 0.5 * 30 * n, work
