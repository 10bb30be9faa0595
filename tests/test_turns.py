"""Zigzag by chunks against the pivots of whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlemill.functions.columns import KEY
from candlemill.operators import turns


def series(n, seed):
    rng = np.random.default_rng(seed)
    step = rng.normal([0, 0.001, -0.004, 0][seed % 4], 0.02, n)
    mid = 100 * np.exp(np.cumsum(step))
    mid = np.round(mid) if seed % 3 == 0 else mid  # ties
    return mid * (1 + 0.01 * rng.random(n)), mid * (1 - 0.01 * rng.random(n)) if seed % 5 else mid


def by_chunks(high, low, threshold, size):
    rows = []
    for c in range(0, len(high), size):
        h, l = high[c : c + size], low[c : c + size]
        rows += [(c // size, len(h), sign, p, s, top, c + at) for sign in (1, -1) for p, (s, top, at) in turns.effect(h, l, threshold, sign)]
    frame = pd.DataFrame(rows, columns=["chunk", "n", "sign", "bound", "out_sign", "out_top", "out_at"])
    out = []
    for chunk, sign, top, at in turns.entering_legs(frame):
        c = chunk * size
        ended, (sign, top, last) = turns.legs_through(high[c : c + size], low[c : c + size], threshold, (sign, top, -1))
        out += [(at if i < 0 else c + i, p, m) for i, p, m in ended]
        end = (at if last < 0 else c + last, sign * top, sign)
    return [*out, end], len(rows)


@pytest.mark.parametrize("size", [1, 7, 64, 500])
def test_chunks_fold_to_the_pivots_of_the_series(size):
    for seed in range(24):
        high, low = series(900 if size > 1 else 120, seed)
        for threshold in (0.02, 0.05, 0.3):
            assert by_chunks(high, low, threshold, size)[0] == turns.zigzag_pivots(high, low, threshold)


def test_effects_are_few_rows():
    high, low = series(40_000, 1)
    assert by_chunks(high, low, 0.05, 4096)[1] < 200
    falling = np.linspace(2000, 100, 40_000)
    assert by_chunks(falling, falling, 0.05, 4096)[1] < 200


def test_zigzag_of_tables_in_small_chunks(spark):
    rows, want = [], {}
    for k, (n, name) in enumerate(((700, "a"), (1, "b"), (2, "c"), (333, None))):
        high, low = series(n, k + 4)
        rows += [(name, i + 1, float(h), float(l)) for i, (h, l) in enumerate(zip(high, low))]
        want[name] = [(i + 1, p, m) for i, p, m in turns.zigzag_pivots(high, low, 0.04)]
    rows += [("a", 2000, None, 1.0), ("d", 1, None, None)]
    bars = spark.createDataFrame(rows, f"{KEY} string, seq long, high double, low double")
    got = {}
    for r in turns.zigzag(bars.withColumn("chunk", F.lit("x")), 0.04, size=50).orderBy("seq").collect():
        got.setdefault(r[KEY], []).append((r["seq"], r["price"], r["mark"]))
        assert r["type"] == ("peak" if r["mark"] > 0 else "valley")
    assert got == {k: v for k, v in want.items() if v}
    assert turns.zigzag(bars.limit(0), 0.04).count() == 0
