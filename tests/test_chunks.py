"""Work over trailing windows in chunks: same results whatever the chunk, long windows, gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.operators import indicators, matching


def series(spark, lengths, seed=1, gaps=()):
    rng, rows = np.random.default_rng(seed), []
    for k, n in enumerate(lengths):
        closes = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 1)
        rows += [(k if k else None, i + 1, None if (k, i) in gaps else float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id long, seq long, close double").withColumn("trade_date", F.expr("date_add(date'2020-01-01', cast(seq as int))"))


@pytest.mark.parametrize("window,chunk", [(5, 7), (40, 16), (40, 4096), (1, 3)])
def test_ranks_are_those_of_a_loop(spark, window, chunk):
    gaps = {(1, 30), (2, 0)}
    bars = series(spark, [90, 75, 3, 41], gaps=gaps)
    got = {(r["series_id"], r["seq"]): r["share"] for r in indicators.sliding_rank(bars, "close", "share", window, chunk).collect()}
    closes = {}
    for r in bars.orderBy("seq").collect():
        closes.setdefault(r["series_id"], []).append(r["close"])
    assert len(got) == bars.count()
    for k, own in closes.items():
        for i, x in enumerate(own):
            part = own[max(0, i - window + 1) : i + 1]
            whole = len(part) == window and None not in part
            want = (sum(v < x for v in part) + (sum(v == x for v in part) + 1) / 2) / window if whole else None
            assert got[k, i + 1] == (pytest.approx(want) if whole else None)


def test_ranks_in_long_windows(spark):
    got = indicators.sliding_rank(series(spark, [3000]), "close", "share", 2520).where("share is not null")
    assert got.count() == 3000 - 2519 and got.where("share between 0 and 1").count() == 481


@pytest.mark.parametrize("chunk", [16, 100, 4096])
def test_history_is_the_same_in_any_chunks(spark, chunk):
    bars = series(spark, [300, 120, 6], gaps={(1, 50)})
    closes = [float(x) for x in np.cumsum(np.random.default_rng(3).normal(0, 1, 500))]
    rows = [(f"P{n}", 2 + n % 2, 3, closes[:n]) for n in (1, 4, 5, 8, 200)]
    library = spark.createDataFrame(rows, "pattern_id string, complexity int, frequency long, prototype array<double>")
    got = {tuple(r)[:2] + (r["pattern_id"],): r["similarity"] for r in matching.history_trades(bars, library, 5, 0.7, chunk=chunk).collect()}
    want, by_id = {}, {}
    for r in bars.orderBy("seq").collect():
        by_id.setdefault(r["series_id"], []).append(np.nan if r["close"] is None else r["close"])
    for k, own in by_id.items():
        for i in range(len(own) - 5):
            for name, complexity, _, p in rows:
                part = np.array(own[max(0, i - len(p) + 1) : i + 1])
                if len(part) == len(p) and not np.isnan(part).any() and not np.isnan(own[i + 5]):
                    x, y = ((v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else v * 0.0 for v in (part, np.array(p)))
                    varied = x.std() > 0 and y.std() > 0
                    alike = ((np.corrcoef(x, y)[0, 1] + 1) / 2 if varied else 0.0) if complexity >= 3 else max(0.0, 1 - np.linalg.norm(x - y) / np.sqrt(len(p)))
                    if alike >= 0.7:
                        want[k, i + 1, name] = alike
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_prototypes_of_500_bars(spark):
    bars = series(spark, [5000])
    part = [r["close"] for r in bars.where("seq between 1001 and 1500").orderBy("seq").collect()]
    library = spark.createDataFrame([("P", 3, 3, part)], "pattern_id string, complexity int, frequency long, prototype array<double>")
    plan = matching.history_trades(bars, library, 5, 0.999)
    assert "collect_list" not in plan._jdf.queryExecution().toString().lower()
    assert [r["seq"] for r in plan.collect()] == [1500]
