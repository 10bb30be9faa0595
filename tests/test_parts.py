"""What a task holds of large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill import queries
from candlemill.functions.columns import KEY
from candlemill.operators import discovery, turns
from candlemill.sources import tables

DATA = "/root/testdata/sf0.001"


def test_parts_of_the_bars_grow_with_the_lines(spark, monkeypatch):
    """More lines make more parts, not larger ones, and the bars are the same."""
    want = sorted(map(str, tables.load(spark, DATA, "bars").collect()))
    monkeypatch.setattr(tables, "LINES", 500)
    bars = tables.load(spark, DATA, "bars")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert bars.rdd.getNumPartitions() == -(-lines // 500) and sorted(map(str, bars.collect())) == want
    assert queries.queries()["macd"](spark, DATA).rdd.getNumPartitions() == -(-lines // 500)


@pytest.mark.parametrize("size", [40, 4096])
def test_series_of_one_chunk_are_walked_once(spark, monkeypatch, size):
    """Only series longer than a chunk need what a chunk makes of entering legs; both ways give the same pivots."""
    bars = tables.load(spark, DATA, "bars")
    if size == 4096:
        monkeypatch.setattr(turns, "entering_legs", None)
        assert "FlatMapCoGroups" not in turns.zigzag(bars)._jdf.queryExecution().toString()
    got = sorted((r[KEY], r["seq"], r["price"], r["mark"]) for r in turns.zigzag(bars, size=size).collect())
    want = []
    for r in bars.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "high", "low"))).alias("x")).collect():
        high, low = (np.array([b[c] for b in r["x"]], dtype=float) for c in ("high", "low"))
        want += [(r[KEY], r["x"][i]["seq"], p, m) for i, p, m in turns.zigzag_pivots(high, low, 0.05)]
    assert got == sorted(want)


def test_features_are_computed_once(spark):
    """Moments and scores of the composite patterns come from one computation of the features."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(i, p, float((i * 7 + p) % 5)) for i in range(40) for p in range(4)]
    vectors = spark.createDataFrame(rows, "series_id long, pos long, value double").mapInPandas(count, "series_id long, pos long, value double")
    assert discovery.discover_composite(vectors).count() and seen.value == len(rows)
