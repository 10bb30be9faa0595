"""Bars by month and series, and the state in versions: plans, crashes and two writers."""

import threading

import pytest
from pyspark.sql import functions as F

from candlemill.functions.columns import KEY
from candlemill.operators import indicators
from candlemill.sources import bars as sources
from candlemill.sources import state


def test_bar_store_prunes_months_and_needs_no_exchange(spark, tmp_path):
    days = spark.range(400).select(F.col("id").alias("n"), F.date_add(F.lit("2023-01-15").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    bars = spark.range(7).select(F.col("id").alias(KEY)).join(days).select(
        KEY, "trade_date", (F.col("n") + 1).alias("seq"), *[(F.sin(F.col("n") * (F.col(KEY) + 1)) + 5).alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("vol")
    )
    sources.write_bar_store(bars, "stored_bars", str(tmp_path / "bars"), 4)
    got = sources.read_bar_store(spark, "stored_bars", start="2023-03-10", end="2023-05-20")
    out = indicators.rsi(got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "trade_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = indicators.rsi(bars.where("trade_date between '2023-03-10' and '2023-05-20'"))
    key = lambda df: sorted(map(tuple, df.select(KEY, "seq", F.round("rsi", 9)).collect()))
    assert key(out) == key(want) and len(key(out)) == 7 * 72
    assert sources.read_bar_store(spark, "stored_bars", codes=[3]).select(KEY).distinct().count() == 1
    spark.sql("drop table stored_bars")


def library(spark, n, frequency=1, start=0):
    rows = [(f"p{i}", 2, frequency, [1.0, 2.0]) for i in range(start, start + n)]
    return spark.createDataFrame(rows, state.LIBRARY_SCHEMA)


def frequencies(spark, folder, version=None):
    return {r["pattern_id"]: r["frequency"] for r in state.load_state(spark, folder, version)["library"].collect()}


def test_an_upsert_writes_only_changed_parts(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert state.save_state({"library": library(spark, 200), "config": state.config_table(spark, {"k": 1})}, folder) == 1
    before = state._manifest(spark, folder, 1)
    assert state.upsert_state(spark, {"library": library(spark, 1, 9).union(library(spark, 1, 7, 500))}, folder) == 2
    after = state._manifest(spark, folder, 2)
    assert 1 <= sum(before["library"][p] != after["library"][p] for p in before["library"]) <= 2 and before["config"] == after["config"]
    got = frequencies(spark, folder)
    assert len(got) == 201 and got["p0"] == 9 and got["p500"] == 7 and got["p1"] == 1
    assert len(frequencies(spark, folder, 1)) == 200 and state.config_of(state.load_state(spark, folder)["config"]) == {"k": 1}


def test_a_crash_between_tables_leaves_the_last_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    state.save_state({"library": library(spark, 3), "config": state.config_table(spark, {"k": 1})}, folder)
    broken = state.config_table(spark, {"k": 2}).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.save_state({"library": library(spark, 5), "config": broken}, folder)
    assert state.newest_version(spark, folder) == 1 and len(frequencies(spark, folder)) == 3
    assert state.config_of(state.load_state(spark, folder)["config"]) == {"k": 1}


def test_two_writers(spark, tmp_path):
    folder = str(tmp_path / "state")
    state.save_state({"library": library(spark, 4)}, folder)
    with pytest.raises(state.Conflict):  # another writer makes version 2 while this one writes
        state._commit(spark, folder, lambda last: [state.upsert_state(spark, {"library": library(spark, 1, 5)}, folder), last][1])
    assert frequencies(spark, folder)["p0"] == 5
    both = [threading.Thread(target=state.upsert_state, args=(spark, {"library": library(spark, 1, 100 + i, i)}, folder)) for i in (1, 2)]
    [t.start() for t in both], [t.join() for t in both]
    got = frequencies(spark, folder)
    assert state.newest_version(spark, folder) == 4 and (got["p0"], got["p1"], got["p2"], got["p3"]) == (5, 101, 102, 1)
