"""Steps that must not grow with the table: parts by size, what is computed once, files."""

import pytest
from pyspark.sql import functions as F

from candlemill.functions.columns import KEY
from candlemill.operators import discovery, evaluation
from candlemill.sources import bars as sources
from candlemill.sources import tables

DATA = "/root/testdata/sf0.001"


def counting(spark, rows, schema):
    """A table and how many of its rows have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), seen


@pytest.mark.parametrize("name", ["bars_raw", "trades"])
def test_parts_of_what_builds_on_the_bars_grow_with_the_lines(spark, monkeypatch, name):
    want = sorted(map(str, tables.load(spark, DATA, name).collect()))
    monkeypatch.setattr(tables, "LINES", 500)
    got = tables.load(spark, DATA, name)
    parts = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert got.rdd.getNumPartitions() == parts and sorted(map(str, got.collect())) == want
    assert "lineitem" not in got._jdf.queryExecution().toString()  # the bars are computed once


def test_trades_are_computed_once(spark):
    rows = [(f"L{i % 2}", i, "main", float(i % 7 - 3)) for i in range(60)]
    trades, seen = counting(spark, rows, "pattern_id string, series_id long, market string, return_pct double")
    got = evaluation.slice_metrics(trades.withColumn("entry_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("series_id").cast("int"))))
    assert got.collect() and seen.value == len(rows)


def test_features_are_standardised_from_one_computation(spark):
    rows = [(i, p, float((i * 7 + p) % 5)) for i in range(40) for p in range(4)]
    vectors, seen = counting(spark, rows, "series_id long, pos long, value double")
    assert discovery.standardise_features(vectors).count() == len(rows) == seen.value


@pytest.mark.parametrize("apart,ids,files", [(False, ["007", "7", "a,b", " x"], 1), (True, ["007", "7"], 2)])
def test_csv_files_follow_the_tasks(spark, tmp_path, apart, ids, files):
    days = spark.range(61).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    prices = [F.lit(1.5).alias(c) for c in ("open", "high", "low", "close", "vol")]
    bars = spark.createDataFrame([(i,) for i in ids], "series_id string").join(days).select(KEY, "trade_date", *prices)
    sources.write_bars_csv(bars.coalesce(1), str(tmp_path / "csv"), apart)
    got = sources.load_bars_csv(spark, str(tmp_path / "csv")).where("vol = 1.5").groupBy(KEY).agg(F.count("trade_date").alias("n"))
    assert {(r[KEY], r["n"]) for r in got.collect()} == {(i, 61) for i in ids}
    assert len(list((tmp_path / "csv").rglob("part-*.csv"))) == files


def test_a_bar_store_is_written_by_more_tasks_than_buckets(spark, tmp_path):
    days = spark.range(200).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    bars = spark.range(40).select(F.col("id").alias(KEY)).join(days)
    sources.write_bar_store(bars, "many_parts", str(tmp_path / "bars"), 2, 9)
    files = list((tmp_path / "bars").rglob("*.parquet"))
    assert len(files) == 7 * 2 and len({f.name.split("-")[1] for f in files}) > 2  # one for each month and bucket, by several tasks
    got = sources.read_bar_store(spark, "many_parts")
    assert sorted(map(tuple, got.select(KEY, "trade_date").collect())) == sorted(map(tuple, bars.collect()))
    spark.sql("drop table many_parts")
