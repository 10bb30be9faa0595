"""Ticks to alerts in one query: restarts, late ticks and a library that changes."""

import datetime

import numpy as np
import pytest

from candlemill.functions.columns import KEY
from candlemill.streaming import bars as streams

TICK = f"{KEY} bigint, ts timestamp, event_id bigint, price double, size double"
DAY = datetime.datetime(2024, 1, 1)
UP = [float(x) for x in np.linspace(0, 1, 20)]


def write_ticks(spark, folder, days, late=()):
    rows = [(k, DAY + datetime.timedelta(days=d, hours=9 + h), d * 10 + h, 100.0 + d * (3 - k) + h, 1.0) for d in days for k in (1, 2) for h in (0, 5)]
    spark.createDataFrame([*rows, *late], TICK).coalesce(1).write.mode("append").parquet(folder)


def tables(spark):
    library = spark.createDataFrame([("up", 2, 5, UP)], "pattern_id string, complexity int, frequency long, prototype array<double>")
    expectancy = spark.createDataFrame([("up", 0.5, 0.6), ("other", 0.1, 0.5)], "pattern_id string, expectancy double, win_rate double")
    return library, expectancy


def run(spark, base, name, library, expectancy):
    ticks = spark.readStream.schema(TICK).parquet(f"{base}/ticks")
    query = streams.alert_query(ticks, library, expectancy, f"{base}/{name}", f"{base}/{name}-state", 20, {"availableNow": True})
    query.awaitTermination()
    return query


def alerts(spark, base, name):
    got = streams.alerts_written(spark, f"{base}/{name}").collect()
    return sorted((r[KEY], r["bar_start"], r["pattern_id"], round(r["confidence"], 6)) for r in got)


def test_restart_neither_loses_nor_repeats_alerts(spark, tmp_path):
    base, (library, expectancy) = str(tmp_path), tables(spark)
    calls = {"n": 0}

    def failing():
        calls["n"] += 1
        if calls["n"] == 2:
            raise RuntimeError("lost")
        return library

    for first, last in ((0, 24), (24, 28), (28, 33)):
        late = [(1, DAY + datetime.timedelta(days=2), 999, 9e9, 1.0)] if first else []
        write_ticks(spark, f"{base}/ticks", range(first, last), late)
        for _ in range(2):  # a batch that fails is run again
            try:
                run(spark, base, "hurt", failing, lambda: expectancy)
                break
            except Exception as e:
                assert "lost" in str(e)
        run(spark, base, "whole", lambda: library, lambda: expectancy)
    got = alerts(spark, base, "hurt")
    assert calls["n"] > 3 and got == alerts(spark, base, "whole")
    assert len(set(got)) == len(got)
    # the last day is open; a tail of 20 closes is there from day 19 on, and the late price changed nothing
    assert {(k, s) for k, s, *_ in got} == {(k, DAY + datetime.timedelta(days=d)) for k in (1, 2) for d in range(19, 32)}
    assert min(c for *_, c in got) > 0.99


def test_library_may_change_between_batches(spark, tmp_path):
    base, (library, expectancy) = str(tmp_path), tables(spark)
    write_ticks(spark, f"{base}/ticks", range(0, 24))
    run(spark, base, "a", lambda: library, lambda: expectancy)
    other = library.selectExpr("'other' pattern_id", "complexity", "frequency", "prototype")
    write_ticks(spark, f"{base}/ticks", range(24, 28))
    run(spark, base, "a", lambda: other, lambda: expectancy)
    names = {p for _, s, p, _ in alerts(spark, base, "a") if s >= DAY + datetime.timedelta(days=24)}
    assert names == {"other"} and {p for *_, p, _ in alerts(spark, base, "a")} == {"up", "other"}


def test_a_batch_is_computed_in_one_go(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    batch = spark.range(0, 40, 1, 8).mapInPandas(count, "id long").persist()
    assert streams.any_rows(batch) and seen.value == 40  # one partition after the other would stop at the first
    assert batch.count() == seen.value == 40 and not streams.any_rows(batch.where("id < 0"))
    batch.unpersist()
