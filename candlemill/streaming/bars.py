"""Bars from ticks as a stream, and alerts on finished bars."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import KEY
from ..operators.matching import compare_tails, longest_of, patterns_of
from ..operators.recognition import top_matches

STATE = "starts array<long>, ends array<long>, times array<long>, ids array<long>, prices array<double>, closes array<double>, last long"
TICK = ("start", "end", "at", "event_id", "price")
#: Milliseconds of event time after which a series without bars is forgotten.
IDLE = 30 * 86_400_000
ALERT = KEY + " {kind}, bar_start timestamp, pattern_id string, confidence double, expectancy double, win_rate double"


def bars_of_ticks(ticks: DataFrame, bar: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Open, high, low, close and volume of each series and tumbling window; ties in time go by event_id.

    Works on a stream (append: a bar appears once the watermark has passed it) and on a table.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    at = F.struct("ts", "event_id")
    out = timed.groupBy(KEY, F.window("ts", bar).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("vol")
    )
    return out.select(KEY, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "vol")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def ticks_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def new_path(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def closes_needed(library: DataFrame, least: int = 30) -> int:
    """As many closes as the longest prototype has, and no fewer than ``least``."""
    return longest_of(patterns_of(library), least)


def tails_of_ticks(ticks: DataFrame, longest: int, bar: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The last closes of each series after every finished bar, from a stream of ticks with keyed state of bounded size.

    State holds the last tick of each open bar and the last ``longest`` closes. A bar ends when the watermark has passed it, by a timer where no tick
    comes; its close is that of ``bars_of_ticks``. Bars of a series finish in order of their time; a series without bars for 30 days of event time
    is forgotten. Ticks behind the watermark and those without a time or price count nowhere. Ids may be of any type.
    """
    schema = f"{KEY} {ticks.schema[KEY].dataType.simpleString()}, bar_start long, tail array<double>"
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null and price is not null").withWatermark("ts", lateness)
    timed = timed.select(KEY, "ts", "event_id", F.col("price").cast("double").alias("price"), F.window("ts", bar).alias("w"))
    timed = timed.select(
        KEY, "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "price",
        F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"),
    )

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [], [], 0)
        bars = {start: tuple(rest) for start, *rest in zip(*held[:5])}  # start: end, time, event and price of the last tick
        closes, last = list(held[5]), held[6]
        for part in parts:  # of a timer it is empty; a series has few ticks a batch, for which lists are faster than pandas
            for start, *tick in zip(*(part[c].tolist() for c in TICK)) if len(part) else ():
                if start not in bars or tuple(tick[1:3]) > bars[start][1:3]:
                    bars[start] = tuple(tick)
        mark, rows = state.getCurrentWatermarkMs(), []
        for start in sorted(s for s, (end, *_) in bars.items() if end <= 1000 * mark):
            closes, last = [*closes, float(bars.pop(start)[3])][-longest:], start
            rows.append((key[0], start, closes))
        if not bars and last // 1000 + IDLE <= mark:
            state.remove()
        else:
            columns = [list(c) for c in zip(*((s, *t) for s, t in bars.items()))] or [[]] * 5
            state.update((*columns, closes, last))
            until = min(end for end, *_ in bars.values()) // 1000 - 1 if bars else last // 1000 + IDLE
            state.setTimeoutTimestamp(max(until, mark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[KEY, "bar_start", "tail"])

    found = timed.groupBy(KEY).applyInPandasWithState(update, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("bar_start", F.timestamp_micros("bar_start"))


def alerts_of_tails(tails: DataFrame, library: DataFrame, expectancy: DataFrame, min_confidence: float = 0.7, least_bars: int = 20) -> DataFrame:
    """A signal above the confidence for every finished bar whose tail is long enough."""
    found = compare_tails(tails.where(F.size("tail") >= least_bars), patterns_of(library), 0.75)
    best = top_matches(found, 1, by=(KEY, "bar_start"))
    known = expectancy.withColumn("expectancy", F.coalesce("expectancy", F.lit(0.0))).where("expectancy >= 0")
    good = best.join(known, "pattern_id").where(F.col("similarity") > min_confidence)
    return good.select(KEY, "bar_start", "pattern_id", F.col("similarity").alias("confidence"), "expectancy", "win_rate")


def any_rows(batch: DataFrame) -> bool:
    """Whether a persisted batch has rows. All its partitions are computed side by side; ``take`` would go over them one, four, twenty at a time."""
    return batch.count() > 0


def alert_query(
    ticks: DataFrame, library: Callable[[], DataFrame], expectancy: Callable[[], DataFrame], out: str, checkpoint: str, longest: int,
    trigger: dict | None = None, bar: str = "1 day", lateness: str = "1 hour", min_confidence: float = 0.7, least_bars: int = 20,
) -> StreamingQuery:
    """One continuous query from ticks to alerts: bars, the last ``longest`` closes of each series, matches with the library, alerts.

    ``library`` and ``expectancy`` are called for every batch, so both may change while the query runs (prototypes longer than ``longest`` never
    match). A batch's alerts go to a folder of its number, which a batch that is run again after a failure overwrites; its ticks and state are
    those of the first time, so no alert is lost or written twice. Ticks behind the watermark count nowhere. ``alerts_written`` reads the alerts.
    """
    tails = tails_of_ticks(ticks, longest, bar, lateness)
    spark, kind = ticks.sparkSession, ticks.schema[KEY].dataType.simpleString()
    spark.createDataFrame([], ALERT.format(kind=kind)).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if any_rows(batch):
                found = alerts_of_tails(batch, library(), expectancy(), min_confidence, least_bars)
                found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    stream = tails.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (stream.trigger(**trigger) if trigger else stream).start()


def alerts_written(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"{ALERT.format(kind=kind)}, batch long").parquet(out)
