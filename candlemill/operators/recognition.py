"""Scanning the latest bars against a pattern library, and signals from what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY
from .indicators import tail_array
from .matching import compare_tails, longest_of, pairs_compared, patterns_of


def library_from_points(points: DataFrame) -> DataFrame:
    """Prototypes as arrays, from rows (pattern_id, complexity, frequency, pos, value)."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return points.groupBy("pattern_id", "complexity", "frequency").agg(F.transform(pairs, lambda x: x["value"]).alias("prototype"))


def scan(
    bars: DataFrame, library: DataFrame, levels: tuple[int, ...] = (1, 2, 3), threshold: float = 0.75, least_bars: int = 20
) -> DataFrame:
    """(series_id, pattern_id, complexity, frequency, window_size, similarity) at or above the threshold."""
    patterns = patterns_of(library.where(F.col("complexity").isin(*levels)))
    tails = tail_array(bars, longest_of(patterns, least_bars)).where(F.size("tail") >= least_bars)
    return compare_tails(tails, patterns, threshold)


def scan_work(bars: DataFrame, library: DataFrame, levels: tuple[int, ...] = (1, 2, 3), threshold: float = 0.75, least_bars: int = 20) -> DataFrame:
    """(series_id, pairs, compared): of the prototypes a series is long enough for, how many ``scan`` compares it with."""
    patterns = patterns_of(library.where(F.col("complexity").isin(*levels)))
    tails = tail_array(bars, longest_of(patterns, least_bars)).where(F.size("tail") >= least_bars)
    return pairs_compared(tails.select(KEY, "tail"), patterns, threshold)


def top_matches(matches: DataFrame, k: int = 5, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "complexity", "pattern_id")
    return matches.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def signals(top: DataFrame, expectancy: DataFrame, min_expectancy: float = 0.0) -> DataFrame:
    """One signal per series from its best match, if that pattern has an expectancy of at least the minimum.

    A pattern in the expectancy table whose expectancy is null counts as 0; one that isn't there gives no signal. The second and third match come along; the best one is never replaced by them.
    """
    best = top.where("rank = 1")
    others = top.where("rank in (2, 3)").groupBy(KEY).agg(
        F.max(F.when(F.col("rank") == 2, F.col("pattern_id"))).alias("second_id"),
        F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second_confidence"),
        F.max(F.when(F.col("rank") == 3, F.col("pattern_id"))).alias("third_id"),
        F.max(F.when(F.col("rank") == 3, F.col("similarity"))).alias("third_confidence"),
    )
    known = expectancy.withColumn("expectancy", F.coalesce("expectancy", F.lit(0.0))).where(F.col("expectancy") >= min_expectancy)
    found = best.join(known, "pattern_id").join(others, KEY, "left")
    reward = F.col("risk_reward") if "risk_reward" in expectancy.columns else F.lit(1.0)
    return found.select(
        KEY, "pattern_id", F.col("similarity").alias("confidence"),
        F.coalesce("direction", F.lit("unknown")).alias("direction"),
        F.col("expectancy").alias("expected_return"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce(reward, F.lit(1.0)).alias("risk_reward"),
        F.coalesce("optimal_holding", F.lit(5)).cast("long").alias("optimal_holding"),
        "complexity", "frequency", "second_id", "second_confidence", "third_id", "third_confidence",
    )


def scan_multi_window(
    bars: DataFrame, library: DataFrame, sizes: tuple[int, ...] = (10, 20, 40), slack: int = 5, threshold: float = 0.75, k: int = 5
) -> DataFrame:
    """Per window size the best patterns whose prototype's length is within ``slack`` of it."""
    patterns = patterns_of(library.where(F.col("complexity").isin(2, 3)))
    tails = tail_array(bars, longest_of(patterns, max(20, *sizes))).where(F.size("tail") >= 20).withColumn("bars", F.size("tail"))
    found = compare_tails(tails, patterns, threshold)
    near = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: (F.abs(F.col("window_size") - s) <= slack) & (F.col("bars") >= s))
    return top_matches(found.withColumn("size", F.explode(near)).drop("bars"), k, by=(KEY, "size"))


def match_strength(matches: DataFrame) -> DataFrame:
    bonus = F.when(F.max("complexity") >= 3, 0.2).otherwise(0.0)
    strength = 0.5 * F.max("similarity") + 0.3 * F.least(F.count("*") / 5, F.lit(1.0)) + bonus
    return matches.groupBy(KEY).agg(strength.alias("strength"))


def filter_by_expectancy(matches: DataFrame, expectancy: DataFrame, min_win_rate: float = 0.5, min_expectancy: float = 0.0) -> DataFrame:
    good = expectancy.where((F.col("win_rate") >= min_win_rate) & (F.col("expectancy") >= min_expectancy)).select("pattern_id")
    return matches.join(good, "pattern_id", "left_semi")


def market_scan(found: DataFrame, min_confidence: float = 0.65, n: int = 10) -> DataFrame:
    """The ``n`` signals of highest expected return (a top-k report)."""
    return found.where(F.col("confidence") >= min_confidence).orderBy(F.desc("expected_return"), F.desc("confidence"), KEY).limit(n)
