"""End-to-end jobs: discovery and recognition over the whole market, and backtest to expectancy."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEY
from ..functions.storage import stored
from ..operators import cleaning, discovery, evaluation, indicators, matching, recognition


@dataclass(frozen=True)
class Config:
    """Every setting has its own default, whichever others are given."""

    similarity_threshold: float = 0.75
    top_k: int = 5
    levels: tuple[int, ...] = (2, 3)
    least_bars: int = 20
    min_expectancy: float = 0.0
    min_samples: int = evaluation.MIN_SAMPLES
    holdings: tuple[int, ...] = evaluation.HOLDINGS
    window_bars: int = 8
    max_clusters: int = 10
    min_frequency: int = 3
    discover_levels: tuple[int, ...] = (2, 3, 4)
    complex_bars: int = 60

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From settings by name, as a stored config table holds them (lists become tuples); an unknown name is an error."""
        if unknown := settings.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


LIBRARY = ("pattern_id", "complexity", "frequency", "prototype")
#: A list of series up to this many is broadcast.
MOST_BROADCAST = 1_000_000


def batch_recognize(raw_bars: DataFrame, library: DataFrame, expectancy: DataFrame, config: Config = Config()) -> DataFrame:
    """Cleans bars, scans the library, keeps the best matches, and signals; series without a signal stay with nulls.

    One shuffle by series serves cleaning, tails, ranking and the final join.
    """
    bars = cleaning.clean_bars(raw_bars)
    matches = recognition.scan(bars, library, config.levels, config.similarity_threshold, config.least_bars)
    found = recognition.signals(recognition.top_matches(matches, config.top_k), expectancy, config.min_expectancy)
    return raw_bars.select(KEY).distinct().join(found, KEY, "left")


def backtest(trades: DataFrame, old_expectancy: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slice metrics (computed once), pattern reports and the updated expectancy table."""
    priced = stored(evaluation.trade_returns(trades) if "return_pct" not in trades.columns else trades, "trades")
    metrics = stored(evaluation.slice_metrics(priced, config.holdings, config.min_samples), "metrics")
    report = evaluation.pattern_report(priced, metrics)
    return metrics, report, evaluation.update_expectancy(old_expectancy, report)


def backtest_history(
    bars: DataFrame, library: DataFrame, old_expectancy: DataFrame, holding: int = 5, threshold: float = 0.9, config: Config = Config()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Backtest of the trades that come from matching the library with the whole history; they count in every market."""
    return backtest(matching.history_trades(bars, library, holding, threshold), old_expectancy, config)


def discover(raw_bars: DataFrame, library: DataFrame, config: Config = Config()) -> DataFrame:
    """The library with the patterns found in a market: cleaned bars, then, of series fit for it, clusters of short windows, of feature vectors and of turning points.

    The closes of a series that count are its last ``window_bars`` (L2) and ``complex_bars`` (L4). New patterns replace old ones of their id.
    """
    bars = stored(cleaning.clean_bars(raw_bars), "bars")
    vectors = stored(indicators.feature_vector(bars), "features")
    fit = stored(discovery.eligible_series(bars, vectors, config.least_bars).where("eligible").select(KEY), "eligible")
    few = F.broadcast(fit) if fit.count() <= MOST_BROADCAST else fit
    own, found = bars.join(few, KEY, "left_semi"), library.select(*LIBRARY).limit(0)
    if 2 in config.discover_levels:
        tails = indicators.tail_array(own, config.window_bars).select(KEY, indicators.scaled(F.col("tail")).alias("tail"))
        found = found.unionByName(discovery.discover_simple(tails, config.max_clusters, config.min_frequency).select(*LIBRARY))
    if 3 in config.discover_levels:
        chosen = vectors.join(few, KEY, "left_semi")
        found = found.unionByName(discovery.discover_composite(chosen, config.max_clusters, config.min_frequency).select(*LIBRARY))
    if 4 in config.discover_levels:
        found = found.unionByName(discovery.discover_complex(own, config.max_clusters, config.min_frequency, config.complex_bars).select(*LIBRARY))
    return discovery.merge_library(library.select(*LIBRARY), found)


def scan_report(signals: DataFrame, min_confidence: float = 0.65, n: int = 10) -> DataFrame:
    return recognition.market_scan(signals.where(F.col("pattern_id").isNotNull()), min_confidence, n)
