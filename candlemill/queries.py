"""Every operator as a query over the given tables, through the views of ``sources.tables``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import KEY, ORDER, r6
from .functions.storage import stored, work_path
from .jobs import market
from .operators import cleaning, discovery, evaluation, indicators, matching, neighbours, recognition, serving
from .sources import bars as bar_sources
from .sources import state
from .sources.tables import load, parts_of
from .streaming import bars as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def library(spark: SparkSession, d: str) -> DataFrame:
    return recognition.library_from_points(load(spark, d, "library_points"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def priced(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.trade_returns(load(spark, d, "trades"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.slice_metrics(priced(spark, d))


def moments(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.slice_statistics(evaluation.slice_rows(priced(spark, d)))


def recent(bars: DataFrame, size: Column) -> DataFrame:
    """The last closes of each series, as many as ``size`` says, scaled to 0..1."""
    tails = indicators.tail_array(bars, 8).withColumn("n", size)
    return tails.select(KEY, indicators.scaled(F.slice("tail", F.size("tail") - F.col("n") + 1, F.col("n"))).alias("tail"))


def short_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 4 to 8 closes."""
    return recent(load(spark, d, "bars"), (4 + F.col(KEY) % 5).cast("int"))


# ---------------------------------------------------------------- sources


@query
def bars_load(spark, d):
    got = bar_sources.load_bars(load(spark, d, "bars"), start="1994-01-01", end="1995-12-31")
    return got.select(KEY, "trade_date", ORDER, "open", "high", "low", "close", "vol")


@query
def bars_min_history(spark, d):
    return bar_sources.min_history(load(spark, d, "bars"), 530).select(KEY, "trade_date", "close")


@query
def bars_csv(spark, d):
    """Bars written as CSV by series and read back, those with more than 500 bars."""
    folder = work_path(spark, "bars-csv")
    bar_sources.write_bars_csv(load(spark, d, "bars"), folder)
    return bar_sources.load_bars_csv(spark, folder, 500).select(KEY, "trade_date", "open", "high", "low", "close", "vol")


@query
def bar_store(spark, d):
    """The relative strength of two years read back from a store by month and series."""
    name, path = f"bars_{uuid.uuid4().hex}", work_path(spark, "bar-store")
    parts = parts_of(spark.read.parquet(f"{d}/lineitem.parquet"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 8)  # what is read back is a part of the months
    bar_sources.write_bar_store(load(spark, d, "bars"), name, path, buckets, parts)
    got = indicators.rsi(bar_sources.read_bar_store(spark, name, start="1994-01-01", end="1995-12-31"))
    return rounded(got.select(KEY, "trade_date", ORDER, "rsi"), "rsi")


@query
def state_upsert(spark, d):
    """A stored library and expectancy after an upsert of the patterns of complexity 3, read back."""
    folder, lib = work_path(spark, "state"), library(spark, d)
    state.save_state({"library": lib, "expectancy": load(spark, d, "expectancy")}, folder)
    changed = lib.where("complexity = 3").withColumn("frequency", F.col("frequency") + 100)
    state.upsert_state(spark, {"library": changed}, folder)
    got = state.load_state(spark, folder)
    joined = got["library"].join(got["expectancy"], "pattern_id", "left")
    return joined.select("pattern_id", "frequency", r6(F.col("expectancy")).alias("expectancy"))


@query
def delisted_codes(spark, d):
    path = work_path(spark, "delisted")
    load(spark, d, "delisted").select(F.col(KEY).cast("string")).write.text(path)
    return bar_sources.load_delisted(spark, path)


@query
def library_roundtrip(spark, d):
    path = work_path(spark, "library")
    state.write_library(library(spark, d), path)
    got = state.read_library(spark, path).select("pattern_id", "complexity", "frequency", F.posexplode("prototype").alias("pos", "value"))
    return got.select("pattern_id", F.col("complexity").cast("long").alias("complexity"), "frequency", F.col("pos").cast("long").alias("pos"), "value")


@query
def state_roundtrip(spark, d):
    folder = work_path(spark, "state")
    config = state.config_table(spark, {"top_k": 5, "levels": [2, 3]})
    state.save_state({"library": library(spark, d), "expectancy": load(spark, d, "expectancy"), "config": config}, folder)
    got = state.load_state(spark, folder)
    joined = got["library"].join(got["expectancy"], "pattern_id", "left")
    return joined.select("pattern_id", F.size("prototype").cast("long").alias("len"), r6(F.col("expectancy")).alias("expectancy"), r6(F.col("win_rate")).alias("win_rate"), "rating")


@query
def results_roundtrip(spark, d):
    folder, found = work_path(spark, "backtest"), metrics(spark, d)
    columns = ["pattern_id", "market", "strategy", "holding", "sample_size", "expectancy"]
    state.write_backtest(found.limit(0).select(*columns), folder, "20240101_000000")
    state.write_backtest(found.select(*columns), folder, "20240102_000000")
    return rounded(state.read_latest_backtest(spark, folder), "expectancy").select(*columns)


@query
def system_report(spark, d):
    got = serving.system_report(library(spark, d), load(spark, d, "expectancy"), metrics(spark, d).where("valid"))
    return rounded(got, "value")


# ---------------------------------------------------------------- cleaning


@query
def clean_bars(spark, d):
    return cleaning.clean_bars(load(spark, d, "bars_raw")).select(KEY, "trade_date", ORDER, "open", "high", "low", "close", "vol")


@query
def schema_report(spark, d):
    return cleaning.schema_report(load(spark, d, "bars_raw"))


@query
def ohlc_validity(spark, d):
    return cleaning.flag_invalid_ohlc(load(spark, d, "bars_raw")).select(KEY, "ingest_seq", "is_valid")


@query
def extreme_moves(spark, d):
    valid = cleaning.flag_invalid_ohlc(load(spark, d, "bars_raw")).where("is_valid")
    return rounded(cleaning.flag_extreme_moves(valid, order="ingest_seq").select(KEY, "ingest_seq", "daily_return", "is_adjusted"), "daily_return")


@query
def suspension_gaps(spark, d):
    return cleaning.suspension_gaps(load(spark, d, "bars"))


@query
def validate_report(spark, d):
    return rounded(cleaning.validate_report(load(spark, d, "bars_raw")), "zero_vol_ratio")


@query
def survivorship(spark, d):
    got = cleaning.filter_survivorship(load(spark, d, "bars"), load(spark, d, "delisted"), "1997-06-30", 60)
    return got.select(KEY, "trade_date", "close")


@query
def walk_forward(spark, d):
    return cleaning.walk_forward_splits(load(spark, d, "bars"))


@query
def robustness(spark, d):
    got = cleaning.robustness_summary(stored(priced(spark, d), "trades"), min_train=50)
    return rounded(got, "mean_score", "std_score")


# ---------------------------------------------------------------- indicators


def _lines(spark, d, work, *columns, digits=6):
    got = work(load(spark, d, "bars"))
    return got.select(KEY, ORDER, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in columns])


@query
def true_range(spark, d):
    return _lines(spark, d, indicators.true_range, "tr")


@query
def atr(spark, d):
    return _lines(spark, d, indicators.atr, "atr", digits=4)


@query
def rsi(spark, d):
    return _lines(spark, d, indicators.rsi, "rsi")


@query
def macd(spark, d):
    # the second value of a series is a multiple of 7 / 312 cents: the shift keeps it off rounding ties
    got = indicators.macd(load(spark, d, "bars"))
    return got.select(KEY, ORDER, *[r6(F.col(c) + 1.23e-9).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


@query
def bollinger(spark, d):
    return _lines(spark, d, indicators.bollinger, "bb_mid", "bb_upper", "bb_lower")


@query
def bb_position(spark, d):
    return _lines(spark, d, indicators.bb_position, "bb_position")


@query
def ma_features(spark, d):
    return _lines(spark, d, indicators.ma_features, "ma5_gap", "ma10_gap", "ma20_gap", "ma5_above_10", "ma10_above_20")


@query
def return_stats(spark, d):
    got = indicators.return_stats(load(spark, d, "bars"))
    return rounded(got, *got.columns[1:])


@query
def volume_stats(spark, d):
    got = indicators.volume_stats(load(spark, d, "bars"))
    return rounded(got, *got.columns[1:])


@query
def norm_relative(spark, d):
    return _lines(spark, d, lambda b: indicators.normalise(b, "relative"), "norm")


@query
def norm_structure(spark, d):
    return _lines(spark, d, lambda b: indicators.normalise(b, "structure"), "norm")


@query
def norm_zscore(spark, d):
    return _lines(spark, d, lambda b: indicators.normalise(b, "zscore"), "norm")


@query
def feature_vector(spark, d):
    return rounded(indicators.feature_vector(load(spark, d, "bars")), "value")


@query
def pattern_window(spark, d):
    return rounded(indicators.pattern_window(load(spark, d, "bars"), 100, 140), "value")


@query
def zigzag(spark, d):
    got = indicators.zigzag(load(spark, d, "bars"))
    return got.select(KEY, ORDER, "price", "type", F.col("mark").cast("long").alias("mark"))


@query
def local_extrema(spark, d):
    return indicators.local_extrema(load(spark, d, "bars")).select(KEY, ORDER, "extremum")


@query
def regime(spark, d):
    got = indicators.detect_regime(load(spark, d, "bars")).select(KEY, ORDER, "vol_pct", "strength", "regime")
    return rounded(got, "vol_pct", "strength")


@query
def shape_features(spark, d):
    return rounded(indicators.shape_features(indicators.tail_array(load(spark, d, "bars"), 40)), "value")


# ---------------------------------------------------------------- discovery


@query
def eligible_series(spark, d):
    bars = load(spark, d, "bars")
    return discovery.eligible_series(bars, indicators.feature_vector(bars))


@query
def resample(spark, d):
    got = discovery.resampled(library(spark, d), 16).select("pattern_id", F.posexplode("prototype").alias("pos", "value"))
    return rounded(got.withColumn("pos", F.col("pos").cast("long")), "value")


@query
def pairwise_euclid(spark, d):
    return rounded(discovery.pairwise_euclid(short_windows(spark, d)), "distance")


@query
def pairwise_dtw(spark, d):
    return rounded(discovery.pairwise_dtw(short_windows(spark, d)), "distance")


@query
def near_windows(spark, d):
    """Windows of 4 to 8 closes and how many others lie within a warped distance of 0.5."""
    return neighbours.near_windows(short_windows(spark, d), 0.5)


@query
def nearest_windows(spark, d):
    return rounded(neighbours.nearest_windows(short_windows(spark, d), 3), "distance").withColumn("rank", F.col("rank").cast("long"))


@query
def discover_l2(spark, d):
    return rounded(discovery.discover_simple(short_windows(spark, d)).drop("prototype"), "avg_length", "length_std")


@query
def barycenter(spark, d):
    return rounded(discovery.barycenter(short_windows(spark, d).withColumn("cluster", F.col(KEY) % 7)), "value")


@query
def standardise_features(spark, d):
    return rounded(discovery.standardise_features(indicators.feature_vector(load(spark, d, "bars"))), "value")


@query
def discover_l3(spark, d):
    return discovery.discover_composite(indicators.feature_vector(load(spark, d, "bars"))).drop("prototype")


def _stats_vectors(spark, d):
    """Last return statistics of each series as short vectors."""
    got = indicators.return_stats(load(spark, d, "bars"))
    return got.select(KEY, F.array(*[F.col(c) * 100 for c in got.columns[1:]]).alias("vector"))


def _first_as_centres(vectors: DataFrame, n: int = 5) -> DataFrame:
    first = vectors.orderBy(KEY).limit(n)
    return first.select((F.row_number().over(Window.orderBy(KEY)) - 1).alias("cluster"), F.col("vector").alias("centre"))


@query
def assign_centres(spark, d):
    vectors = _stats_vectors(spark, d)
    assigned = discovery.assign_to_centres(vectors, _first_as_centres(vectors))
    frequent = discovery.frequent_clusters(assigned, 3)
    return rounded(assigned.join(frequent, "cluster").select(KEY, F.col("cluster").cast("long").alias("cluster"), "distance", "frequency"), "distance")


@query
def complex_features(spark, d):
    return rounded(discovery.complex_features(load(spark, d, "bars")), "peak_valley_ratio", "total_variation")


@query
def discover_l4(spark, d):
    return rounded(discovery.cluster_complex(discovery.complex_features(load(spark, d, "bars"))), "peak_valley_ratio", "total_variation")


@query
def representatives(spark, d):
    vectors = discovery.complex_vectors(discovery.complex_features(load(spark, d, "bars")))
    got = discovery.representatives(vectors, _first_as_centres(vectors))
    return got.withColumn("cluster", F.col("cluster").cast("long"))


def _scaled_pairs(spark, d):
    lib = library(spark, d).withColumn("prototype", indicators.scaled(F.col("prototype")))
    return discovery.library_pairs(lib)


@query
def sim_euclidean(spark, d):
    from .functions.arrays import euclidean_similarity

    return _scaled_pairs(spark, d).select("a", "b", r6(euclidean_similarity(F.col("va"), F.col("vb"))).alias("similarity"))


@query
def sim_correlation(spark, d):
    from .functions.arrays import correlation_similarity

    return _scaled_pairs(spark, d).select("a", "b", r6(correlation_similarity(F.col("va"), F.col("vb"))).alias("similarity"))


@query
def sim_dtw(spark, d):
    return rounded(discovery.dtw_similarity(_scaled_pairs(spark, d)).select("a", "b", "similarity"), "similarity")


@query
def merge_library(spark, d):
    old = library(spark, d).select("pattern_id", "complexity", "frequency")
    new = old.where("complexity = 3").withColumn("frequency", F.col("frequency") + 100)
    new = new.unionByName(old.where("complexity = 2").withColumn("pattern_id", F.concat("pattern_id", F.lit("-new"))))
    return discovery.merge_library(old, new).select("pattern_id", F.col("complexity").cast("long").alias("complexity"), "frequency")


@query
def library_stats(spark, d):
    got = discovery.library_stats(library(spark, d))
    return rounded(got.withColumn("complexity", F.col("complexity").cast("long")), "avg_frequency")


# ---------------------------------------------------------------- recognition


def _matches(spark, d):
    return recognition.scan(load(spark, d, "bars"), library(spark, d))


@query
def scan_matches(spark, d):
    return rounded(_matches(spark, d).withColumn("complexity", F.col("complexity").cast("long")), "similarity")


@query
def scan_work(spark, d):
    """How many prototypes each series is long enough for; that no more are compared is part of the result."""
    got = recognition.scan_work(load(spark, d, "bars"), library(spark, d), threshold=0.9)
    return got.select(KEY, "pairs", (F.col("compared") <= F.col("pairs")).alias("within"))


@query
def top_matches(spark, d):
    got = recognition.top_matches(_matches(spark, d))
    return rounded(got.select(KEY, "pattern_id", "similarity", "rank"), "similarity")


SIGNAL = ("pattern_id", "confidence", "direction", "expected_return", "win_rate", "risk_reward", "optimal_holding", "second_id", "third_id")


@query
def signals(spark, d):
    got = recognition.signals(recognition.top_matches(_matches(spark, d)), load(spark, d, "expectancy"))
    return rounded(got.select(KEY, *SIGNAL), "confidence", "expected_return", "win_rate")


@query
def scan_multi_window(spark, d):
    got = recognition.scan_multi_window(load(spark, d, "bars"), library(spark, d))
    return rounded(got.select(KEY, "size", "pattern_id", "similarity", "rank"), "similarity")


@query
def match_strength(spark, d):
    return rounded(recognition.match_strength(_matches(spark, d)), "strength")


@query
def filter_expectancy(spark, d):
    got = recognition.filter_by_expectancy(_matches(spark, d), load(spark, d, "expectancy"))
    return rounded(got.select(KEY, "pattern_id", "similarity"), "similarity")


@query
def batch_recognize(spark, d):
    got = market.batch_recognize(load(spark, d, "bars_raw"), library(spark, d), load(spark, d, "expectancy"))
    return rounded(got.select(KEY, *SIGNAL), "confidence", "expected_return", "win_rate")


@query
def market_scan(spark, d):
    found = market.batch_recognize(load(spark, d, "bars_raw"), library(spark, d), load(spark, d, "expectancy"))
    return rounded(market.scan_report(found).select(KEY, "pattern_id", "confidence", "expected_return"), "confidence", "expected_return")


# ---------------------------------------------------------------- streaming


def _ticks(spark, d):
    """``events`` as a stream of ticks."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, d, schema))
    return raw.select(F.col("user_id").alias(KEY), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def _folder_of(spark, d, schema):
    """A file stream reads folders: the table is written to one."""
    path = work_path(spark, "ticks")
    spark.read.schema(schema).parquet(f"{d}/events.parquet").write.parquet(path)
    return path


def _stream_bars(spark, d):
    bars = streams.bars_of_ticks(_ticks(spark, d))
    return streams.run_once(bars, work_path(spark, "stream-bars"), work_path(spark, "stream-state"))


@query
def stream_bars(spark, d):
    got = _stream_bars(spark, d)
    return rounded(got.select(KEY, F.to_date("bar_start").alias("bar_date"), "open", "high", "low", "close", "vol"), "open", "high", "low", "close", "vol")


@query
def stream_alerts(spark, d):
    lib = library(spark, d)
    ticks, out = _ticks(spark, d), work_path(spark, "alerts")
    query = streams.alert_query(
        ticks, lambda: lib, lambda: load(spark, d, "expectancy"), out, work_path(spark, "alert-state"), streams.closes_needed(lib), {"availableNow": True}
    )
    query.awaitTermination()
    got = streams.alerts_written(spark, out, ticks.schema[KEY].dataType.simpleString())
    return rounded(got.select(KEY, F.to_date("bar_start").alias("bar_date"), "pattern_id", "confidence", "expectancy"), "confidence", "expectancy")


# ---------------------------------------------------------------- evaluation


@query
def history_trades(spark, d):
    got = matching.history_trades(load(spark, d, "bars"), library(spark, d), holding=5, threshold=0.9)
    return rounded(got.select("pattern_id", KEY, ORDER, "entry_date", "exit_date", "similarity", "return_pct"), "similarity", "return_pct")


@query
def trade_returns(spark, d):
    return rounded(priced(spark, d).select("pattern_id", KEY, "entry_date", "direction", "return_pct"), "return_pct")


@query
def strategy_filter(spark, d):
    return evaluation.apply_strategy(priced(spark, d)).select("pattern_id", KEY, "entry_date", "strategy")


@query
def slices(spark, d):
    rows = evaluation.each_holding(evaluation.slice_rows(priced(spark, d)))
    return rows.groupBy("pattern_id", "market", "strategy", "holding").agg(F.count("*").alias("n"))


@query
def holding_return(spark, d):
    got = evaluation.holding_return(load(spark, d, "trades"))
    return rounded(got.select("pattern_id", KEY, "entry_date", "holding", "holding_return"), "holding_return")


METRICS = ("win_rate", "avg_win", "avg_loss", "risk_reward", "expectancy", "net_expectancy", "avg_return", "volatility", "min_return", "max_return", "sharpe_ratio")


@query
def slice_metrics(spark, d):
    keys = (*evaluation.SLICE, "holding")
    return rounded(metrics(spark, d).select(*keys, "n_rows", "sample_size", "valid", "reason", *METRICS), *METRICS)


@query
def slice_sharpe(spark, d):
    got = evaluation.with_sharpe(evaluation.each_holding(moments(spark, d)))
    return rounded(got.select(*evaluation.SLICE, "holding", "sharpe_ratio"), "sharpe_ratio")


@query
def slice_drawdown(spark, d):
    got = evaluation.ordered_risk(evaluation.slice_rows(priced(spark, d)))
    return rounded(got.select(*evaluation.SLICE, "max_drawdown"), "max_drawdown")


@query
def loss_streaks(spark, d):
    return evaluation.ordered_risk(evaluation.slice_rows(priced(spark, d))).select(*evaluation.SLICE, "consecutive_losses")


@query
def slice_moments(spark, d):
    got = moments(spark, d)
    return rounded(got.select(*evaluation.SLICE, "skewness", "kurtosis"), "skewness", "kurtosis")


SCORES = (*evaluation.WEIGHTS, "score")


@query
def pattern_score(spark, d):
    return rounded(evaluation.pattern_score(metrics(spark, d)).select("pattern_id", *SCORES, "rating", "recommendation"), *SCORES)


@query
def scenario_rank(spark, d):
    return rounded(evaluation.rank_scenarios(metrics(spark, d)), "win_rate", "expectancy", "sharpe_ratio")


@query
def dimension_perf(spark, d):
    return rounded(evaluation.dimension_performance(metrics(spark, d)), "avg_expectancy", "avg_win_rate")


REPORT = ("score", "avg_win_rate", "avg_expectancy")


@query
def pattern_report(spark, d):
    trades = stored(priced(spark, d), "trades")
    return rounded(evaluation.pattern_report(trades, evaluation.slice_metrics(trades)), *REPORT)


@query
def expectancy_update(spark, d):
    _, _, updated = market.backtest(load(spark, d, "trades"), load(spark, d, "expectancy"))
    return rounded(updated.withColumn("optimal_holding", F.col("optimal_holding").cast("long")), "expectancy", "win_rate")


@query
def top_patterns(spark, d):
    found, report, _ = market.backtest(load(spark, d, "trades"), load(spark, d, "expectancy"))
    got = evaluation.top_patterns(report, evaluation.rank_scenarios(found), min_rating="D")
    return rounded(got.select("pattern_id", "score", "rating", "best_scenario"), "score")


@query
def regime_weights(spark, d):
    return rounded(evaluation.scores_by_regime(metrics(spark, d)), "score")


# ---------------------------------------------------------------- serving


@query
def status_summary(spark, d):
    return rounded(serving.status_summary(library(spark, d), load(spark, d, "expectancy")), "best_win_rate", "best_expectancy")


@query
def rating_distribution(spark, d):
    return serving.rating_distribution(library(spark, d), load(spark, d, "expectancy"))


@query
def expectancy_histogram(spark, d):
    return serving.histogram(serving.with_expectancy(library(spark, d), load(spark, d, "expectancy")), "win_rate")


@query
def leaderboard(spark, d):
    got = serving.leaderboard(library(spark, d), load(spark, d, "expectancy"))
    return rounded(got.withColumn("complexity", F.col("complexity").cast("long")), "expectancy", "win_rate")


@query
def prototype_points(spark, d):
    return serving.prototype_points(library(spark, d))
