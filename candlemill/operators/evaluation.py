"""Evaluating a pattern's trades over market x strategy x holding-period slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Boards, strategies, holding periods, costs, weights of the scores, ratings.
MARKETS = ("main", "growth", "star", "north")
STRATEGIES = ("chase", "oversold", "trend", "range")
HOLDINGS = (1, 3, 5, 10, 20)
SLICE = ("pattern_id", "market", "strategy")
COMMISSION, SLIPPAGE, MIN_SAMPLES = 0.00025, 0.001, 5
WEIGHTS = {"profitability": 0.25, "consistency": 0.20, "adaptability": 0.15, "risk_control": 0.20, "capacity": 0.10, "timeliness": 0.10}
#: What a market regime adds to the weights.
ADJUSTMENTS = {
    "strong_trend": {"profitability": 0.10, "risk_control": -0.05, "timeliness": 0.05},
    "high_volatility": {"consistency": 0.10, "risk_control": 0.10, "profitability": -0.10, "capacity": -0.05},
    "range_bound": {"adaptability": 0.10, "timeliness": 0.05, "capacity": 0.05},
    "low_volatility": {"consistency": 0.05, "capacity": 0.05, "timeliness": -0.05},
}
RATING_VALUES = {"A": 4.0, "B+": 3.5, "B": 3.0, "C": 2.0, "D": 1.0}


def trade_returns(trades: DataFrame) -> DataFrame:
    """Adds ``return_pct``: the price move in percent, its sign turned unless the trade is long."""
    move = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100
    return trades.withColumn("return_pct", F.when(F.col("direction") == "long", move).otherwise(-move))


def strategies_of(columns: list[str]) -> dict[str, Column]:
    """The four row predicates. An absent column counts as true or false by its predicate; a null value as false."""
    has = set(columns).__contains__

    def test(name: str, condition, absent: bool) -> Column:
        return F.coalesce(condition(F.col(name)), F.lit(False)) if has(name) else F.lit(absent)

    if has("ma20") and has("ma60"):
        rising = F.coalesce(F.col("ma20") > F.col("ma60"), F.lit(False))
    else:
        rising = F.lit(True)
    long_volume = F.col("volume_20d") if has("volume_20d") else F.lit(0.0)
    return {
        "chase": test("trend", lambda c: c == "up", True) & test("adx", lambda c: c > 25, True) & test("rsi", lambda c: c > 50, True),
        "oversold": test("rsi", lambda c: c < 30, False) | test("distance_60ma", lambda c: c < -0.15, False),
        "trend": rising & test("volume_5d", lambda c: c > long_volume, True),
        "range": test("adx", lambda c: c < 25, False) | test("bb_width", lambda c: c < 0.1, False),
    }


def apply_strategy(trades: DataFrame) -> DataFrame:
    """One row per trade and strategy that admits it."""
    named = F.array(*[F.when(ok, F.lit(name)) for name, ok in strategies_of(trades.columns).items()])
    return trades.withColumn("strategy", F.explode(F.array_compact(named)))


def slice_rows(trades: DataFrame, markets: tuple[str, ...] = MARKETS) -> DataFrame:
    """Rows of known markets by strategy; without a market column every trade counts in every market."""
    if "market" in trades.columns:
        trades = trades.where(F.col("market").isin(*markets))
    else:
        trades = trades.withColumn("market", F.explode(F.array(*map(F.lit, markets))))
    return apply_strategy(trades)


def each_holding(df: DataFrame, holdings: tuple[int, ...] = HOLDINGS) -> DataFrame:
    return df.withColumn("holding", F.explode(F.array(*[F.lit(h).cast("long") for h in holdings])))


def holding_return(trades: DataFrame, holdings: tuple[int, ...] = HOLDINGS) -> DataFrame:
    """Return per holding period where trades bring none: the long move, scaled down if the trade was held longer."""
    move = F.when(F.col("entry_price") != 0, (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100).otherwise(0.0)
    share = F.least(F.col("holding") / F.greatest(F.col("holding_days"), F.lit(1)), F.lit(1.0))
    value = F.when(F.col("holding_days") >= F.col("holding"), move * share).otherwise(0.0)
    return each_holding(trades, holdings).withColumn("holding_return", value)


def ordered_risk(rows: DataFrame, keys: tuple[str, ...] = SLICE, date: str = "entry_date", then: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Deepest fall of the running sum of returns below its highest value so far, and the longest run of losses, of each group.

    Both combine over stretches of time, so a group is summed up month by month, in as many tasks as there are months, and
    one fold over its months (few, whatever the number of trades) joins them. Rows without a return are left out.
    """
    rows = rows.where("return_pct is not null").withColumn("__month", F.trunc(date, "month"))
    w = Window.partitionBy(*keys, "__month").orderBy(date, *then).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__sum": F.sum("return_pct").over(w), "__n": F.count("*").over(w)})
    won = F.when(F.col("return_pct") >= 0, F.col("__n"))
    rows = rows.withColumns({"__top": F.max("__sum").over(w), "__run": F.col("__n") - F.coalesce(F.max(won).over(w), F.lit(0).cast("long"))})
    months = rows.groupBy(*keys, "__month").agg(
        F.max_by("__sum", "__n").alias("sum"), F.max("__sum").alias("top"), F.min("__sum").alias("low"), F.min(F.col("__sum") - F.col("__top")).alias("fall"),
        F.count("*").alias("n"), (F.coalesce(F.min(won) - 1, F.count("*"))).alias("lead"), F.max_by("__run", "__n").alias("tail"), F.max("__run").alias("longest"),
    )
    parts = ("sum", "top", "low", "fall", "n", "lead", "tail", "longest")
    whole = months.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__month", *parts))).alias("__months"))
    bare = F.transform("__months", lambda m: F.struct(*[m[c].alias(c) for c in parts]))

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            (a["sum"] + b["sum"]).alias("sum"), F.greatest(a["top"], a["sum"] + b["top"]).alias("top"), F.least(a["low"], a["sum"] + b["low"]).alias("low"),
            F.least(a["fall"], b["fall"], a["sum"] + b["low"] - a["top"]).alias("fall"), (a["n"] + b["n"]).alias("n"),
            F.when(a["lead"] < a["n"], a["lead"]).otherwise(a["n"] + b["lead"]).alias("lead"),
            F.when(b["tail"] < b["n"], b["tail"]).otherwise(b["n"] + a["tail"]).alias("tail"),
            F.greatest(a["longest"], b["longest"], a["tail"] + b["lead"]).alias("longest"),
        )

    whole = whole.withColumn("__all", F.reduce(F.slice(bare, 2, F.greatest(F.size("__months") - 1, F.lit(0))), bare[0], join))
    return whole.select(*keys, F.col("__all.fall").alias("max_drawdown"), F.col("__all.longest").alias("consecutive_losses"))


def slice_statistics(rows: DataFrame, keys: tuple[str, ...] = SLICE) -> DataFrame:
    """Conditional aggregates of each slice; holding periods share them."""
    r, n = F.col("return_pct"), F.count("return_pct")
    wins, losses = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, r))
    g1, g2 = F.skewness(r), F.kurtosis(r)
    nd = n.cast("double")
    skew = F.when((n > 2) & (F.stddev_pop(r) > 0), g1 * F.sqrt(nd * (nd - 1)) / F.nullif(nd - 2, F.lit(0.0)))
    kurt = F.when(
        (n > 3) & (F.stddev_pop(r) > 0), (nd - 1) / F.nullif((nd - 2) * (nd - 3), F.lit(0.0)) * ((nd + 1) * g2 + 6)
    )
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), n.alias("sample_size"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("win_rate"),
        F.coalesce(wins, F.lit(0.0)).alias("avg_win"), F.coalesce(losses, F.lit(0.0)).alias("avg_loss"),
        F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("volatility"),
        F.min(r).alias("min_return"), F.max(r).alias("max_return"),
        F.coalesce(skew, F.lit(0.0)).alias("skewness"), F.coalesce(kurt, F.lit(0.0)).alias("kurtosis"),
    )


def slice_metrics(trades: DataFrame, holdings: tuple[int, ...] = HOLDINGS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """All figures of every (pattern, market, strategy, holding) slice; ``valid`` and ``reason`` say which count.

    Everything but the Sharpe ratio is the same for all holding periods, so it is computed
    once per (pattern, market, strategy) and repeated last. The rows of the slices are stored: statistics and ordered risk read them.
    """
    rows = stored(slice_rows(trades).select(*SLICE, "entry_date", "series_id", "return_pct"), "slices")
    stats = figures_of(slice_statistics(rows).join(ordered_risk(rows), list(SLICE), "left"), min_samples)
    return with_sharpe(each_holding(stats, holdings))


def figures_of(stats: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    valid = (F.col("n_rows") >= min_samples) & (F.col("sample_size") > 0)
    reason = F.when(F.col("n_rows") < min_samples, "too few rows").when(F.col("sample_size") == 0, "no returns").otherwise("ok")
    cost = (2 * COMMISSION + 2 * SLIPPAGE) * 100
    return stats.withColumns(
        {
            "valid": valid,
            "reason": reason,
            "risk_reward": F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_win") / F.col("avg_loss"))).otherwise(999.0),
            "expectancy": F.col("win_rate") * F.col("avg_win") - (1 - F.col("win_rate")) * F.abs("avg_loss"),
            "net_expectancy": F.col("avg_return") - cost,
        }
    )


def with_sharpe(figures: DataFrame) -> DataFrame:
    """Needs avg_return, volatility and holding."""
    yearly = F.sqrt(252 / F.greatest(F.col("holding"), F.lit(1)))
    sharpe = F.when(F.col("volatility") > 0, F.col("avg_return") / (F.col("volatility") + 1e-10) * yearly).otherwise(0.0)
    return figures.withColumn("sharpe_ratio", sharpe)


def scenario() -> Column:
    return F.concat_ws("_", "market", "strategy", F.concat(F.lit("T+"), F.col("holding")))


def unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def first_day(exact: bool) -> Column:
    """Slices that count as T+1: by prefix, as T+10 does too, or exactly."""
    return F.col("holding") == 1 if exact else F.col("holding").cast("string").startswith("1")


def pattern_score(metrics: DataFrame, weights: dict[str, float] | None = None, exact_period: bool = False) -> DataFrame:
    """Six scores in 0..1 over a pattern's valid slices, their weighted sum, rating and advice; trades and means beside them."""
    weights = weights or WEIGHTS
    early = F.avg(F.when(first_day(exact_period), F.col("expectancy")))
    scores = metrics.where("valid").groupBy("pattern_id").agg(
        unit(F.avg("expectancy") / 5 + 0.5).alias("profitability"),
        unit(F.avg("sharpe_ratio") / 2 + 0.5).alias("consistency"),
        unit(1 - F.stddev_pop("expectancy") / 5).alias("adaptability"),
        unit(1 + F.avg("max_drawdown") / 20).alias("risk_control"),
        F.least(F.lit(1.0), F.sum("sample_size") / 500).alias("capacity"),
        F.coalesce(unit(early / 3 + 0.5), F.lit(0.5)).alias("timeliness"),
        F.sum("sample_size").alias("total_trades"), (F.avg("win_rate") * 100).alias("avg_win_rate"), F.avg("expectancy").alias("avg_expectancy"),
    )
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return rate(scores.withColumn("score", score))


def rate(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    rating = F.when(s >= 0.8, "A").when((s >= 0.6) & (F.col("adaptability") >= 0.7), "B+").when(s >= 0.6, "B").when(s >= 0.4, "C").otherwise("D")
    advice = {"A": "core", "B+": "complement", "B": "situational", "C": "watch", "D": "drop"}
    text = F.create_map(*[F.lit(x) for kv in advice.items() for x in kv])
    return scores.withColumn("rating", rating).withColumn("recommendation", text[F.col("rating")])


def rank_scenarios(metrics: DataFrame, best: int = 5, worst: int = 3) -> DataFrame:
    """Best and worst slices of each pattern by expectancy."""
    valid = metrics.where("valid").withColumn("scenario", scenario())
    up = Window.partitionBy("pattern_id").orderBy(F.desc("expectancy"), "scenario")
    down = Window.partitionBy("pattern_id").orderBy(F.asc("expectancy"), F.desc("scenario"))
    valid = valid.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    kinds = F.array_compact(F.array(F.when(F.col("up") <= best, F.struct(F.lit("best").alias("kind"), F.col("up").alias("rank"))), F.when(F.col("down") <= worst, F.struct(F.lit("worst").alias("kind"), F.col("down").alias("rank")))))
    return valid.withColumn("k", F.explode(kinds)).select(
        "pattern_id", "k.kind", F.col("k.rank").cast("long").alias("rank"), "scenario", "win_rate", "expectancy", "sharpe_ratio", "sample_size"
    )


def dimension_performance(metrics: DataFrame, exact_period: bool = False, holdings: tuple[int, ...] = HOLDINGS) -> DataFrame:
    """Mean expectancy and win rate and the number of slices by market, strategy and period."""
    valid = metrics.where("valid")
    period = F.array(*[F.when((F.col("holding") == h) if exact_period else F.col("holding").cast("string").startswith(str(h)), F.lit(f"T+{h}")) for h in holdings])
    members = F.concat(
        F.array(F.struct(F.lit("market").alias("dimension"), F.col("market").alias("value")), F.struct(F.lit("strategy").alias("dimension"), F.col("strategy").alias("value"))),
        F.transform(F.array_compact(period), lambda p: F.struct(F.lit("period").alias("dimension"), p.alias("value"))),
    )
    return valid.withColumn("d", F.explode(members)).groupBy("pattern_id", "d.dimension", "d.value").agg(
        F.avg("expectancy").alias("avg_expectancy"), (F.avg("win_rate") * 100).alias("avg_win_rate"), F.count("*").alias("scenario_count")
    )


def pattern_report(trades: DataFrame, metrics: DataFrame, min_trades: int = 5) -> DataFrame:
    """Status, score, rating and means of every pattern with enough trades."""
    counted = trades.groupBy("pattern_id").agg(F.count("*").alias("n_trades")).where(F.col("n_trades") >= min_trades)
    out = counted.join(pattern_score(metrics), "pattern_id", "left")
    status = F.when(F.col("score").isNull(), "INSUFFICIENT_DATA").otherwise("VALIDATED")
    return out.withColumn("status", status).select(
        "pattern_id", "status", "score", "rating", "n_trades", "total_trades", "avg_win_rate", "avg_expectancy"
    )


def update_expectancy(old: DataFrame, report: DataFrame) -> DataFrame:
    """Validated patterns get their score as expectancy; others keep what they had."""
    new = report.where("status = 'VALIDATED'").select(
        "pattern_id", F.col("score").alias("expectancy"), (F.col("avg_win_rate") / 100).alias("win_rate"),
        F.lit("long").alias("direction"), F.lit(5).alias("optimal_holding"), "rating",
    )
    return old.join(new, "pattern_id", "left_anti").select(*new.columns).unionByName(new)


def rating_value(rating: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in RATING_VALUES.items() for x in kv])
    return known[rating]


def top_patterns(report: DataFrame, scenarios: DataFrame, min_rating: str = "B", limit: int = 10) -> DataFrame:
    """Validated patterns of at least a rating by score, with their best scenario (a top-k report)."""
    best = scenarios.where("kind = 'best' and rank = 1").select("pattern_id", F.col("scenario").alias("best_scenario"))
    good = report.where((F.col("status") == "VALIDATED") & (F.coalesce(rating_value(F.col("rating")), F.lit(0.0)) >= RATING_VALUES.get(min_rating, 3.0)))
    return good.join(best, "pattern_id", "left").orderBy(F.desc("score"), "pattern_id").limit(limit)


def regime_weights(regime: str) -> dict[str, float]:
    """Weights of the six scores in a market regime, summing to one, three decimals; the plain ones if it is unknown."""
    if regime not in ADJUSTMENTS:
        return dict(WEIGHTS)
    moved = {k: w + ADJUSTMENTS[regime].get(k, 0.0) for k, w in WEIGHTS.items()}
    return {k: round(w / sum(moved.values()), 3) for k, w in moved.items()}


def scores_by_regime(metrics: DataFrame) -> DataFrame:
    """Every pattern's weighted score under each regime's weights."""
    scores = pattern_score(metrics)
    each = [
        F.struct(F.lit(name).alias("regime"), sum((F.col(k) * w for k, w in regime_weights(name).items()), F.lit(0.0)).alias("score"))
        for name in ("normal", *ADJUSTMENTS)
    ]
    return scores.select("pattern_id", F.explode(F.array(*each)).alias("r")).select("pattern_id", "r.regime", "r.score")
