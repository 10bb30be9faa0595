"""Cleaning, validation and splitting of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, ORDER, by_series

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "vol")


def clean_bars(bars: DataFrame, key: str = KEY, date: str = "trade_date", ingest: str = "ingest_seq") -> DataFrame:
    """First row of each date in ingest order, then rows with all prices, then moves under 20 %; renumbered by date."""
    first = Window.partitionBy(key, date).orderBy(ingest)
    out = bars.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank").dropna(subset=list(PRICES))
    if "pct_chg" in out.columns:
        out = out.where(F.abs("pct_chg") < 20)
    return out.withColumn(ORDER, F.row_number().over(Window.partitionBy(key).orderBy(date)).cast("long"))


def standardise_columns(bars: DataFrame) -> DataFrame:
    """Lower-case names; volume under its short name."""
    out = bars.toDF(*[c.lower() for c in bars.columns])
    return out.withColumnRenamed("volume", "vol") if "vol" not in out.columns else out


def schema_report(bars: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row per required column: whether it is present, rows and nulls."""
    df = standardise_columns(bars)
    counts = [(F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in required]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col(c).alias("n_null")) for c in required])
    one = df.agg(F.count("*").alias("n_rows"), *counts)
    return one.select("n_rows", F.explode(rows).alias("r")).select("r.column_name", "r.present", "n_rows", "r.n_null")


def valid_ohlc():
    """High and low enclose the other prices, close and open are positive; a null makes it invalid."""
    high, low, close, open_ = (F.col(c) for c in ("high", "low", "close", "open"))
    holds = (high >= F.greatest(open_, close, low)) & (low <= F.least(open_, close, high)) & (close > 0) & (open_ > 0)
    whole = high.isNotNull() & low.isNotNull() & close.isNotNull() & open_.isNotNull()
    return F.coalesce(holds & whole, F.lit(False))


def flag_invalid_ohlc(bars: DataFrame) -> DataFrame:
    return bars.withColumn("is_valid", valid_ohlc())


def flag_extreme_moves(bars: DataFrame, limit: float = 0.20, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Return against the row before, and whether it is beyond the limit (the first row isn't)."""
    move = F.col("close") / F.lag("close").over(by_series(key, order)) - 1
    return bars.withColumn("daily_return", move).withColumn("is_adjusted", F.coalesce(F.abs("daily_return") > limit, F.lit(False)))


def suspension_gaps(bars: DataFrame, days: int = 5, key: str = KEY, date: str = "trade_date") -> DataFrame:
    """Per series the number of calendar gaps of more than ``days`` days, and the widest gap."""
    gap = F.datediff(date, F.lag(date).over(Window.partitionBy(key).orderBy(date)))
    return bars.withColumn("gap", gap).groupBy(key).agg(
        F.count_if(F.col("gap") > days).alias("n_gaps"), F.max("gap").cast("long").alias("max_gap")
    )


def require_min_bars(bars: DataFrame, least: int, key: str = KEY) -> DataFrame:
    enough = bars.groupBy(key).count().where(F.col("count") >= least).select(key)
    return bars.join(enough, key, "left_semi")


def validate_report(bars: DataFrame, key: str = KEY, ingest: str = "ingest_seq", least: int = 20) -> DataFrame:
    """Per series: counts of invalid rows, extreme moves and gaps among the valid ones, zero-volume share, verdict."""
    flagged = flag_invalid_ohlc(bars)
    total = flagged.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("is_valid")).alias("n_invalid"))
    valid = flag_extreme_moves(flagged.where("is_valid"), key=key, order=ingest)
    gap = F.datediff("trade_date", F.lag("trade_date").over(Window.partitionBy(key).orderBy(ingest)))
    seen = valid.withColumn("gap", gap).groupBy(key).agg(
        F.count("*").alias("n_bars"),
        F.count_if("is_adjusted").alias("n_extreme"),
        F.count_if(F.col("gap") > 5).alias("n_gaps"),
        F.avg(F.when(F.col("vol") == 0, 1.0).otherwise(0.0)).alias("zero_vol_ratio"),
    )
    out = total.join(seen, key, "left").na.fill(0, ["n_bars", "n_extreme", "n_gaps"]).na.fill(0.0, ["zero_vol_ratio"])
    passed = F.col("n_bars") >= least
    reason = F.when(~passed, "too few bars").when(F.col("zero_vol_ratio") > 0.1, "many bars without volume").otherwise("ok")
    return out.withColumn("passed", passed).withColumn("reason", reason)


def filter_survivorship(bars: DataFrame, delisted: DataFrame, as_of: str, least: int = 60, key: str = KEY) -> DataFrame:
    """Rows up to a date of series that aren't delisted and have enough such rows."""
    alive = bars.join(delisted, key, "left_anti").where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    return require_min_bars(alive, least, key)


def walk_forward_splits(
    rows: DataFrame, key: str = KEY, order: str = ORDER, oos_ratio: float = 0.3, n_splits: int = 5, min_train: int = 100
) -> DataFrame:
    """Per series and split: training rows [0, n_train), test rows [n_train, n_train + n_test) in order."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    size = F.floor(F.col("n") * F.lit(oos_ratio) / F.lit(n_splits)).cast("long")
    return (
        n.withColumn("n_test", size)
        .withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))))
        .withColumn("n_train", F.col("n") - (F.lit(n_splits) - F.col("split")) * F.col("n_test"))
        .where(F.col("n_train") >= min_train)
        .select(key, "split", "n_train", "n_test")
    )


def numbered_by_date(rows: DataFrame, key: str, date: str, then: str) -> DataFrame:
    """Adds ``seq``, each row's number within its key by date and ``then``.

    Rows are numbered within a date, and a date's rows before it are counted from one row a date, so a key's rows needn't meet in one task.
    """
    days = rows.groupBy(key, date).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col(key).alias("__key"), F.col(date).alias("__date"), F.coalesce(before, F.lit(0).cast("long")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, date).orderBy(then))
    own = rows.withColumn("__at", inside).join(days, F.col(key).eqNullSafe(F.col("__key")) & F.col(date).eqNullSafe(F.col("__date")))
    return own.withColumn("seq", F.col("__before") + F.col("__at")).drop("__at", "__before", "__key", "__date")


def robustness_summary(trades: DataFrame, key: str = "pattern_id", n_splits: int = 5, min_train: int = 100) -> DataFrame:
    """Mean and population deviation over walk-forward test parts of the mean trade return; 0 without parts."""
    numbered = numbered_by_date(trades, key, "entry_date", "series_id")
    splits = walk_forward_splits(numbered, key=key, n_splits=n_splits, min_train=min_train)
    inside = (F.col("seq") > F.col("n_train")) & (F.col("seq") <= F.col("n_train") + F.col("n_test"))
    scores = numbered.join(splits, key).where(inside).groupBy(key, "split").agg(F.avg("return_pct").alias("score"))
    out = scores.groupBy(key).agg(F.count("*").alias("n_splits"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    known = trades.select(key).distinct()
    return known.join(out, key, "left").na.fill(0, ["n_splits"]).na.fill(0.0, ["mean_score", "std_score"])
