"""Small serving aggregates over the library and the expectancy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import rating_value


def status_summary(library: DataFrame, expectancy: DataFrame) -> DataFrame:
    """Counts, the pattern of highest positive expectancy (first of equals), and the best win rate."""
    lib = library.agg(F.count("*").alias("n_patterns"))
    first = expectancy.where("expectancy > 0").orderBy(F.desc("expectancy"), "pattern_id").limit(1)
    first = first.agg(F.first("pattern_id").alias("best_pattern"), F.first("expectancy").alias("best_expectancy"))
    rest = expectancy.agg(F.count("*").alias("n_expectancy"), F.max("win_rate").alias("best_win_rate"))
    return lib.join(rest).join(first)


def rating_distribution(library: DataFrame, expectancy: DataFrame) -> DataFrame:
    joined = library.join(expectancy.select("pattern_id", "rating"), "pattern_id", "left")
    return joined.groupBy(F.coalesce("rating", F.lit("N/A")).alias("rating")).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins between least and greatest value, the last one closed; empty bins left out."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return values.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def with_expectancy(library: DataFrame, expectancy: DataFrame) -> DataFrame:
    out = library.join(expectancy.select("pattern_id", "expectancy", "win_rate", "rating"), "pattern_id", "left")
    return out.na.fill(0.0, ["expectancy", "win_rate"])


def leaderboard(library: DataFrame, expectancy: DataFrame, top_n: int = 20) -> DataFrame:
    """Numbered patterns by expectancy, the missing ones as 0 (a top-k report)."""
    top = with_expectancy(library, expectancy).orderBy(F.desc("expectancy"), "pattern_id").limit(top_n)
    place = F.row_number().over(Window.orderBy(F.desc("expectancy"), "pattern_id")).cast("long")
    return top.select(place.alias("place"), "pattern_id", "complexity", "frequency", "expectancy", "win_rate", F.coalesce("rating", F.lit("N/A")).alias("rating"))


def prototype_points(library: DataFrame) -> DataFrame:
    """Prototypes point by point, the first highest and first lowest of each marked."""
    peak = F.array_position("prototype", F.array_max("prototype")) - 1
    valley = F.array_position("prototype", F.array_min("prototype")) - 1
    points = library.select("pattern_id", peak.alias("peak"), valley.alias("valley"), F.posexplode("prototype").alias("pos", "value"))
    return points.select(
        "pattern_id", F.col("pos").cast("long").alias("pos"), "value", (F.col("pos") == F.col("peak")).alias("is_peak"), (F.col("pos") == F.col("valley")).alias("is_valley")
    )


def system_report(library: DataFrame, expectancy: DataFrame, results: DataFrame, min_rating: float = 3.0, n: int = 10) -> DataFrame:
    """(section, key, value): table sizes, the best patterns of at least rating B, patterns by complexity."""
    sizes = None
    for name, df in (("library", library), ("expectancy", expectancy), ("results", results)):
        one = df.agg(F.count("*").cast("double").alias("value")).select(F.lit("size").alias("section"), F.lit(name).alias("key"), "value")
        sizes = one if sizes is None else sizes.union(one)
    top = expectancy.where(rating_value(F.col("rating")) >= min_rating).orderBy(F.desc("expectancy"), "pattern_id").limit(n)
    top = top.select(F.lit("top").alias("section"), F.col("pattern_id").alias("key"), F.col("expectancy").alias("value"))
    levels = library.groupBy("complexity").count().select(F.lit("complexity").alias("section"), F.concat(F.lit("L"), "complexity").alias("key"), F.col("count").cast("double").alias("value"))
    return sizes.union(top).union(levels)


def markdown_report(report: DataFrame, title: str = "Pattern report") -> DataFrame:
    """(line, text): a ``system_report`` as Markdown, a table a section, values from high to low; lines are few, as the report is."""
    titled = report.sparkSession.createDataFrame([("", 0, f"# {title}")], "section string, part int, text string")
    heads = report.select("section").distinct().select(
        "section", F.posexplode(F.array(F.lit(""), F.concat(F.lit("## "), "section"), F.lit(""), F.lit("| key | value |"), F.lit("|-|-|"))).alias("part", "text")
    )
    rows = report.select("section", F.lit(5).alias("part"), F.format_string("| %s | %.4f |", F.replace("key", F.lit("|"), F.lit("\\|")), "value").alias("text"), "value", "key")
    lines = titled.union(heads).select("*", F.lit(0.0).alias("value"), F.lit("").alias("key")).unionByName(rows)
    place = F.row_number().over(Window.orderBy("section", "part", F.desc("value"), "key"))
    return lines.select(place.cast("long").alias("line"), "text")
