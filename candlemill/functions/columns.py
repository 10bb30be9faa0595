"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY, ORDER = "series_id", "seq"


def by_series(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(rows: int, key: str = KEY, order: str = ORDER) -> WindowSpec:
    return by_series(key, order).rowsBetween(1 - rows, 0)


def full_window(value: Column, rows: int, order: str = ORDER) -> Column:
    """``value`` once ``rows`` rows have been seen, else null; ``order`` counts from 1."""
    return F.when(F.col(order) >= rows, value)


def r6(value: Column) -> Column:
    """Six decimals, no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0..1 within [low, high]; 0 if that is a point."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), F.lit(0.0)))
