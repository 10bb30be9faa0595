"""Exponentially weighted means as window sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import KEY, ORDER, by_series

BLOCK = 256
#: A row so many times older than 1 / -ln(1 - alpha) weighs less than 1e-17.
AGES = 39.2


def ewm(df: DataFrame, means: dict[str, tuple[str, float]], key: str = KEY, order: str = ORDER) -> DataFrame:
    """Adds for each name the weighted mean of a column up to each row with weights (1 - alpha) ** age, nulls left out.

    ``order`` counts from 1. The recursion num = x + (1 - alpha) num is a sum of x scaled
    by a power of 1 / (1 - alpha), which overflows on long series; so rows are dealt into
    blocks of 256, each summed by itself, and what earlier blocks still weigh is added: as many of
    them as matter to 1e-17. The sum of the block before is that of the last row before which ended one, so one
    partitioning by ``key`` serves all windows. A series of any length is thus many short windows.
    """
    names = [*df.columns, *means]
    at, block = (F.col(order) - 1) % BLOCK, F.expr(f"({order} - 1) div {BLOCK}")
    df = df.withColumns({"__block": block, "__at": at.cast("double")})
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums: dict[str, Column] = {}
    for out, (value, alpha) in means.items():
        scale, there = F.pow(F.lit(1 - alpha), -F.col("__at")), F.col(value).isNotNull()
        sums[f"__{out}_n0"] = F.coalesce(F.sum(F.when(there, F.col(value) * scale)).over(inside) / scale, F.lit(0.0))
        sums[f"__{out}_d0"] = F.coalesce(F.sum(F.when(there, scale)).over(inside) / scale, F.lit(0.0))
    df = df.withColumns(sums)
    back = {out: math.ceil(AGES / (BLOCK * -math.log(1 - alpha))) for out, (_, alpha) in means.items()}
    earlier = by_series(key, order).rowsBetween(Window.unboundedPreceding, -1)
    for j in range(1, max(back.values()) + 1):  # what the j-th block before this one ended with
        df = df.withColumns(
            {
                f"__{out}_{x}{j}": F.coalesce(F.last(F.when(F.col("__at") == BLOCK - 1, F.col(f"__{out}_{x}{j - 1}")), ignorenulls=True).over(earlier), F.lit(0.0))
                for out in means
                if j <= back[out]
                for x in "nd"
            }
        )

    def total(out: str, x: str) -> Column:
        decay = 1 - means[out][1]
        weight = lambda j: F.pow(F.lit(decay), F.col("__at") + 1 + BLOCK * (j - 1))
        return sum((F.col(f"__{out}_{x}{j}") * weight(j) for j in range(1, back[out] + 1)), F.col(f"__{out}_{x}0"))

    done = {out: F.when(total(out, "d") > 0, total(out, "n") / total(out, "d")) for out in means}
    return df.withColumns(done).select(*names)


def rows_that_weigh(*alphas: float) -> int:
    """How many of the last rows make up a mean, or a mean of means, to 1e-17."""
    return sum(math.ceil(AGES / -math.log(1 - a)) for a in alphas)
