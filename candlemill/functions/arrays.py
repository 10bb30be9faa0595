"""Array expressions: resampling and similarity of price windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resample(values: Column, points: Column) -> Column:
    """Linear interpolation of an array onto ``points`` evenly spaced places (both ends included)."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = F.when(points > 1, i * (n - 1).cast("double") / (points - 1)).otherwise(F.lit(0.0))
        low = F.least(F.floor(x), (n - 1).cast("long"))
        high = F.least(low + 1, (n - 1).cast("long"))
        a, b = F.element_at(values, (low + 1).cast("int")), F.element_at(values, (high + 1).cast("int"))
        return a + (b - a) * (x - low)

    return F.when(points == n, values).otherwise(F.transform(F.sequence(F.lit(0), points - 1), at))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 - distance / sqrt(length), not below 0; 0 for empty arrays."""
    n = F.size(a)
    return F.when(n > 0, F.greatest(F.lit(0.0), 1 - euclidean_distance(a, b) / F.sqrt(n))).otherwise(0.0)


def correlation_similarity(a: Column, b: Column) -> Column:
    """(r + 1) / 2; 0 if an array is constant or empty."""
    n = F.size(a).cast("double")
    ma, mb = total(a) / n, total(b) / n
    ca, cb = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    sab = total(F.zip_with(ca, cb, lambda x, y: x * y))
    saa, sbb = total(F.transform(ca, lambda x: x * x)), total(F.transform(cb, lambda x: x * x))
    # what floating point leaves of a constant array counts as constant
    varied = (F.size(a) > 0) & (F.array_max(a) > F.array_min(a)) & (F.array_max(b) > F.array_min(b))
    return F.when(varied, (sab / F.sqrt(saa * sbb) + 1) / 2).otherwise(0.0)
