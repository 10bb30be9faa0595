"""Discovering recurring patterns: distances, clusters, prototypes and the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import euclidean_distance, resample
from ..functions.columns import KEY
from ..functions.storage import stored
from .blocks import all_distances, euclid
from .centres import best_centres
from .indicators import local_extrema, scaled, tail_array
from .linkage import linked_windows
from .neighbours import fine, warped_blocks


def eligible_series(bars: DataFrame, vectors: DataFrame, least_bars: int = 20, least_vectors: int = 10) -> DataFrame:
    """Per series: bars, whether every feature is a number, and whether it takes part in discovery."""
    counts = bars.groupBy(KEY).agg(F.count("*").alias("n_bars"))
    whole = vectors.groupBy(KEY).agg(F.count("value").alias("n_features"), F.count_if(F.isnan("value")).alias("n_nan"))
    out = counts.join(whole, KEY, "left")
    ok = (F.col("n_bars") >= least_bars) & (F.col("n_features") >= 5) & (F.col("n_nan") == 0)
    out = out.withColumn("fit", F.coalesce(ok, F.lit(False)))
    enough = out.agg(F.count_if("fit").alias("n_fit"))
    return out.join(F.broadcast(enough)).withColumn("eligible", F.col("fit") & (F.col("n_fit") >= least_vectors)).drop("n_nan", "fit")


def resampled(arrays: DataFrame, points: int, values: str = "prototype") -> DataFrame:
    return arrays.withColumn(values, resample(F.col(values), F.lit(points)))


def pairs_of(windows: DataFrame, key: str, values: str) -> DataFrame:
    """All pairs a < b of windows, both resampled to the shorter of the two."""
    a = windows.select(F.col(key).alias("a"), F.col(values).alias("va"))
    b = windows.select(F.col(key).alias("b"), F.col(values).alias("vb"))
    shorter = F.least(F.size("va"), F.size("vb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.withColumn("va", resample(F.col("va"), shorter)).withColumn("vb", resample(F.col("vb"), shorter))


def pairwise_euclid(windows: DataFrame, key: str = KEY, values: str = "tail") -> DataFrame:
    """Distances of all pairs a < b of windows, both resampled to the shorter of the two, block by block (see ``blocks``)."""
    return all_distances(windows, key, values, euclid, nan=True)


def dtw_batch(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Banded dynamic time warping (absolute cost) of many pairs of equal lengths at once."""
    n, m = a.shape[1], b.shape[1]
    band = max(radius, abs(n - m))
    cost = np.full((len(a), n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            least = np.minimum(np.minimum(cost[:, i - 1, j], cost[:, i, j - 1]), cost[:, i - 1, j - 1])
            cost[:, i, j] = np.abs(a[:, i - 1] - b[:, j - 1]) + least
    return cost[:, n, m]


def dtw(a: Column, b: Column, radius: int) -> Column:
    @F.pandas_udf("double")
    def distance(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            out = np.zeros(len(x))
            sizes = pd.Series(list(zip(x.map(len), y.map(len))))
            for (n, m), at in sizes.groupby(sizes).groups.items():
                if n and m:
                    out[at] = dtw_batch(np.stack(x.iloc[at].to_list()), np.stack(y.iloc[at].to_list()), radius)
            yield pd.Series(out)

    return distance(a, b)


def pairwise_dtw(windows: DataFrame, key: str = KEY, values: str = "tail", radius: int = 1) -> DataFrame:
    """Warped distances of all pairs a < b of windows, block by block; 0 where one is empty, null where one is null or holds a null."""
    return all_distances(windows, key, values, lambda a, b: warped_blocks(a, b, radius), nan=False)


def dtw_similarity(pairs: DataFrame, radius: int = 3) -> DataFrame:
    """1 - distance / (2 sqrt(length)), not below 0, of pairs (va, vb) of one length."""
    far = 2 * F.sqrt(F.size("va")) + 1e-10
    return pairs.withColumn("similarity", F.greatest(F.lit(0.0), 1 - dtw(F.col("va"), F.col("vb"), radius) / far))


def discover_simple(windows: DataFrame, max_clusters: int = 10, min_freq: int = 3, key: str = KEY, values: str = "tail") -> DataFrame:
    """L2 patterns from windows scaled to 0..1: average linkage by warped distance, prototypes of the median length.

    Every window counts, equal ones as one of their weight; the tree is that of all different windows, whatever their number (see ``linkage``).
    Null and empty windows and those with null or non-finite values are left out; fewer windows than two clusters need give no rows. Patterns are
    numbered by the smallest key of their cluster.
    """
    spark = windows.sparkSession
    windows = stored(windows.where(fine(values)).select(key, values), "windows")
    rows, shapes = windows.agg(F.count("*"), F.count_distinct(values)).first()
    k = min(max_clusters, rows // min_freq, shapes)
    if k < 2:
        return spark.createDataFrame([], "pattern_id string, complexity int, frequency long, prototype array<double>, avg_length double, length_std double")
    members = stored(linked_windows(windows, k, key=key, values=values), "linked").join(windows, key).withColumn("__length", F.size(values))
    found = members.groupBy("cluster").agg(F.count("*").alias("frequency"), F.avg("__length").alias("avg_length"), F.stddev_pop("__length").alias("length_std"))
    prototypes = vectors_of(barycenter(members, values), "cluster").withColumnRenamed("vector", "prototype")
    return found.where(F.col("frequency") >= min_freq).join(prototypes, "cluster").select(
        F.format_string("L2-%03d", "cluster").alias("pattern_id"), F.lit(2).alias("complexity"), "frequency", "prototype", "avg_length", "length_std"
    )


def barycenter(clusters: DataFrame, values: str = "tail") -> DataFrame:
    """(cluster, pos, value): members resampled to the median length, then the mean of each position."""
    size = clusters.groupBy("cluster").agg(F.floor(F.percentile(F.size(values), F.lit(0.5))).cast("int").alias("points"))
    even = clusters.join(size, "cluster").select("cluster", F.posexplode(resample(F.col(values), F.col("points"))).alias("pos", "value"))
    return even.groupBy("cluster", F.col("pos").cast("long").alias("pos")).agg(F.avg("value").alias("value"))


def standardise_features(vectors: DataFrame) -> DataFrame:
    """Z-scores of each position (population deviation); 0 for a constant one. The vectors are stored: moments and scores read them."""
    vectors = stored(vectors, "features")
    stats = vectors.groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    z = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0)
    return vectors.join(F.broadcast(stats), "pos").select(KEY, "pos", z.alias("value"))


def vectors_of(values: DataFrame, key: str = KEY) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return values.groupBy(key).agg(F.transform(pairs, lambda x: x["value"]).alias("vector"))


def kmeans(vectors: DataFrame, k: int, seeds: range = range(42, 52), column: str = "vector") -> DataFrame:
    """(cluster, centre) of the best of several starts, numbered by size and centre; all starts share every pass (see ``centres``)."""
    found, sizes, _ = best_centres(vectors, k, seeds, column)
    ordered = sorted(zip(sizes.tolist(), found.tolist()), key=lambda x: (-x[0], x[1]))
    return vectors.sparkSession.createDataFrame([(i, c) for i, (_, c) in enumerate(ordered)], "cluster int, centre array<double>")


def assign_to_centres(vectors: DataFrame, centres: DataFrame, key: str = KEY, column: str = "vector") -> DataFrame:
    """Nearest centre of every vector (of equally near ones the first) and the distance, a row for each row.

    The centres, a few, come along as one array; nothing is shuffled.
    """
    one = centres.agg(F.collect_list(F.struct("cluster", "centre")).alias("__centres"))
    gaps = F.transform("__centres", lambda c: F.struct(euclidean_distance(F.col(column), c["centre"]).alias("gap"), c["cluster"].alias("cluster")))
    return vectors.join(F.broadcast(one)).withColumn("__near", F.array_min(gaps)).select(
        key, F.col("__near.cluster").alias("cluster"), F.col("__near.gap").alias("distance")
    )


def frequent_clusters(assigned: DataFrame, min_freq: int) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_freq)


def discover_composite(vectors: DataFrame, max_clusters: int = 10, min_freq: int = 3) -> DataFrame:
    """L3 patterns: k-means on standardised feature vectors, frequent clusters only (ids keep gaps); none from fewer than two vectors."""
    arrays = stored(vectors_of(standardise_features(vectors)), "vectors")
    n = arrays.count()
    if n < 2:
        return arrays.sparkSession.createDataFrame([], "pattern_id string, complexity int, frequency long, prototype array<double>")
    k = min(max_clusters, max(2, n // min_freq))
    centres = kmeans(arrays, k)
    frequent = frequent_clusters(assign_to_centres(arrays, centres), min_freq)
    return frequent.join(centres, "cluster").select(
        F.format_string("L3-%03d", "cluster").alias("pattern_id"), F.lit(3).alias("complexity"), "frequency", F.col("centre").alias("prototype")
    )


def complex_features(bars: DataFrame, least_bars: int = 30, value: str = "close") -> DataFrame:
    """Turning points, total variation and direction of series with at least two peaks and two valleys."""
    marked = local_extrema(bars, value).withColumn("step", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(KEY).orderBy("seq"))))
    out = marked.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_if(F.col("extremum") == 1).alias("n_peaks"), F.count_if(F.col("extremum") == -1).alias("n_valleys"),
        F.sum("step").alias("total_variation"), F.max_by(value, "seq").alias("last"), F.min_by(value, "seq").alias("first"),
    )
    out = out.where((F.col("n") >= least_bars) & (F.col("n_peaks") >= 2) & (F.col("n_valleys") >= 2))
    return out.select(
        KEY, "n_peaks", "n_valleys", (F.col("n_peaks") / F.col("n_valleys")).alias("peak_valley_ratio"), "total_variation",
        F.when(F.col("last") > F.col("first"), 1).otherwise(-1).cast("long").alias("trend_direction"),
    )


def complex_vectors(features: DataFrame) -> DataFrame:
    return features.select(KEY, F.array(*[F.col(c).cast("double") for c in ("n_peaks", "n_valleys", "total_variation", "trend_direction")]).alias("vector"))


def representatives(vectors: DataFrame, centres: DataFrame, min_freq: int = 3) -> DataFrame:
    """Frequent clusters with the member nearest to the centre (the first of equally near ones)."""
    assigned = assign_to_centres(vectors, centres)
    out = assigned.groupBy("cluster").agg(F.count("*").alias("cluster_size"), F.min_by(KEY, F.struct("distance", KEY)).alias("representative"))
    return out.where(F.col("cluster_size") >= min_freq)


def cluster_complex(features: DataFrame, max_clusters: int = 10, min_freq: int = 3) -> DataFrame:
    """L4 patterns: k-means on plain turning-point features, until the centres stand still; each candidate for itself if no cluster is frequent.

    A pattern has its size, its representative with that one's features, and the ids of all its members in order. Where there are candidates for one cluster only, they are one.
    """
    features = stored(features, "turning-points")
    arrays = complex_vectors(features)
    n = arrays.count()
    single = arrays.select(
        F.concat(F.lit("L4-"), F.col(KEY)).alias("pattern_id"), F.lit(1).cast("long").alias("cluster_size"), F.col(KEY).alias("representative"), F.array(KEY).alias("members")
    )
    found, k = single, min(max_clusters, n // min_freq)
    if k >= 1:
        centres = stored(kmeans(arrays, k), "centres")
        members = assign_to_centres(arrays, centres).groupBy("cluster").agg(F.array_sort(F.collect_list(KEY)).alias("members"))
        named = stored(representatives(arrays, centres, min_freq).join(members, "cluster"), "clusters")
        if named.take(1):
            found = named.select(F.format_string("L4-C%03d", "cluster").alias("pattern_id"), "cluster_size", "representative", "members")
    return found.join(features.withColumnRenamed(KEY, "representative"), "representative", "left").select(*found.columns, *[c for c in features.columns if c != KEY])


def discover_complex(bars: DataFrame, max_clusters: int = 10, min_freq: int = 3, window: int = 60, least_bars: int = 30) -> DataFrame:
    """L4 patterns as library rows: clusters of the turning points of each series' last ``window`` bars; the representative's closes, scaled, are the prototype.

    The frequency is the cluster's size, or 1 for a candidate that stands for itself. Series with fewer than ``least_bars`` bars take no part.
    """
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("seq")))
    recent = bars.withColumn("__back", back).where(F.col("__back") <= window).drop("__back")
    found = cluster_complex(complex_features(recent, least_bars), max_clusters, min_freq)
    shapes = tail_array(bars, window).select(F.col(KEY).alias("representative"), scaled(F.col("tail")).alias("prototype"))
    return found.join(shapes, "representative").select("pattern_id", F.lit(4).alias("complexity"), F.col("cluster_size").alias("frequency"), "prototype")


def library_pairs(library: DataFrame) -> DataFrame:
    """All pairs a < b of prototypes resampled to the shorter."""
    return pairs_of(library, "pattern_id", "prototype")


def merge_library(old: DataFrame, new: DataFrame, key: str = "pattern_id") -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def library_stats(library: DataFrame) -> DataFrame:
    """Count, total and mean frequency by complexity, and over all (complexity null)."""
    return library.rollup("complexity").agg(
        F.count("*").alias("n_patterns"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_frequency"), F.coalesce(F.avg("frequency"), F.lit(0.0)).alias("avg_frequency")
    )
