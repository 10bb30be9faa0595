"""Average linkage of windows by warped distance: rounds of merges in Spark, the top of the tree from a matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEY
from ..functions.storage import stored
from .blocks import distances
from .neighbours import different, warped, warped_blocks

#: The tree's top is built from a matrix of at most this many clusters; windows of a block, about; of a part that is worth a task, and of a part at most; parts wanted; windows compared at once.
LAST, BLOCK, WORTH, PART, PARTS, STEP = 2048, 512, 5000, 1 << 14, 12, 2048
#: Pairs of windows warped one by one at a time; share of all pairs of clusters up to which they are.
SINGLE, FEW = 1 << 13, 0.7

#: Windows by cluster, the place of each one's cluster among them, the clusters in order, and their weights.
Clusters = tuple[pa.StructArray, np.ndarray, pa.Array, np.ndarray]


def average_linkage(distance: np.ndarray, clusters: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels 0.. of average-linkage clusters of a full distance matrix; a point of weight n counts as n equal ones."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d)) if weight is None else weight.astype(float).copy()
    label, alive = np.arange(len(d)), len(d)
    while alive > clusters:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def average_tree(distance: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (kept, merged, mean distance) of average linkage of a full matrix, the nearest first; a merged cluster keeps the smaller place."""
    d, size, out = distance.astype(float).copy(), weight.astype(float).copy(), []
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1)
    low = d[np.arange(len(d)), near]
    for _ in range(len(d) - 1):
        i = int(np.argmin(low))
        i, j = sorted((i, int(near[i])))
        out.append((i, j, float(d[i, j])))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i] += size[j]
        low[j] = np.inf
        again = np.flatnonzero(((near == i) | (near == j)) & np.isfinite(low))  # a mean is no less than the nearer of two, so the others keep their nearest
        again = np.union1d(again, [i])
        near[again] = d[again].argmin(1)
        low[again] = d[again, near[again]]
    return out


def _clusters_of(block: pa.StructArray) -> Clusters:
    place = np.asarray(pc.rank(block.field("c"), tiebreaker="dense")).astype(np.int64) - 1
    order = np.argsort(place, kind="stable")
    block, place = block.take(pa.array(order)), place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return block, place, block.field("c").take(pa.array(first)), np.bincount(place, np.asarray(block.field("w")).astype(float))


def _means(ours: Clusters, theirs: Clusters, radius: int) -> np.ndarray:
    """Mean distances of all clusters of two sides; infinite between a cluster and itself."""
    (x, at_x, a, weight_x), (y, at_y, b, weight_y) = ours, theirs
    total = np.zeros((len(a), len(b)))
    for s in range(0, len(x), STEP):
        for t in range(0, len(y), STEP):
            left, right = x.slice(s, STEP), y.slice(t, STEP)
            d = distances(left, right, lambda v, w: warped_blocks(v, w, radius))[0]
            heavy_x, heavy_y = (np.asarray(side.field("w")).astype(float) for side in (left, right))
            if heavy_x.max() > 1 or heavy_y.max() > 1:
                d *= heavy_x[:, None] * heavy_y
            for axis, p in enumerate((at_x[s : s + STEP], at_y[t : t + STEP])):
                if p[-1] - p[0] + 1 < len(p):
                    d = np.add.reduceat(d, np.flatnonzero(np.append(True, p[1:] != p[:-1])), axis=axis)
            total[at_x[s] : at_x[s] + len(d), at_y[t] : at_y[t] + d.shape[1]] += d  # places are without gaps
    total /= weight_x[:, None]
    total /= weight_y
    own = pc.index_in(b, value_set=a)
    total[np.asarray(own.drop_null()), np.flatnonzero(np.asarray(own.is_valid()))] = np.inf
    return total


def _ends(side: Clusters) -> tuple[np.ndarray, np.ndarray, bool]:
    """Mean first and last values of each cluster, and whether a window has one value only."""
    x, at, _, weight = side
    own, w = x.field("v"), np.asarray(x.field("w")).astype(float)
    sizes, flat = np.asarray(pc.list_value_length(own)).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False)
    last = np.cumsum(sizes) - 1
    first, final = (np.bincount(at, flat[places] * w) / weight for places in (last - sizes + 1, last))
    return first, final, bool((sizes == 1).any())


def _least(ours: Clusters, theirs: Clusters) -> np.ndarray:
    """A lower bound of mean distances: first values meet under any warping, and so do last ones; the gap of means is no more than the mean of gaps."""
    (f, l, one), (g, m, other) = _ends(ours), _ends(theirs)
    join = np.maximum if one and other else np.add
    return join(np.abs(f[:, None] - g), np.abs(l[:, None] - m))


def _means_of(ours: Clusters, theirs: Clusters, p: np.ndarray, q: np.ndarray, radius: int) -> np.ndarray:
    """Mean distances of some pairs of clusters, given by their places, from all pairs of their windows."""

    def side(clusters: Clusters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, at, names, _ = clusters
        own, count = x.field("v"), np.bincount(at, minlength=len(names))
        sizes = np.asarray(pc.list_value_length(own)).astype(np.int64)
        return count, np.cumsum(count) - count, sizes, np.cumsum(sizes) - sizes, own.flatten().to_numpy(zero_copy_only=False)

    (cx, fx, sx, ox, vx), (cy, fy, sy, oy, vy) = side(ours), side(theirs)
    wx, wy = (np.asarray(c[0].field("w")).astype(float) for c in (ours, theirs))
    total, ends = np.zeros(len(p)), np.cumsum(cx[p] * cy[q])
    for s in range(0, int(ends[-1]) if len(ends) else 0, 16 * SINGLE):
        every = np.arange(s, min(s + 16 * SINGLE, int(ends[-1])))
        row = np.searchsorted(ends, every, side="right")
        own = every - (ends[row] - cx[p[row]] * cy[q[row]])
        i, j = fx[p[row]] + own // cy[q[row]], fy[q[row]] + own % cy[q[row]]
        d, kind = np.empty(len(every)), sx[i] * (int(sy.max()) + 1) + sy[j]
        order = np.argsort(kind, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            n, m = int(sx[i[some[0]]]), int(sy[j[some[0]]])
            for k in range(0, len(some), SINGLE):
                part = some[k : k + SINGLE]
                d[part] = warped(vx[ox[i[part]] + np.arange(n)[:, None]], vy[oy[j[part]] + np.arange(m)[:, None]], radius)
        total += np.bincount(row, d * wx[i] * wy[j], minlength=len(p))
    return total / ours[3][p] / theirs[3][q]


def parts_of(windows: int) -> int:
    return max(1, math.ceil(windows / PART), min(PARTS, math.ceil(windows / WORTH)))


def _by_blocks(asked: DataFrame, members: DataFrame, windows: int, radius: int, nearest: bool) -> DataFrame:
    """(a, b, d) of clusters by mean distance: the nearest of all for each cluster asked for (of equally near ones the first is among the rows), or all pairs a < b.

    A block holds all windows of its clusters, about ``BLOCK``. Both sides' blocks are dealt to parts, and a task meets two parts, one block at a time: a window is shuffled once for each part,
    and no pair of windows leaves a task.
    """
    kind, many = members.schema["c"].dataType.simpleString(), max(1, math.ceil(windows / BLOCK))
    n = parts_of(windows)

    def blocks(side: DataFrame) -> DataFrame:
        placed = side.withColumn("i", F.pmod(F.xxhash64("c"), F.lit(many)).cast("int"))
        return placed.repartition(n, "i").groupBy("i").agg(F.collect_list(F.struct("c", "v", F.col("copies").alias("w"))).alias("x")).withColumn("part", F.col("i") % n)

    row, column = F.sequence(F.col("part") * n, F.col("part") * n + n - 1), F.sequence(F.col("part"), F.col("part") + (n - 1) * n, F.lit(n))
    left = blocks(asked).select(F.explode(row).alias("tile"), F.lit(True).alias("asked"), "x")
    right = blocks(members).select(F.explode(column).alias("tile"), F.lit(False).alias("asked"), "x")
    dealt = left.union(right).repartitionById(n * n, "tile").sortWithinPartitions("tile", F.desc("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, mine, low = None, [], None, np.zeros(0)
        for batch in batches:
            for at, asks, x in zip(batch.column("tile").to_pylist(), batch.column("asked").to_pylist(), batch.column("x")):
                if at != tile:
                    tile, waiting, mine = at, [], None
                if asks:
                    waiting.append(x.values)
                    continue
                if not waiting and mine is None:
                    continue  # nothing is asked for here
                if mine is None:
                    mine, waiting = _clusters_of(pa.concat_arrays(waiting)), []
                    low = np.full(len(mine[2]), np.inf)
                other = _clusters_of(x.values)
                a, b = mine[2], other[2]
                if nearest:
                    mean = _least(mine, other)
                    own = pc.index_in(b, value_set=a)
                    mean[np.asarray(own.drop_null()), np.flatnonzero(np.asarray(own.is_valid()))] = np.inf
                    p, q = np.nonzero((mean <= (low * (1 + 1e-9) + 1e-9)[:, None]) & np.isfinite(mean))  # others are farther than the nearest so far
                    if len(p) > FEW * mean.size:
                        mean = _means(mine, other, radius)
                    else:
                        mean[:] = np.inf
                        mean[p, q] = _means_of(mine, other, p, q, radius)
                    best = mean.argmin(1)
                    found = mean[np.arange(len(a)), best]
                    row = np.flatnonzero(np.isfinite(found) & (found <= low))
                    low, col = np.minimum(low, found), best[row]
                else:
                    mean = _means(mine, other, radius)
                    ids = pc.rank(pa.concat_arrays([a, b]), tiebreaker="dense").to_numpy().astype(np.int64)
                    row, col = np.nonzero(ids[: len(a), None] < ids[len(a) :])
                yield _rows(a.take(pa.array(row)), b.take(pa.array(col)), mean[row, col])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, d double")


def _rows(a: pa.Array, b: pa.Array, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, pa.array(d)], names=["a", "b", "d"])


def _renamed(members: DataFrame, merges: DataFrame) -> DataFrame:
    return members.join(merges.select("c", "__to"), "c", "left").select("id", "copies", "v", F.coalesce("__to", "c").alias("c"))


def _nearest(members: DataFrame, near: DataFrame | None, merges: DataFrame | None, windows: int, radius: int) -> DataFrame:
    """(a, b, d): the nearest of every cluster. After ``merges`` only of clusters that merged or whose nearest did: a mean is no less than the nearer of two, so the others keep theirs."""
    asked, kept = members, None
    if near is not None:
        gone = merges.select("c").union(merges.select("__to"))
        kept = near.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b", "d")
        asked = members.join(kept.select(F.col("a").alias("c")), "c", "left_anti").select(*members.columns)
    found = _by_blocks(asked, members, windows, radius, True).repartition(parts_of(windows), "a").groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select("a", "n.b", "n.d")
    return stored(kept.union(found) if kept is not None else found, "nearest")


def _round(near: DataFrame) -> DataFrame:
    """(c, __to, h): clusters that are each other's nearest, the larger name merging into the smaller."""
    both = near.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")
    merges = stored(both.select(F.col("b").alias("c"), F.col("a").alias("__to"), F.col("d").alias("h")), "merges")
    if merges.take(1):
        return merges
    first = near.orderBy("d", F.least("a", "b"), F.greatest("a", "b")).limit(1)  # means that differ by rounding only; the two nearest of all are each other's nearest
    return stored(first.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("__to"), F.col("d").alias("h")), "merges")


def linked_windows(windows: DataFrame, clusters: int, radius: int = 1, key: str = KEY, values: str = "tail", last: int = LAST) -> DataFrame:
    """(key, cluster) of every usable window: average linkage by warped distance, cut at ``clusters`` clusters, numbered by their smallest key.

    Equal windows are one of their weight. While there are more than ``last`` clusters, those that are each other's nearest merge, all of a round at once: average
    linkage is reducible, so this gives the tree of one merge after the other. A round computes the mean distances of clusters that merged or whose nearest did from their windows,
    block by block in tasks that give the nearest ones only, and merges a fifth of all at first, some 6 % later (random windows). The rest of the tree comes from the full matrix of at most
    ``last`` cluster means.

    The tree is then cut: of all its merges the ``clusters`` - 1 farthest are left out (they may be of any round), the others are followed once more from the windows on.
    Of equally near clusters a round takes the smaller keys. The work of a round grows with the square of the different windows, spread over tasks.
    """
    classes, owners = different(windows, key, values)
    total = classes.count()
    if not total:
        return owners.select(key, F.lit(0).alias("cluster"))
    start = stored(classes.withColumn("c", F.col("id")), "members")
    members = start
    left, last, rounds = total, max(last, 2 * clusters), []  # a round halves the clusters at most
    near = merges = None
    while left > last:
        near = _nearest(members, near, merges, total, radius)
        merges = _round(near)
        rounds.append(merges)
        left -= merges.count()
        members = stored(_renamed(members, merges), "members")
    found = members.groupBy("c").agg(F.sum("copies").alias("n")).orderBy("c").toArrow()
    names, weight = found.column("c").combine_chunks(), found.column("n").to_numpy().astype(float)
    height = np.zeros(len(names))
    pairs = _by_blocks(members, members, total, radius, False).toArrow()
    a, b = (np.asarray(pc.index_in(pairs.column(x), value_set=names)).astype(np.int64) for x in "ab")
    distance = np.zeros((len(names), len(names)))
    distance[a, b] = distance[b, a] = pairs.column("d").to_numpy()
    top = []
    for i, j, d in average_tree(distance, weight):
        height[i] = max(d, height[i], height[j])
        top.append((float(height[i]), len(rounds), i, j))
    cut = [(r["h"], at, r["c"], None) for at, m in enumerate(rounds) for r in m.orderBy(F.desc("h"), "c").limit(max(clusters - 1, 0)).collect()]
    cut = sorted([*cut, *((h, at + n, i, j) for n, (h, at, i, j) in enumerate(top))], key=lambda x: x[:2])[::-1][: max(clusters - 1, 0)]
    kind, spark = classes.schema["id"].dataType, windows.sparkSession
    members = start
    for at, merges in enumerate(rounds):
        out = [c for _, n, c, j in cut if j is None and n == at]
        members = _renamed(members, merges.where(~F.col("c").isin(out)) if out else merges)
    left_out, label, names = {(i, j) for _, _, i, j in cut if j is not None}, {}, names.to_pylist()
    for _, _, i, j in reversed(top):  # from the root down, so that a place's own label is known first
        if (i, j) not in left_out:
            label[names[j]] = label.get(names[i], names[i])
    members = stored(members, "members")
    own = [r["c"] for r in members.select("c").distinct().orderBy("c").collect()]  # at most ``last`` and those cut off
    number = {c: n for n, c in enumerate(c for c in own if c not in label)}
    named = spark.createDataFrame([(c, number[label.get(c, c)]) for c in own], f"c {kind.simpleString()}, cluster int")
    return owners.join(members.select("id", "c"), "id").join(F.broadcast(named), "c").select(key, "cluster")
