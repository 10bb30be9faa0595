"""Connected components by alternating large-star and small-star, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Nodes of more edges are hubs; as the graph grows so does the number, so that there are never more hubs than ``MOST_HUBS``.
HUB, MOST_HUBS = 256, 100_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge, component being its smallest node.

    Every round is two grouped minima and two joins; nothing is gathered per node. The minima of nodes
    with very many neighbours are broadcast, so that a hub's edges needn't meet in one task.
    Loops and repeated edges don't matter; null ends are left out; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = materialize(e.where("hi <> lo").distinct(), "edges")
    state = _state(e)
    while state[0]:
        hub = max(HUB, 2 * state[0] // MOST_HUBS)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = _with_least(both, "u", "v", least, hub).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, "hi", "lo", least, hub).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialize(small.union(least.select("hi", "m")).distinct(), "edges")
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _with_least(e: DataFrame, key: str, other: str, least: DataFrame, hub: int) -> DataFrame:
    """Edges with their node's minimum ``m``; edges of nodes with more than ``hub`` of them stay spread over all tasks."""
    hubs = least.where(F.col("n") > hub).select(key, F.col("m").alias("__m"))
    e = e.join(F.broadcast(hubs), key, "left")
    e = e.withColumn("__salt", F.when(F.col("__m").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(other)))
    own = least.select(key, F.shiftright("n", 62).alias("__salt"), "m")  # always 0
    return e.join(own, [key, "__salt"], "left").select(key, other, F.coalesce("__m", "m").alias("m"))


def _state(e: DataFrame) -> tuple[int, int | None]:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return r[0], r[1]


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Calls ``work`` with each group of equal ``keys`` as an Arrow table; groups must be of bounded size.

    One shuffle by the keys and a sort; a task then streams through its groups and holds one.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            bounds = [0, *cut.tolist(), batch.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                key = tuple(c[s] for c in cols)
                if key != last and held:
                    if (t := work(pa.Table.from_batches(held))) is not None and t.num_rows:
                        yield from t.to_batches()
                    held = []
                last = key
                held.append(batch.slice(s, e - s))
        if held and (t := work(pa.Table.from_batches(held))) is not None and t.num_rows:
            yield from t.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least index reachable from each index."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks_of_groups(members: DataFrame, size: int) -> DataFrame:
    """Deals each group's members into blocks of ``size`` and pairs blocks: adds ``cell_i`` and ``cell_j``.

    Expects ``place``, the member's number inside its group, and ``members``, the group's
    size. A member of block b comes into the cells (min(b, t), max(b, t)) for all blocks t.
    """
    block = F.expr(f"place div {size}")
    last = F.expr(f"(members - 1) div {size}")
    return (
        members.withColumn("block", block)
        .withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("cell_i", F.least("block", "__t"))
        .withColumn("cell_j", F.greatest("block", "__t"))
        .drop("__t")
    )
