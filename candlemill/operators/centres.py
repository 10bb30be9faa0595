"""k-means from several starts at once: one pass over the vectors a step serves all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Rounds of seeding, centres expected of each (times k), and the move (squared) below which a start is done.
SEED_ROUNDS, OVERSAMPLE, STILL = 3, 2, 1e-8


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centres."""
    middle = centres.mean(0)  # without it, vectors far from zero lose digits
    x, centres = x - middle, centres - middle
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0.0)


def _column(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["x"].to_numpy()).astype(float)


def sums_by_centre(points: DataFrame, sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Of each set of centres: sums and weights of the vectors nearest to each centre, and the cost. One job for all sets.

    A task adds up its vectors first, so as many rows are shuffled a task as there are centres.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), c.shape[1] + 2)) for c in sets]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            for t, c in zip(total, sets):
                d = gaps(x, c)
                near = d.argmin(1)
                for pos, column in enumerate((w, w * d[np.arange(len(x)), near], *(x * w[:, None]).T)):
                    t[:, pos] += np.bincount(near, column, minlength=len(c))
        rows = [{"start": s, "centre": i, "sums": row.tolist()} for s, t in enumerate(total) for i, row in enumerate(t) if row[0] > 0]
        yield pa.RecordBatch.from_pylist(rows, pa.schema({"start": pa.int32(), "centre": pa.int32(), "sums": pa.list_(pa.float64())}))

    parts = points.select("x", "w").mapInArrow(add, "start int, centre int, sums array<double>")
    long = parts.select("start", "centre", F.posexplode("sums").alias("pos", "value"))
    found = long.groupBy("start", "centre", "pos").agg(F.sum("value").alias("value")).collect()  # as many rows as centres have numbers
    total = [np.zeros((len(c), c.shape[1] + 2)) for c in sets]
    for r in found:
        total[r["start"]][r["centre"], r["pos"]] = r["value"]
    return [t[:, 2:] for t in total], [t[:, 0] for t in total], [float(t[:, 1].sum()) for t in total]


def further_seeds(points: DataFrame, sets: list[np.ndarray], costs: list[float], wanted: float, turn: int, seeds: list[int]) -> list[np.ndarray]:
    """Each set with the vectors drawn for it with a chance of ``wanted`` times their part of its cost. One job for all sets."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x, w = _column(part), part["w"].to_numpy(float)
            for s, (c, cost) in enumerate(zip(sets, costs)):
                if cost > 0:
                    luck = (part[f"u{s}"].to_numpy() % (1 << 30)) / (1 << 30)
                    drawn = x[luck < wanted * w * gaps(x, c).min(1) / cost]
                    if len(drawn):  # an empty column of no lists has no type that Arrow takes for one of lists
                        yield pd.DataFrame({"start": s, "x": [v.tolist() for v in drawn]})

    luck = [F.xxhash64("x", F.lit(seed), F.lit(turn)).alias(f"u{s}") for s, seed in enumerate(seeds)]
    found = points.select("x", "w", *luck).mapInPandas(draw, "start int, x array<double>").collect()
    return [np.vstack([c, *[[x] for x in sorted(r["x"] for r in found if r["start"] == s)]]) for s, c in enumerate(sets)]  # in one order, however tasks end


def spread(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of a few weighted candidates, each drawn by its weighted squared distance to those before it."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        chance = weights * gaps(candidates, candidates[chosen]).min(1)
        chance[chosen] = 0
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
    return candidates[chosen]


def best_centres(vectors: DataFrame, k: int, seeds: range, column: str = "vector") -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, members of each, cost) of the cheapest of one start a seed.

    Equal vectors are one of their weight. Seeds come from scalable seeding (a first vector by hash, then rounds of draws by cost), thinned out on
    the driver to ``k``: about k * (1 + rounds * ``OVERSAMPLE``) vectors a start. Steps are Lloyd's, as many as a start needs until its centres stand still (or its cost,
    which falls with every step, can't fall any more in double precision); a job serves all starts that still move. Null vectors are left out;
    fewer different vectors than ``k`` give as many centres; no vectors give none.
    """
    seeds = list(seeds)
    points = stored(vectors.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("w")), "points")
    one = points.agg(F.count("*").alias("n"), *[F.min_by("x", F.struct(F.xxhash64("x", F.lit(s)), "x")).alias(f"x{i}") for i, s in enumerate(seeds)]).first()
    if not one["n"]:
        return np.zeros((0, 0)), np.zeros(0), 0.0
    k = min(k, one["n"])
    sets = [np.array([one[f"x{i}"]], dtype=float) for i in range(len(seeds))]
    for turn in range(SEED_ROUNDS):
        costs = sums_by_centre(points, sets)[2]
        sets = further_seeds(points, sets, costs, OVERSAMPLE * k, turn, seeds)
    while any(len(np.unique(c, axis=0)) < k for c in sets):  # few vectors, unlucky draws
        turn, costs = turn + 1, sums_by_centre(points, sets)[2]
        if not any(cost > 0 and len(np.unique(c, axis=0)) < k for c, cost in zip(sets, costs)):
            break  # those left are too near to tell apart
        sets = further_seeds(points, sets, costs, OVERSAMPLE * k, turn, seeds)
    weights = sums_by_centre(points, sets)[1]
    sets = [spread(c, w, k, np.random.default_rng(s)) for c, w, s in zip(sets, weights, seeds)]
    going, last = list(range(len(sets))), np.full(len(sets), np.inf)
    while going:
        sums, weights, costs = sums_by_centre(points, [sets[s] for s in going])
        done = set()
        for s, total, w, cost in zip(going, sums, weights, costs):
            moved = np.where(w[:, None] > 0, total / np.maximum(w, 1)[:, None], sets[s])
            if not cost < last[s] or ((moved - sets[s]) ** 2).sum(1).max() <= STILL:
                done.add(s)
            sets[s], last[s] = moved, cost
        going = [s for s in going if s not in done]
    _, weights, costs = sums_by_centre(points, sets)
    best = int(np.argmin(costs))
    return sets[best], weights[best], costs[best]
