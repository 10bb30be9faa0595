"""Comparing the closes of series with a pattern library, at their end or at every bar.

A library has pattern_id, complexity, frequency and prototype (array of closes). It is
small next to the bars and goes to all tasks, in parts if it is large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunks import CHUNK, over_chunks
from ..functions.columns import KEY, ORDER

#: Patterns that go to all tasks at once.
MOST_PATTERNS = 50_000
#: Numbers of a matrix product at once.
CELLS = 1 << 21
#: Fewer prototypes than this are one ball; what rounding may add to a distance.
FEW, SLACK = 64, 1e-6
SIMILARITY = "array<struct<pattern: int, similarity: double>>"


@dataclass(frozen=True)
class Balls:
    """Prototypes of one length and one kind of comparison, in balls around pivots.

    Both similarities fall with a distance: of shapes scaled to 0..1, or, by correlation, of those centred and at unit length. A window further from a
    pivot than the ball's radius and the distance that the threshold allows together is near none of the ball's prototypes, so whole balls are left
    out, exactly, before any matrix product.
    """

    correlated: bool
    at: np.ndarray  # numbers of the prototypes, ball by ball
    shapes: np.ndarray
    varied: np.ndarray  # prototypes that aren't constant
    first: np.ndarray  # ball -> its first prototype, and the end
    pivots: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, prototypes: np.ndarray, at: np.ndarray, correlated: bool) -> Balls:
        shapes, varied = shapes_of(prototypes, correlated)
        many = int(np.sqrt(len(at))) if len(at) >= FEW else 1
        pivots = shapes[np.arange(many) * len(at) // many]
        own, gap = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
        for s in range(0, len(at), max(1, CELLS // many)):
            gaps = distances(shapes[s : s + max(1, CELLS // many)], pivots)
            own[s : s + len(gaps)], gap[s : s + len(gaps)] = gaps.argmin(axis=1), gaps.min(axis=1)
        radius = np.zeros(many)
        np.maximum.at(radius, own, gap)
        order = np.argsort(own, kind="stable")
        return cls(correlated, at[order], shapes[order], varied[order], np.searchsorted(own[order], np.arange(many + 1)), pivots, radius)

    def hits(self, windows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, prototype's number, similarity) of all at or above the threshold, and with how many prototypes each window was compared."""
        shapes, varied = shapes_of(windows, self.correlated)
        reach = np.inf if threshold <= 0 else 2 * np.sqrt(max(0, 1 - threshold)) if self.correlated else max(0, 1 - threshold) * np.sqrt(windows.shape[1])
        inside = distances(shapes, self.pivots) <= self.radius + reach + SLACK
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for ball in np.flatnonzero(inside.any(axis=0)):
            rows, part = np.flatnonzero(inside[:, ball]), slice(self.first[ball], self.first[ball + 1])
            if self.correlated:
                similarity = np.where(varied[rows, None] & self.varied[None, part], (shapes[rows] @ self.shapes[part].T + 1) / 2, 0.0)
            else:
                similarity = np.maximum(0, 1 - distances(shapes[rows], self.shapes[part]) / np.sqrt(windows.shape[1]))
            i, j = np.nonzero(similarity >= threshold)
            found.append((rows[i], self.at[part][j], similarity[i, j]))
        row, number, similar = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((number, row))
        return row[order], number[order], similar[order], inside @ np.diff(self.first)


def shapes_of(windows: np.ndarray, correlated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows scaled to 0..1, by correlation also centred and at unit length, and which aren't constant."""
    low, high = windows.min(axis=1, keepdims=True), windows.max(axis=1, keepdims=True)
    x = np.where(high > low, (windows - low) / np.where(high > low, high - low, 1), 0.0)
    if not correlated:
        return x, (high > low)[:, 0]
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-12, x / np.where(norm > 1e-12, norm, 1), 0.0), (norm > 1e-12)[:, 0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def patterns_of(library: DataFrame, most: int = MOST_PATTERNS) -> list[list]:
    """The library's rows in parts of about ``most``, each small enough to go to all tasks."""
    library = library.select("pattern_id", "complexity", "frequency", "prototype").where(F.size("prototype") > 0)
    parts = -(-library.count() // most)
    at = F.pmod(F.xxhash64("pattern_id"), F.lit(max(1, parts)))
    return [library.where(at == p).orderBy("pattern_id").collect() for p in range(parts)]


def by_length(patterns: list) -> list[tuple[int, list[Balls]]]:
    """The prototypes of each length there is, in balls, those compared by correlation (complexity 3 and more) for themselves."""
    kinds: dict[tuple[int, bool], list[int]] = {}
    for i, r in enumerate(patterns):
        kinds.setdefault((len(r["prototype"]), r["complexity"] >= 3), []).append(i)
    groups: dict[int, list[Balls]] = {}
    for (size, correlated), at in sorted(kinds.items()):
        prototypes = np.array([patterns[i]["prototype"] for i in at], dtype=float)
        groups.setdefault(size, []).append(Balls.of(prototypes, np.array(at), correlated))
    return list(groups.items())


def tail_hits(patterns: list, threshold: float):
    """A function of tails: the patterns near to each tail's last values, as (pattern, similarity), and how many it was compared with.

    Tails of a batch are compared with the prototypes of one length ball by ball, as matrix products.
    """
    groups = by_length(patterns)

    @F.pandas_udf(f"hits {SIMILARITY}, compared long")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tails = [np.asarray(t if t is not None else [], dtype=float) for t in part]
            out: list[list[dict]] = [[] for _ in tails]
            compared = np.zeros(len(tails), dtype=np.int64)
            for size, kinds in groups:
                long = [i for i, t in enumerate(tails) if len(t) >= size]
                if not long:
                    continue
                recent = np.stack([tails[i][-size:] for i in long])
                for balls in kinds:
                    row, number, similar, looked = balls.hits(recent, threshold)
                    compared[long] += looked
                    for i, n, x in zip(row.tolist(), number.tolist(), similar.tolist()):
                        out[long[i]].append({"pattern": n, "similarity": x})
            yield pd.DataFrame({"hits": pd.Series(out, dtype=object), "compared": compared})

    return hits


MATCH = "pattern_id string, complexity int, frequency long, window_size long, similarity double"


def compare_tails(tails: DataFrame, library: list[list], threshold: float) -> DataFrame:
    """Matches of each row's ``tail`` at or above the threshold, one part of the library after the other; its other columns stay."""
    keep = [c for c in tails.columns if c != "tail"]
    out = None
    for patterns in library:
        known = tails.sparkSession.createDataFrame(
            [(i, r["pattern_id"], r["complexity"], r["frequency"], len(r["prototype"])) for i, r in enumerate(patterns)],
            "pattern int, pattern_id string, complexity int, frequency long, window_size long",
        )
        hits = tails.withColumn("hit", F.explode(tail_hits(patterns, threshold)("tail")["hits"])).select(*keep, "hit.pattern", "hit.similarity")
        found = hits.join(F.broadcast(known), "pattern").select(*keep, "pattern_id", "complexity", "frequency", "window_size", "similarity")
        out = found if out is None else out.union(found)
    if out is None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in MATCH.split(", "))]
        out = tails.where(F.lit(False)).select(*keep, *nothing)
    return out


def pairs_compared(tails: DataFrame, library: list[list], threshold: float) -> DataFrame:
    """Each row's number of prototypes its ``tail`` is long enough for (``pairs``) and with how many of these it is compared; its other columns stay."""
    keep = [c for c in tails.columns if c != "tail"]
    compared, pairs = F.lit(0), F.lit(0)
    for patterns in library:
        compared += tail_hits(patterns, threshold)("tail")["compared"]
        for size, many in sorted(Counter(len(r["prototype"]) for r in patterns).items()):
            pairs += F.when(F.size("tail") >= size, many).otherwise(0)
    return tails.select(*keep, pairs.cast("long").alias("pairs"), compared.cast("long").alias("compared"))


def longest_of(library: list[list], least: int) -> int:
    return max([least, *(len(r["prototype"]) for part in library for r in part)])


def sliding_hits(closes: np.ndarray, before: int, groups: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (from ``before`` on) whose trailing closes look like a prototype, the prototype and the similarity.

    Windows of one length are a view of the closes; a stretch of them is compared with the prototypes of that length ball by ball.
    Windows with a missing close are left out.
    """
    rows, found, similar = [], [], []
    for size, kinds in groups:
        if len(closes) < size:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(closes, size)
        ends = np.arange(max(before, size - 1), len(closes))
        ends = ends[~np.isnan(windows[ends - size + 1]).any(axis=1)] if np.isnan(closes).any() else ends
        for balls in kinds:
            step = max(1, CELLS // (size + len(balls.at)))
            for s in range(0, len(ends), step):
                part = ends[s : s + step]
                row, number, similarity, _ = balls.hits(windows[part - size + 1], threshold)
                rows.append(part[row])
                found.append(number)
                similar.append(similarity)
    rows, found, similar = (np.concatenate([np.empty(0), *x]) for x in (rows, found, similar))
    return rows.astype(np.int64), found.astype(np.int32), similar


def history_trades(
    bars: DataFrame, library: DataFrame, holding: int = 5, threshold: float = 0.9, most_patterns: int = MOST_PATTERNS, chunk: int = CHUNK
) -> DataFrame:
    """Every window of a series that looks like a prototype is a trade: in at the window's last close, out ``holding`` bars later.

    Series are cut into chunks that repeat as many rows from before as the longest prototype has; a task slides over a chunk's closes, and only hits
    leave it, so a bar is sent about once however long prototypes are. Windows with a null close match nothing; an empty library gives no trades.
    """
    patterns = patterns_of(library, most_patterns)
    w = Window.partitionBy(KEY).orderBy(ORDER)
    ahead = bars.select(KEY, ORDER, F.col("trade_date").alias("entry_date"), F.col("close").cast("double").alias("entry_price"))
    ahead = ahead.withColumn("exit_date", F.lead("entry_date", holding).over(w)).withColumn("exit_price", F.lead("entry_price", holding).over(w))
    own = [KEY, ORDER, "entry_date", "exit_date", "entry_price", "exit_price"]
    added = [T.StructField("pattern", T.IntegerType()), T.StructField("similarity", T.DoubleType())]
    trades = None
    for part in patterns or [[]]:
        groups = by_length(part)

        def slide(table: pa.Table, before: int, groups: list = groups) -> pa.Table:
            closes = table.column("entry_price").to_numpy().astype(float)
            rows, found, similar = sliding_hits(closes, before, groups, threshold)
            return table.take(pa.array(rows)).append_column("pattern", pa.array(found)).append_column("similarity", pa.array(similar))

        hits = over_chunks(ahead.select(*own), longest_of([part], 1) - 1, slide, added, chunk).where("exit_price is not null")
        known = bars.sparkSession.createDataFrame(
            [(i, r["pattern_id"], r["complexity"], r["frequency"], len(r["prototype"])) for i, r in enumerate(part)],
            "pattern int, pattern_id string, complexity int, frequency long, window_size long",
        )
        named = hits.join(F.broadcast(known), "pattern").select(*own, "pattern_id", "complexity", "frequency", "window_size", "similarity")
        trades = named if trades is None else trades.union(named)
    return trades.withColumn("return_pct", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100)
