"""Periodic runs of words: a harmonic grid of (period, place) pairs extended by prefix hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, hashed_words, slices_of

#: A run has at least so many words and repeats its period so often.
LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Grid pairs looked at together.
PAIRS = 1 << 19
RUN = ("start", "length", "period")


def _furthest(same: Callable[[np.ndarray], np.ndarray], top: np.ndarray) -> np.ndarray:
    """For each pair the greatest m <= top with same(m), by one binary search over all pairs at once; same is monotone."""
    low, high = np.zeros_like(top), top.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        ok = same(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def maximal_runs(words: np.ndarray, at: np.ndarray, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> np.ndarray:
    """Runs of all texts as rows (text, start, length, period), ordered by text, start and period.

    ``words`` holds word hashes of all texts one after the other, ``at`` where each text starts, with one entry more
    than there are texts. A run of period p and r repeats holds (r - 1) * p successive places i whose word equals the one p later,
    so the grid of every (r - 1) * p-th place meets it: n / (r - 1) * ln(n) pairs over all periods. Pairs of unequal
    words go at once; from the others both ends are found by longest common extensions, each comparing two stretches by
    two differences of one prefix sum of words times powers. Runs met by several pairs, or under multiples of
    their period, become one of the smallest period.
    """
    n = np.diff(at)
    power = _powers(len(words) + 1)[0]
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=prefix[1:])

    def equal(i: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (prefix[i + m] - prefix[i]) * power[p] == prefix[i + p + m] - prefix[i + p]

    periods = n // repeats
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (n[text] - period - 1) // ((repeats - 1) * period) + 1
    sums = np.cumsum(points)
    found, a = [np.empty((0, 4), dtype=np.int64)], 0
    while a < len(text):
        before = int(sums[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(sums, before + PAIRS, side="right")))
        own = np.repeat(np.arange(a, b), points[a:b])
        place = np.arange(len(own)) - (sums[own] - points[own] - before)
        p = period[own]
        i = at[text[own]] + place * (repeats - 1) * p
        hit = words[i] == words[i + p]
        own, i, p = own[hit], i[hit], p[hit]
        first, end = at[text[own]], at[text[own] + 1]
        ahead = _furthest(lambda m: equal(i, p, m), end - i - p)
        back = _furthest(lambda m: equal(i - m, p, m), i - first)
        length = back + ahead + p
        good = length >= np.maximum(least, repeats * p)
        rows = np.stack([text[own], i - back - first, length, p], axis=1)[good]
        found.append(np.unique(rows, axis=0))
        a = b
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def word_runs(words: list[bytes], least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text by comparing its words themselves; used where hashes misled."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([ids[w] for w in words], dtype=np.int64)
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(x) // repeats + 1):
        edge = np.diff(np.concatenate([[0], (x[p:] == x[:-p]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e - s + p >= max(least, repeats * p):
                best.setdefault((s, e - s + p), p)
    return sorted((s, length, p) for (s, length), p in best.items())


def _true(words: list[bytes], runs: list[tuple[int, int, int]]) -> bool:
    """Whether the words of every run repeat after its period. (That neighbours don't is sure: their hashes differ.)"""
    return all(words[s : s + length - p] == words[s + p : s + length] for s, length, p in runs)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, keep: list[str], least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> DataFrame:
    """Every maximal periodic run of words in the ``text`` of each row, and the text without its repeats.

    Words are runs of other than ASCII white space, compared as they are. A run is a stretch of words with smallest
    period p (words p apart are equal), at least ``least`` words and ``repeats`` * p words long, that no neighbouring word
    extends. Candidates come from ``maximal_runs`` and are verified word by word; a text whose hashes misled is searched
    by its words. Whole texts of any length, one row after the other without a shuffle; memory grows with the longest text.

    Returns the columns ``keep``, n_words, runs (by start, then period) and collapsed: the words that are in no run or among the
    first p words of all that hold them, joined by one space. A null or empty text has no words, no runs and an empty
    ``collapsed``. Null and repeated ids don't matter: every row stands for itself. An empty table gives no rows;
    further columns, whatever their names, are ignored.
    """
    kept = [docs.schema[c] for c in keep]
    one = T.StructType([T.StructField(c, T.LongType()) for c in RUN])
    schema = T.StructType(kept).add("n_words", T.LongType()).add("runs", T.ArrayType(one)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole, "__text")):
            texts = batch.column("__text")
            hashes, at = hashed_words(texts, "cased")
            rows = maximal_runs(hashes, at, least, repeats)
            cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
            runs, left = [], []
            for k, text in enumerate(texts.to_pylist()):
                words = text.encode().split() if text else []
                own = [tuple(r) for r in rows[cuts[k] : cuts[k + 1], 1:].tolist()]
                if not _true(words, own):
                    own = word_runs(words, least, repeats)
                runs.append([dict(zip(RUN, r)) for r in own])
                left.append(_collapsed(words, own))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep], pa.array(np.diff(at).astype(np.int64)),
                    pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in RUN]))),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without one) and hashes of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.s")).alias("start"), F.col("__best.n").alias("length"), (-F.col("__best.p")).alias("period"),
        F.expr("(1000 * __best.n) div (-__best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def plant_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document by the CRC-32 of its id, all words from some place on repeat a first stretch.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows of a null id stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k, (i, text) in enumerate(zip(ids, texts)):
                h = zlib.crc32(str(i).encode()) if i is not None else 1
                if h % 10 or not text or not (words := text.encode().split()):
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                part = words[a : a + p]
                texts[k] = b" ".join(words[:a] + (part * (-(-(n - a) // p)))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], docs.schema["text"]]))
