"""Zigzag pivots: chunks of a series work in parallel, what they do to any entering state is folded along the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK
from ..functions.columns import KEY, ORDER
from ..functions.storage import stored

#: A leg: its direction (+1 rising), its highest price so far (negative prices for a falling one) and the row of that (-1: before these rows).
Leg = tuple[int, float, int]
START: Leg = (1, -np.inf, -1)


def sides(high: np.ndarray, low: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """What a leg follows and what ends it. A falling leg is a rising one of negative prices."""
    return (high, low) if sign > 0 else (-low, -high)


def leg_end(lead: np.ndarray, other: np.ndarray, start: int, fall: float, top: float, part: int = 256) -> tuple[float, int | None, int | None]:
    """Of a leg whose high before row ``start`` is ``top``: its high, the first row of that if at or after ``start``, and the row that ends it, if any does.

    A row ends the leg if it brings no new high and its ``other`` is below the high so far times ``fall``.
    """
    at = None
    for a in range(start, len(lead), part):
        x = lead[a : a + part]
        before = np.maximum.accumulate(np.append(top, x))[:-1]
        ends = np.flatnonzero((x <= before) & (other[a : a + part] < before * fall))
        seen = x[: ends[0]] if len(ends) else x
        if len(seen) and seen.max() > top:
            top, at = seen.max(), a + int(seen.argmax())
        if len(ends):
            return top, at, a + int(ends[0])
    return top, at, None


def legs_through(high: np.ndarray, low: np.ndarray, threshold: float, leg: Leg = START, row: int = 0) -> tuple[list[tuple[int, float, int]], Leg]:
    """(row, price, +1 peak or -1 valley) of the legs that end from ``row`` on, and the leg that is open at the end."""
    sign, top, at = leg
    ended = []
    while True:
        lead, other = sides(high, low, sign)
        top, later, end = leg_end(lead, other, row, 1 - sign * threshold, top)
        at = at if later is None else later
        if end is None:
            return ended, (sign, float(top), at)
        ended.append((at, float(sign * top), sign))
        sign = -sign
        top, at, row = sides(high, low, sign)[0][end], end, end + 1


def zigzag_pivots(high: np.ndarray, low: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
    """(row, price, +1 peak or -1 valley) of turns by more than ``threshold``; the open last pivot included; none of fewer than two rows."""
    if len(high) < 2:
        return []
    ended, (sign, top, at) = legs_through(high, low, threshold)
    return [*ended, (at, sign * top, sign)]


def least_above(other: np.ndarray, fall: float) -> np.ndarray:
    """The least number whose product with ``fall`` is above ``other``, for each."""
    p = other / fall
    for _ in range(3):
        p = np.nextafter(p, -np.inf)
    for _ in range(8):
        p = np.where(p * fall > other, p, np.nextafter(p, np.inf))
    return p


def effect(high: np.ndarray, low: np.ndarray, threshold: float, sign: int) -> list[tuple[float | None, Leg]]:
    """What rows make of any leg of direction ``sign`` that enters them: (least high of an entering leg, leg that is open at the end), highest first.

    The first entry whose bound the entering high reaches is the one that holds: the higher a leg is, the earlier a row ends it, and which row
    ends it decides all that follows. None as the bound: no row ends the leg; then the leg given is that of the rows alone.
    """
    lead, other = sides(high, low, sign)
    fall = 1 - sign * threshold
    before = np.maximum.accumulate(np.append(-np.inf, lead))[:-1]
    own = np.flatnonzero((lead <= before) & (other < before * fall))
    n = int(own[0]) if len(own) else len(lead)
    bound = np.maximum(lead[:n], least_above(other[:n], fall))
    lowest = np.minimum.accumulate(np.append(np.inf, bound))
    ending = [(float(bound[i]), int(i)) for i in np.flatnonzero(bound < lowest[:-1])] + [(-np.inf, n)] * bool(len(own))
    follow = sides(high, low, -sign)[0]
    rises = np.append(follow[1:] > follow[:-1], False)
    stops = np.flatnonzero(~rises)  # a leg that starts where the next row leads on is the one that starts there
    known: dict[int, Leg] = {}
    out: list[tuple[float | None, Leg]] = []
    for p, i in ending:
        i = int(stops[np.searchsorted(stops, i)])
        if i not in known:
            known[i] = legs_through(high, low, threshold, (-sign, float(follow[i]), i), i + 1)[1]
        if out and out[-1][1] == known[i]:
            out.pop()
        out.append((p, known[i]))
    if not len(own):
        out.append((None, (sign, float(lead.max()), int(lead.argmax()))))
    return out


def entering_legs(effects: pd.DataFrame) -> list[tuple[int, int, float, int]]:
    """(chunk, direction, high, row) of the leg that enters each chunk of a series, from all chunks' effects."""
    sign, top, at = START
    out = []
    for chunk, rows in effects.groupby("chunk", sort=True):
        out.append((int(chunk), sign, top, at))
        mine = rows[rows["sign"] == sign]
        turned = mine[mine["bound"].le(top)]
        if len(turned):
            first = turned.loc[turned["bound"].idxmax()]
            sign, top, at = int(first["out_sign"]), float(first["out_top"]), int(first["out_at"])
        else:
            stay = mine[mine["bound"].isna()].iloc[0]
            if stay["out_top"] > top:
                top, at = float(stay["out_top"]), int(stay["out_at"])
    return out


def zigzag(bars: DataFrame, threshold: float = 0.05, size: int = CHUNK) -> DataFrame:
    """Pivots of every series, a chunk of ``size`` order numbers a task.

    A turn depends on all before it, but only by the leg that is open. So every chunk first says what it makes of any leg that enters it (``effect``:
    a few rows, as paths soon meet), one fold of these a series gives the leg that does enter each, and with it every chunk finds its pivots.
    Series of a single chunk need no fold and are walked once.
    Ids may be of any type, null being one of them; rows without a high or a low are left out; a series of one row has no pivot.
    """
    kind = bars.schema[KEY].dataType.simpleString()
    whole = bars.select(KEY, F.col(ORDER).cast("long").alias(ORDER), F.col("high").cast("double"), F.col("low").cast("double")).dropna(subset=["high", "low"])
    whole = whole.withColumn("chunk", F.expr(f"{ORDER} div {size}"))

    def name(key: tuple):
        return None if pd.isna(key[0]) else key[0]

    def table(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({KEY: object})

    def effects_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        high, low, order = pdf["high"].to_numpy(), pdf["low"].to_numpy(), pdf[ORDER].to_numpy()
        rows = [
            (name(key), int(key[1]), len(pdf), sign, p, s, top, int(order[at]))
            for sign in (1, -1) for p, (s, top, at) in effect(high, low, threshold, sign)
        ]
        return table(rows, [KEY, "chunk", "n", "sign", "bound", "out_sign", "out_top", "out_at"])

    def entries_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        legs = entering_legs(pdf)
        many = int(pdf.groupby("chunk")["n"].first().sum()) > 1
        rows = [(name(key), *leg, many and i == len(legs) - 1) for i, leg in enumerate(legs)]
        return table(rows, [KEY, "chunk", "sign", "top", "at", "closes"])

    def pivots_of(key: tuple, pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf, e = pdf.sort_values(ORDER), entry.iloc[0]
        order = np.append(pdf[ORDER].to_numpy(), int(e["at"]))  # row -1 is that of the entering leg
        leg = (int(e["sign"]), float(e["top"]), -1)
        found, (sign, top, at) = legs_through(pdf["high"].to_numpy(), pdf["low"].to_numpy(), threshold, leg)
        if e["closes"]:
            found.append((at, sign * top, sign))
        rows = [(name(key), int(order[i]), price, "peak" if mark > 0 else "valley", mark) for i, price, mark in found]
        return table(rows, [KEY, ORDER, "price", "type", "mark"])

    def pivots_at_once(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        order, found = pdf[ORDER].to_numpy(), zigzag_pivots(pdf["high"].to_numpy(), pdf["low"].to_numpy(), threshold)
        return table([(name(key), int(order[i]), price, "peak" if mark > 0 else "valley", mark) for i, price, mark in found], [KEY, ORDER, "price", "type", "mark"])

    pivots = f"{KEY} {kind}, {ORDER} long, price double, type string, mark int"
    own = Window.partitionBy(KEY)
    whole = stored(whole.withColumn("many", F.min("chunk").over(own) < F.max("chunk").over(own)), "bars")
    short, whole = whole.where("not many"), whole.where("many").drop("many")
    at_once = short.select(KEY, ORDER, "high", "low").groupBy(KEY).applyInPandas(pivots_at_once, pivots)
    if not whole.take(1):
        return at_once
    chunks = whole.groupBy(KEY, "chunk")
    effects = chunks.applyInPandas(
        effects_of, f"{KEY} {kind}, chunk long, n long, sign int, bound double, out_sign int, out_top double, out_at long"
    )
    entries = effects.groupBy(KEY).applyInPandas(entries_of, f"{KEY} {kind}, chunk long, sign int, top double, at long, closes boolean")
    return at_once.union(chunks.cogroup(entries.groupBy(KEY, "chunk")).applyInPandas(pivots_of, pivots))
