"""Secret scan: fixed patterns, and a randomness battery with false-discovery control."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in their listed order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: Encodings by name: alphabet size. base36 tokens are of one letter case.
ALPHABETS = {"hex": 16, "base32": 32, "base36": 36, "base64": 64}
LENGTH_BINS, SCORE_BINS, SCORE_STEP = 24, 120, 0.1
#: Plain words that a stratum is compared with, if there are so many; beyond the last of them with ``FEW`` at or above
#: a score, an exponential tail stands for them that falls by 1/e in ``LEAST_EXCESS`` score steps or more.
ENOUGH_WORDS, FEW, LEAST_EXCESS = 1_000, 10, 5.0
#: Letters alone are read as base64 if upper and lower case change so often.
CASE_CHANGES = 0.25
#: What separates the parts of a path or slug, and the length up to which such a part may be anything.
SEPARATOR, LABEL = re.compile("[-_/]"), 4

SPAN = "kind int, start int, end int"
FOUND = (
    f"base array<struct<{SPAN}>>, "
    "tokens array<struct<start int, end int, enc string, len_bin int, score int>>, "
    "words array<struct<enc string, len_bin int, score int>>"
)

_B64 = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _B64[ord(_c)] = _i
_B64[ord("-")], _B64[ord("_")], _B64[ord("=")] = 62, 63, 63
_B36 = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
    _B36[ord(_c)] = _B36[ord(_c.upper())] = _i
_B32 = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
    _B32[ord(_c)] = _i
_TABLES = {"hex": _B36, "base32": _B32, "base36": _B36, "base64": _B64}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(2, *m.span()) for m in HEX_LONG.finditer(text)]  # its matches are the maximal runs of [0-9a-f]+
    return spans


def _plain(part: str) -> bool:
    """Whether a part of a token is a number, a short label or a word."""
    if len(part) <= LABEL or part.isdigit():
        return True
    return part.isalpha() and sum(a.isupper() != b.isupper() for a, b in zip(part, part[1:])) < CASE_CHANGES * len(part)


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None for plain words and plain numbers.

    Letters of one case, or of both with few changes between them, are plain words: nothing tells them from prose. A path or
    slug, of plain words and numbers between "/", "-" and "_", counts as plain too.
    """
    core = token.rstrip("=")
    if all(map(_plain, SEPARATOR.split(core))):
        return None
    if core.isalpha():
        return "base64"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", core):
        return "base32"
    if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", core):
        return "base36"
    return "base64"


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """P(Z >= z) of the normal law (Abramowitz and Stegun 26.2.17)."""
    x = np.minimum(np.abs(z), 12.0)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, tail, 1 - tail)


def battery(tokens: list[str], encoding: str) -> np.ndarray:
    """Fisher-combined p-value of "the symbols are uniform and independent" for each token.

    Chi-squared of binned symbols, runs above and below the middle of the alphabet, and the
    lag-1 serial correlation. Plain words have minute values, random strings uniform ones.
    """
    if not tokens:
        return np.empty(0)
    size, lut = ALPHABETS[encoding], _TABLES[encoding]
    lengths = np.array([len(t) for t in tokens])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(tokens)), lengths)
    sym = lut[np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)]

    bins = np.clip(lengths // 4, 4, 16)
    cell = sym * bins[owner] // size
    counts = np.bincount(owner * 16 + cell, minlength=16 * len(tokens)).reshape(-1, 16)
    # a cell holds whole symbols, so its expected share is counted rather than taken as 1/bins
    share = np.zeros((17, 16))
    for b in range(4, 17):
        share[b] = np.bincount(np.arange(size) * b // size, minlength=16) / size
    expected = share[bins] * lengths[:, None]
    chi = np.where(expected > 0, (counts - expected) ** 2 / np.maximum(expected, 1e-9), 0).sum(1)
    df = np.maximum((expected > 0).sum(1) - 1, 1)
    p_chi = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))

    high = (sym >= size / 2).astype(np.int64)
    n1 = np.add.reduceat(high, at)
    n0 = lengths - n1
    change = np.concatenate([[0], high[1:] != high[:-1]]).astype(np.int64)
    change[at] = 0
    runs = np.add.reduceat(change, at) + 1
    mean = 2.0 * n0 * n1 / lengths + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(lengths - 1, 1), 1e-9)
    one_sided = (n0 == 0) | (n1 == 0)
    z = np.where(one_sided, np.sqrt(lengths), (runs - mean) / np.sqrt(np.where(one_sided, 1, var)))
    p_runs = 2 * _upper_tail(np.abs(z))

    x = sym - np.repeat(np.add.reduceat(sym, at) / lengths, lengths)
    power = np.maximum(np.add.reduceat(x * x, at), 1e-9)
    lag = np.concatenate([[0.0], x[1:] * x[:-1]])
    lag[at] = 0
    r = np.add.reduceat(lag, at) / power
    p_serial = 2 * _upper_tail(np.abs(r * lengths + 1) / np.sqrt(lengths))

    fisher = -np.log(np.clip(np.stack([p_chi, p_runs, p_serial]), 1e-30, 1)).sum(0)
    return np.clip(np.exp(-fisher) * (1 + fisher + fisher**2 / 2), 1e-30, 1)


def _score(p: np.ndarray) -> np.ndarray:
    """0 .. SCORE_BINS - 1, higher: more like random symbols."""
    return np.clip(SCORE_BINS - 1 + np.log10(p) / SCORE_STEP, 0, SCORE_BINS - 1).astype(int)


def _len_bin(tokens: list[str]) -> np.ndarray:
    n = np.array([len(t) for t in tokens], dtype=int)
    short, long = (n - 16) // 2, 8 + np.log2(np.maximum(n, 32) / 32) * 4
    return np.minimum(np.where(n < 32, short, long), LENGTH_BINS - 1).astype(int)


def examine(texts: pd.Series) -> pd.DataFrame:
    """Per text: fixed-pattern spans, tested tokens with their scores, scores of its plain words."""
    base, place, names, nulls = [], [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        spans = base_spans(text)
        base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
        for m in CANDIDATE.finditer(text):
            token = m[0]
            if enc := infer_encoding(token):
                if not any(s <= m.start() and m.end() <= e for _, s, e in spans):  # what a fixed pattern holds needs no test
                    place.append((i, m.start(), m.end()))
                    names.append((enc, token))
            elif token.isalpha():
                nulls.append((i, token))
    tokens: list[list] = [[] for _ in base]
    for enc in ALPHABETS:
        own = [j for j, (e, _) in enumerate(names) if e == enc]
        strings = [names[j][1] for j in own]
        for j, score, length in zip(own, _score(battery(strings, enc)), _len_bin(strings)):
            i, start, end = place[j]
            tokens[i].append({"start": start, "end": end, "enc": enc, "len_bin": int(length), "score": int(score)})
    words: list[list] = [[] for _ in base]
    strings = [t for _, t in nulls]
    for enc in ("base36", "base64"):
        for (i, _), score, length in zip(nulls, _score(battery(strings, enc)), _len_bin(strings)):
            words[i].append({"enc": enc, "len_bin": int(length), "score": int(score)})
    return pd.DataFrame({"base": base, "tokens": tokens, "words": words})


def null_of(enc: str) -> str:
    """Whose plain words stand for "no secret": those read as base64, or as one-case symbols."""
    return "base64" if enc == "base64" else "base36"


def null_tail(null: np.ndarray) -> np.ndarray:
    """For each score the share of plain words that reach it, from their histogram.

    Few words reach the highest scores, so there the share is read off an exponential tail fitted to the top tenth,
    whatever the number of words; with fewer than ``ENOUGH_WORDS`` it never falls below one of them.
    """
    above, n = null[::-1].cumsum()[::-1], null.sum()
    p = (1 + above) / (1 + n)
    if n >= ENOUGH_WORDS:
        top = int(np.flatnonzero(above >= n / 10)[-1])
        steps = np.arange(len(null)) - top
        excess = max(LEAST_EXCESS, float((null * (steps + 0.5))[top:].sum() / above[top]))
        tail = above[top] / n * np.exp(-np.maximum(steps, 0) / excess)
        p = np.where(above < FEW, np.minimum(p, tail), p)
    return p


def thresholds(tested: list[tuple[str, int, int, int]], plain: list[tuple[str, int, int, int]], q: float) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg in each stratum of encoding and length.

    Takes histograms (encoding, length bin, score, count) of tested tokens and of plain
    words; a token's p-value is the share of equally long plain words that look as random (``null_tail``).
    Where there are few of that length, shorter ones are added, which look more random than
    longer ones and so only make a discovery harder.
    Returns the least score that counts as a discovery, where there is one.
    """
    out = {}
    for stratum in {(e, b) for e, b, _, _ in tested}:
        enc, length = stratum
        have, null = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
        for e, b, s, n in tested:
            if (e, b) == stratum:
                have[s] += n
        for near in range(length, -1, -1):
            for e, b, s, n in plain:
                if (e, b) == (null_of(enc), near):
                    null[s] += n
            if null.sum() >= ENOUGH_WORDS:
                break
        above = have[::-1].cumsum()[::-1]
        ok = np.flatnonzero((null_tail(null) <= q * above / max(have.sum(), 1)) & (above > 0))
        if len(ok):
            out[stratum] = int(ok[0])
    return out


def scan_secrets(
    docs: DataFrame,
    keep: list[str],
    q: float = 0.01,
    least_score: int = SCORE_BINS - 31,
    text_col: str = "text",
    out: str = "spans",
) -> DataFrame:
    """Returns the columns ``keep`` and ``out``, an array of (start, kind, end) by start, then kind.

    Positions are code points, the end exclusive. Kinds 0-2 are the fixed patterns. Kind 3
    are other tokens of 16 or more symbols whose battery says "random": a p-value of 10^-3
    or more (``least_score``) and, against the plain words of equal length in all
    documents, a discovery at rate ``q``. The corpus side is a histogram of fixed size
    (encodings x length bins x score bins), so nothing that grows reaches the driver.

    A null or empty text has no spans; a text of any length is scanned whole; equal rows get equal spans; spans of
    different kinds may overlap (a random token that holds a fixed pattern has both); an empty table stays
    empty; other columns, whatever their names, aren't looked at.
    """
    udf = F.pandas_udf(examine, FOUND)
    found = materialize(docs.select(*keep, udf(F.col(text_col)).alias("__found")), "secrets")

    def histogram(part: str) -> list[tuple[str, int, int, int]]:
        x = found.select(F.explode(f"__found.{part}").alias("t"))
        return [tuple(r) for r in x.groupBy("t.enc", "t.len_bin", "t.score").count().collect()]

    cut = thresholds(histogram("tokens"), histogram("words"), q)
    least = F.create_map(*[x for (e, b), s in cut.items() for x in (F.lit(f"{e}/{b}"), F.lit(max(s, least_score)))]) if cut else None

    def random_enough(t):
        return t["score"] >= F.coalesce(least[F.concat(t["enc"], F.lit("/"), t["len_bin"].cast("string"))], F.lit(SCORE_BINS))

    def span(t, kind):
        return F.struct(t["start"].alias("start"), kind.alias("kind"), t["end"].alias("end"))

    spans = F.transform("__found.base", lambda t: span(t, t["kind"]))
    if cut:
        extra = F.filter("__found.tokens", random_enough)
        spans = F.concat(spans, F.transform(extra, lambda t: span(t, F.lit(3))))
    return found.select(*keep, F.array_sort(spans).alias(out))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, span list and checksum of the fixed patterns, from ``scan_secrets`` output."""
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda t: F.concat_ws(":", F.element_at(name, t["kind"] + 1), t["start"], t["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda t: t["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda t: t["kind"] < 3)
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """Replaces every span of ``spans`` in the text and drops that column; overlapping spans count as one."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, where: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, where):
            if text is None or not len(found):
                out.append(text)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda t: t["start"]):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], mark]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return scanned.withColumn(text_col, cut(text_col, spans)).drop(spans)
