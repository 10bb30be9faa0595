"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import logistic_fit, materialize, small_broadcast

#: Bounded, documented sample of labelled rows, in hash order.
TRAIN_ROWS = 12_000
THRESHOLD = 0.5
#: Site tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
FEATURES = (
    "log_words", "word_length", "distinct", "repeats", "upper", "digits", "symbols", "exclaims", "bars", "marks", "top_word", "same_lines", "short_words",
)
_UPPER, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_MARK[[ord(c) for c in "#$%&*@^~=_<>{}[]\\"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None) -> list[float]:
    """Shares and lengths of a whole text, each between 0 and about 10."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, count[_LETTER].sum())
    solid = max(1, len(raw) - count[_SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n) / 2,
        min(solid / n / 5, 10.0),
        len(set(words)) / n,
        sum(map(eq, words[1:], words)) / n,
        count[_UPPER].sum() / letters,
        count[_DIGIT].sum() / solid,
        1 - (count[_LETTER].sum() + count[_DIGIT].sum()) / solid,
        min(10.0, 10 * count[33] / solid),
        min(10.0, 10 * count[124] / solid),
        min(10.0, 10 * count[_MARK].sum() / solid),
        Counter(words).most_common(1)[0][1] / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / n,
    ]


def expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -6, 6)
    return np.hstack([z, z**2])


def classifier(rows: list[tuple[list[float], int]]):
    """A ridge logistic regression on standardised features and their squares."""
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    return mean, sd, logistic_fit(expand(x, mean, sd), y, l2=1e-4)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


@dataclass(frozen=True)
class Variances:
    """Grand mean and the variances of documents within a path, of paths within a host, and of hosts."""

    mean: float
    document: float
    path: float
    host: float


def variances(paths: DataFrame) -> Variances:
    """Nested random effects by moments, from (host, path, n, s, ss): counts, sums and sums of squares.

    Paths are held against their own host's mean, so what differs between hosts doesn't count as differing between paths.
    """
    n, m = F.col("n").cast("double"), F.col("s") / F.col("n")
    hosts = paths.groupBy("host").agg(
        F.sum(n).alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.count("*").alias("p"),
        F.sum(n * m * m).alias("nm2"), F.sum(n * n).alias("n2"),
    )
    r = hosts.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("p").alias("p"), F.count("*").alias("h"),
        F.sum("nm2").alias("path2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("host2"),
        F.sum("n2").alias("n2"), F.sum(F.col("n2") / F.col("n")).alias("own"), F.sum(F.col("n") * F.col("n")).alias("hosts"),
    ).first()
    if not r["n"]:
        return Variances(0.5, 1.0, 0.0, 0.0)
    total, mean = r["n"], r["s"] / r["n"]
    document = max((r["ss"] - r["path2"]) / max(total - r["p"], 1.0), 1e-6)
    path = max((r["path2"] - r["host2"] - (r["p"] - r["h"]) * document) / max(total - r["own"], 1e-9), 0.0) if r["p"] > r["h"] else 0.0
    spread = r["host2"] - total * mean * mean - (r["h"] - 1) * document - path * (r["own"] - r["n2"] / total)
    host = max(spread / max(total - r["hosts"] / total, 1e-9), 0.0) if r["h"] > 1 else 0.0
    return Variances(mean, document, path, host)


def posteriors(paths: DataFrame, v: Variances) -> DataFrame:
    """(host, path, host_posterior, path_posterior): means shrunk toward the grand mean and the host's, the more the less they rest on."""
    n = F.col("n").cast("double")
    hosts = paths.groupBy("host").agg(F.sum(n).alias("all"), F.sum("s").alias("sum"), F.sum(n * n).alias("n2"))
    noise = v.document / F.col("all") + v.path * F.col("n2") / (F.col("all") * F.col("all"))
    trust = F.lit(v.host) / (F.lit(v.host) + noise)
    hosts = hosts.select("host", (trust * F.col("sum") / F.col("all") + (1 - trust) * v.mean).alias("host_posterior"))
    trust = F.lit(v.path) / (F.lit(v.path) + v.document / n)
    own = trust * F.col("s") / n + (1 - trust) * F.col("host_posterior")
    return paths.join(hosts, "host").select("host", "path", "host_posterior", own.alias("path_posterior"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    host: Column,
    path: Column,
    train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD,
    prefix: str = "quality_",
    train: DataFrame | None = None,
) -> DataFrame:
    """Quality of every whole text: classifier evidence with the posteriors of its host and path.

    A logistic classifier over surface shares learns from at most ``train_rows`` labelled
    rows of ``train`` (default: of ``docs``). Its probabilities are summed over all documents of each (host, path). A host's
    posterior is its mean shrunk toward the global mean, a path's is its mean shrunk toward its host's;
    how strongly follows from the variances of hosts, of paths within a host and of documents within a path, so a site of few
    documents says little. The score is the document's log-odds moved by the path's
    log-odds over the global ones.

    An empty or null text, or one of white space, has score 0; null hosts and paths are groups of their
    own; without labels of both kinds every other text has the evidence 0.5 and is kept;
    conflicting labels of one doc_id count as low; texts of any length are measured whole; equal rows get equal scores; an empty
    table gives no rows. Returns the columns ``keep`` (which must hold doc_id) with evidence,
    host_posterior, path_posterior, score and kept, their names after ``prefix``, which no name in
    ``keep`` may start with; other columns aren't looked at.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = marks.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(21), "doc_id"), "doc_id").limit(train_rows)
    marks = marks.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    sample = (docs if train is None else train).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    sample = sample.select("doc_id", measure("text").alias("x"), "quality").orderBy("doc_id", "x").collect()  # 13 numbers a row
    rows = [(r["x"], r["quality"]) for r in sample]
    model = classifier(rows) if len({y for _, y in rows}) == 2 else None

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        if model is None:
            return texts.map(lambda t: 0.5)
        if not len(texts):
            return pd.Series([], dtype=float)
        mean, sd, beta = model
        z = expand(np.array([features(t) for t in texts]), mean, sd)
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ beta[:-1] + beta[-1], -35, 35))))

    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("\\S")
    scored = docs.select(
        *keep,
        F.coalesce(host.cast("string"), F.lit("")).alias(f"{prefix}host"),
        F.coalesce(path.cast("string"), F.lit("")).alias(f"{prefix}path"),
        blank.alias(f"{prefix}blank"),
        evidence("text").alias(f"{prefix}evidence"),
    )
    scored = materialize(scored, "evidence")

    p = F.col(f"{prefix}evidence")
    paths = scored.groupBy(F.col(f"{prefix}host").alias("host"), F.col(f"{prefix}path").alias("path")).agg(
        F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")
    )
    paths = materialize(paths, "paths")
    v = variances(paths)
    sites = posteriors(paths, v)
    sites = sites.select(*[F.col(c).alias(f"{prefix}{c}") for c in sites.columns])
    joined = scored.join(small_broadcast(sites, paths.count(), BROADCAST_ROWS), [f"{prefix}host", f"{prefix}path"])
    odds = _logit(p) + _logit(F.col(f"{prefix}path_posterior")) - _logit(F.lit(v.mean))
    score = F.when(F.col(f"{prefix}blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds)))
    return (
        joined.withColumn(f"{prefix}score", score)
        .withColumn(f"{prefix}kept", F.col(f"{prefix}score") >= threshold - 1e-9)
        .select(*keep, *[f"{prefix}{c}" for c in ("evidence", "host_posterior", "path_posterior", "score", "kept")])
    )
