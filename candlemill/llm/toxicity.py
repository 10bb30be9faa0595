"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import logistic_fit, materialize

#: An open list of common English insults; each word is one voter.
LEXICON = (
    "idiot moron stupid trash garbage scum loser pathetic worthless disgusting clown dumb fool imbecile jerk "
    "creep filth vermin coward liar ugly hate kill die shut bastard bitch crap damn hell ass asshole shit fuck "
    "retard freak pig rat useless ridiculous"
).split()
#: Patterns that vote by their share or count in a text.
PATTERNS = ("shouting", "exclaiming", "second_person")

#: Bounded, documented sample of labelled rows, in hash order; at most so many mined voters.
TRAIN_ROWS, MOST_VOTERS = 12_000, 500
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (4, 5)
LEAST_G2 = 20.0
LABEL_ODDS = np.log(0.97 / 0.03)
THRESHOLD = 0.3
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_/\\"


def words_of(text: str) -> set[str]:
    return {w.strip(_EDGE) for w in text.lower().split()}


def terms_of(word: str) -> list[str]:
    """The word, its beginnings and its ends, marked as such."""
    if not word or not word.isalpha():
        return []
    out = [word]
    out += [word[:n] + "*" for n in PREFIXES if len(word) > n]
    return out + ["*" + word[-n:] for n in SUFFIXES if len(word) > n]


def patterns_of(text: str) -> list[bool]:
    n = len(text) or 1
    upper = sum(map(str.isupper, text)) / n
    low = f" {text.lower()} "
    return [upper > 0.5, text.count("!") / n > 0.02, any(x in low for x in (" you are ", " you're ", " your ", " shut up "))]


@dataclass
class ToxicModel:
    voters: dict[str, int]
    weights: np.ndarray

    def __post_init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def fired(self, text: str) -> set[int]:
        out: set[int] = set()
        cache = self.cache
        for w in words_of(text):
            hit = cache.get(w)
            if hit is None:
                if len(cache) > 500_000:
                    cache.clear()
                hit = cache[w] = tuple(self.voters[t] for t in terms_of(w) if t in self.voters)
            out.update(hit)
        base = len(self.voters)
        out.update(base + i for i, on in enumerate(patterns_of(text)) if on)
        return out

    def votes(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.voters) + len(PATTERNS)))
        for i, t in enumerate(texts):
            out[i, list(self.fired(t))] = 1
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.weights[-1])
        for i, t in enumerate(texts):
            z[i] += self.weights[list(self.fired(t))].sum()
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def label_model(votes: np.ndarray, labels: np.ndarray, steps: int = 20) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of label 1 from voters of unknown, dependent quality, by expectation maximisation.

    Each voter fires with one rate on toxic and another on clean texts; the given label is
    one more voter of known quality. What two voters share beyond the label, the residual
    correlation, divides their weight, so ten beginnings of one word don't count ten times.
    """
    v, q = votes, labels.astype(float)
    n = len(v)
    weight, rates = np.ones(v.shape[1]), {}
    for _ in range(steps):
        pos, neg = q.sum() + 1, n - q.sum() + 1
        on = np.clip((q @ v + 0.5) / (pos + 1), 1e-4, 1 - 1e-4)
        off = np.clip(((1 - q) @ v + 0.5) / (neg + 1), 1e-4, 1 - 1e-4)
        rest = v - np.outer(q, on) - np.outer(1 - q, off)
        sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        corr = (rest / sd).T @ (rest / sd) / n
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        odds = np.log(pos / neg) + (v * (weight * np.log(on / off)) + (1 - v) * (weight * np.log((1 - on) / (1 - off)))).sum(axis=1)
        odds += np.where(labels == 1, LABEL_ODDS, -LABEL_ODDS)
        new = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
        moved = np.abs(new - q).max()
        q = new
        rates = {"on": on, "off": off, "weight": weight, "correlation": corr}
        if moved < 1e-6:
            break
    return q, rates


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pos, all_ = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            terms = {t for w in words_of(text or "") for t in terms_of(w)}
            all_.update(terms)
            if label:
                pos.update(terms)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(list(all_), pa.string()),
                "n": pa.array(list(all_.values()), pa.int64()),
                "pos": pa.array([pos[t] for t in all_], pa.int64()),
            }
        )


def mine_voters(train: DataFrame, positives: int, rows: int, most: int = MOST_VOTERS) -> list[str]:
    """Words, beginnings and ends that mark toxic rows: log-likelihood ratio G2 >= 20, the best ``most``."""
    counts = train.mapInArrow(_count_terms, "term string, n long, pos long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    rate = positives / rows
    a, b = F.col("pos"), F.col("n") - F.col("pos")
    g2 = 2 * (F.when(a > 0, a * F.log(a / (F.col("n") * F.lit(rate)))).otherwise(0.0)
              + F.when(b > 0, b * F.log(b / (F.col("n") * F.lit(1 - rate)))).otherwise(0.0))
    marked = counts.withColumn("g2", g2).where((F.col("g2") >= LEAST_G2) & (a > F.col("n") * F.lit(min(0.5, 3 * rate))))
    return [r["term"] for r in marked.orderBy(F.desc("g2"), "term").limit(most).collect()]


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicModel | None:
    """Learns from (key, text, toxic) rows: at most ``train_rows`` in hash order."""
    sample = labelled.select("key").orderBy(F.xxhash64(F.lit(9), "key"), "key").limit(train_rows)
    train = labelled.join(F.broadcast(sample.distinct()), "key", "left_semi").select("text", "toxic")
    rows = [tuple(r) for r in train.groupBy("toxic").count().collect()]
    total, positives = sum(n for _, n in rows), sum(n for t, n in rows if t == 1)
    if not positives or positives == total:
        return None
    terms = list(dict.fromkeys([*LEXICON, *mine_voters(train, positives, total)]))
    model = ToxicModel({t: i for i, t in enumerate(terms)}, np.zeros(len(terms) + len(PATTERNS) + 1))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            v = np.packbits(m.votes([t or "" for t in batch.column("text").to_pylist()]).astype(bool), axis=1)
            yield pa.RecordBatch.from_pydict({"votes": pa.array([r.tobytes() for r in v], pa.binary()), "toxic": batch.column("toxic").cast(pa.int32())})

    got = train.mapInArrow(vote, "votes binary, toxic int").toArrow()  # a bit a voter and sampled row
    width = len(terms) + len(PATTERNS)
    packed = np.frombuffer(b"".join(got.column("votes").to_pylist()), dtype=np.uint8).reshape(got.num_rows, -1)
    votes, labels = np.unpackbits(packed, axis=1, count=width).astype(float), got.column("toxic").to_numpy()
    order = np.lexsort([*packed.T[:8], labels])  # the same sums whatever the order of arrival
    votes, labels = votes[order], labels[order]
    posterior, _ = label_model(votes, labels)
    model.weights = logistic_fit(votes, posterior, l2=1e-5)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text; learns from labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    Voters are a lexicon, patterns, and words, beginnings and ends mined from a bounded
    sample of labelled rows. A generative label model weighs them by their accuracies and
    residual correlations; a logistic classifier over the votes is trained on its posterior labels. Only
    the text is an input of a score.

    A null text counts as empty; rows of one label only, or none, give the label's share or 0
    to every row; a doc_id labelled more than once counts as toxic if any label says so; equal texts get
    equal scores; an empty table gives no rows; further columns are ignored.
    Returns doc_id, held_out, score, predicted (1 if score >= ``threshold``).
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & ~held)
    ids = marks.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(train_rows)
    marks = marks.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = plain.join(F.broadcast(marks), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic")
    model = fit(materialize(labelled, "labelled"), train_rows)  # a few thousand rows, read three times
    if model is None:
        share = marks.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return plain.select(
            "doc_id", held.alias("held_out"), F.lit(float(share)).alias("score"), F.lit(int(share >= threshold)).alias("predicted")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s)})

    scored = plain.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
