"""Language identification with a blended-spectrum string kernel and Nystrom landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bounded, documented samples of labelled rows: landmarks and ridge training rows.
LANDMARKS, TRAIN_ROWS = 160, 12_000
LANDMARK_CHARS = (100, 4_000)
#: Where the languages are so many that four each make more landmarks than this, the landmarks are those of the lowest hash.
MOST_LANDMARKS = 1_000
UNKNOWN = "und"


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters replaced by one space each."""
    return np.frombuffer("".join(c if c.isalpha() else " " for c in text.lower()).encode("utf-32-le"), dtype=np.uint32)


class Alphabet:
    """Letters of the landmarks as small numbers; 0 is any other letter, 1 the space."""

    def __init__(self, letters: list[int]):
        self.letters = np.array(sorted(set(letters) - {32}), dtype=np.uint32)
        self.size = len(self.letters) + 2
        top = int(self.letters[-1]) + 1 if len(self.letters) else 33
        # one table lookup a character; white space, digits and punctuation are the space
        self.table = np.zeros(max(top, 128), dtype=np.int64)
        self.table[self.letters] = np.arange(2, self.size)
        for c in range(128):
            if not chr(c).isalpha():
                self.table[c] = 1
        self._other: dict[int, int] = {}

    def numbers(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        inside = raw < len(self.table)
        out = np.where(inside, self.table[np.where(inside, raw, 0)], 0)
        rest = np.unique(raw[(out == 0)])
        spaces = [c for c in rest.tolist() if not self._letter(c)]
        if spaces:
            out[np.isin(raw, spaces)] = 1
        return out

    def _letter(self, c: int) -> int:
        if c not in self._other:
            if len(self._other) > 100_000:
                self._other.clear()
            self._other[c] = chr(c).isalpha()
        return self._other[c]

    def spectrum(self, text: str) -> np.ndarray:
        """Distinct 1-, 2- and 3-grams as sorted numbers (the blended presence spectrum)."""
        x = self.numbers(text)
        a = self.size
        grams = [x, a + x[:-1] * a + x[1:], a + a * a + (x[:-2] * a + x[1:-1]) * a + x[2:]]
        if len(x) > 20_000 and a < 200:
            seen = np.zeros(a + a * a + a**3, dtype=bool)
            for g in grams:
                seen[g] = True
            return np.flatnonzero(seen)
        return np.unique(np.concatenate(grams))


@dataclass
class KernelModel:
    alphabet: Alphabet
    grams: np.ndarray  # sorted n-gram numbers of all landmarks
    presence: np.ndarray  # n-grams x landmarks
    norms: np.ndarray
    root: np.ndarray  # K_LL ** -1/2
    classes: list[str]
    weights: np.ndarray | None = None

    def kernel(self, texts: list[str]) -> np.ndarray:
        """K(text, landmark) = common n-grams / sqrt(product of their numbers)."""
        out = np.zeros((len(texts), len(self.norms)))
        for i, text in enumerate(texts):
            s = self.alphabet.spectrum(text)
            if not len(s):
                continue
            at = np.searchsorted(self.grams, s)
            at[at == len(self.grams)] = 0
            hit = at[self.grams[at] == s]
            out[i] = self.presence[hit].sum(axis=0, dtype=np.float32) / (np.sqrt(len(s)) * self.norms)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        phi = self.kernel(texts) @ self.root
        return np.hstack([phi, np.ones((len(phi), 1))])

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best class and its share of a soft maximum over the one-versus-rest outputs."""
        margins = self.features(texts) @ self.weights * 6.0
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def landmarks_model(texts: list[str], classes: list[str]) -> KernelModel:
    alphabet = Alphabet([int(c) for t in texts for c in set(letters_only(t).tolist())])
    spectra = [alphabet.spectrum(t) for t in texts]
    grams = np.unique(np.concatenate(spectra))
    presence = np.zeros((len(grams), len(texts)), dtype=np.float32)
    for j, s in enumerate(spectra):
        presence[np.searchsorted(grams, s), j] = 1
    norms = np.sqrt([len(s) for s in spectra])
    k = presence.T @ presence / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(k.astype(np.float64))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    return KernelModel(alphabet, grams, presence, norms, root, classes)


def _normal_equations(model: KernelModel):
    """Per task: the sums of phi phi' and phi y', as one row of fixed size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c = model.root.shape[1] + 1, len(model.classes)
        gram, right = np.zeros((d, d)), np.zeros((d, c))
        place = {k: i for i, k in enumerate(model.classes)}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at in range(0, len(texts), 256):
                phi = model.features(texts[at : at + 256])
                y = np.full((len(phi), c), -1.0)
                y[np.arange(len(phi)), [place[lang] for lang in langs[at : at + 256]]] = 1
                gram += phi.T @ phi
                right += phi.T @ y
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.hstack([gram, right]).tobytes()], pa.binary())})

    return sums


def fit(docs: DataFrame, landmarks: int, train_rows: int, ridge: float = 1e-2) -> KernelModel | None:
    """Learns from labelled rows (text, lang): a bounded hash-ordered sample of the training part."""
    ids = docs.select("key", "lang", "length")
    sample = ids.orderBy(F.xxhash64(F.lit(3), "key"), "key").limit(train_rows).select("key", "lang")
    classes = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not classes:
        return None
    per_class = max(4, landmarks // len(classes))
    low, high = LANDMARK_CHARS
    misfit = F.when(F.col("length").between(low, high), 0).otherwise(F.abs(F.col("length") - F.lit(low)))
    first = Window.partitionBy("lang").orderBy(misfit, F.xxhash64("key"), "key")  # a grouped top-k, cut before the shuffle
    learned = docs.sparkSession.createDataFrame([(c,) for c in classes], "lang string")
    chosen = ids.join(F.broadcast(learned), "lang", "left_semi").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_class)
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(min(per_class * len(classes), max(landmarks, MOST_LANDMARKS))).select("key")
    rows = docs.join(F.broadcast(chosen), "key", "left_semi").select("text", "lang", "key")
    rows = rows.orderBy("lang", "key").limit(max(landmarks, MOST_LANDMARKS)).collect()
    texts = list(dict.fromkeys(r["text"] for r in rows))
    model = landmarks_model(texts, classes)
    train = docs.join(F.broadcast(sample), ["key", "lang"], "left_semi").select("text", "lang")
    d = model.root.shape[1] + 1
    total = np.zeros((d, d + len(classes)))
    for r in train.mapInArrow(_normal_equations(model), "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"]).reshape(total.shape)
    gram, right = total[:, :d], total[:, d:]
    model.weights = np.linalg.solve(gram + ridge * np.trace(gram) / d * np.eye(d) * 1e-2, right)
    return model


def identify(docs: DataFrame, landmarks: int = LANDMARKS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Predicts the language of every whole text from texts and languages of the training part.

    The training part are rows of non-null lang whose crc32(doc_id as text) mod 4 is not 2.
    Ridge rows are at most ``train_rows`` of it in hash order, the learned languages those among them, however many; landmarks
    are at most ``landmarks`` of its texts (4 a language at least, up to 1,000); language, source and doc_id aren't inputs of a prediction.
    A text without letters, empty or null, is "und" with score 0; without training rows
    every text is. Ties go to the alphabetically first language; equal texts get equal results;
    an empty table gives no rows; further columns are ignored.
    Returns doc_id, held_out, lang_pred, score.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out")
    )
    usable = plain.where("lang is not null and not held_out and text rlike '\\\\p{L}'")
    usable = usable.withColumn("key", F.xxhash64("doc_id")).withColumn("length", F.length("text"))
    model = fit(usable, landmarks, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            own = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if m else []
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                best, p = m.predict([texts[i] for i in part])
                for i, b, x in zip(part, best, p):
                    names[i], scores[i] = m.classes[b], float(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    return plain.select("doc_id", "held_out", "text").mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )
