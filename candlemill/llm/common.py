"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only for a single-JVM local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="candlemill-")
    return _LOCAL[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are within ``limit``; else the plain frame."""
    return F.broadcast(df) if rows <= limit else df


def global_index(df: DataFrame, order: list[Column], index: str) -> tuple[DataFrame, int]:
    """Adds gapless row numbers in ``order`` without one global sort task; returns the row count too.

    Rows are range-partitioned and sorted; a row's number inside its partition is the low
    part of monotonically_increasing_id, the partition its high part. Only one count per
    partition meets in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "index")
    stored = stored.withColumn("__part", F.shiftright("__at", 33))
    counts = sorted(stored.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not starts:
        return stored.withColumn(index, F.col("__at")).drop("__at", "__part"), 0
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = stored.join(F.broadcast(offsets), "__part").withColumn(index, F.col("__start") + low)
    return out.drop("__at", "__part", "__start"), total


# ---------------------------------------------------------------- words

_SPLIT_KEEP_ALNUM = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else (b + 32 if 0x41 <= b <= 0x5A else 0x20)
    for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (0x20, 0x09-0x0D)."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of digits, a-z and everything beyond ASCII."""
    return text.encode().translate(_SPLIT_KEEP_ALNUM).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same everywhere."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = np.arange(256)
_INSIDE = {
    "alnum": (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)),
    "space": (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13)),
    "cased": (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13)),
    "pieces": (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13)) & ~np.isin(_BYTES, list(b".,;:!?")),
}
#: A random number for each byte, A-Z as a-z (but for "cased"), nothing for what separates words.
_VALUES = {
    split: np.where(
        inside,
        mix64(np.arange(1, 257, dtype=np.uint64))[np.where((_BYTES >= 65) & (_BYTES <= 90) & (split != "cased"), _BYTES + 32, _BYTES)],
        np.uint64(0),
    )
    for split, inside in _INSIDE.items()
}
_BASE = 0xD1342543DE82EF95
_STRETCH = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, up to ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, _STRETCH // 4), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text's bytes start; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, (_, where, raw) = len(texts), texts.buffers()
    ends = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
    return data, ends - ends[0]


def word_spans(data: np.ndarray, ends: np.ndarray, split: str) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bytes that start a word and of those inside one."""
    inside = _INSIDE[split][data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = ends[:-1][ends[:-1] < len(data)]
    first[bounds] = inside[bounds]
    return first, inside


def hashed_words(texts: pa.Array, split: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and the place where each text's words start.

    ``split`` is "alnum" (as ``alnum_words``), "space" (as ``space_words``), "cased" (the same with A-Z kept) or
    "pieces" (as "space", cut at ``.,;:!?`` too). The places have one entry more than
    there are texts. Works on the bytes of the whole column at once: a word's hash is a
    polynomial of its bytes modulo 2^64, cut out of one running product over all bytes. A null text has no words.
    """
    data, ends = bytes_of(texts)
    starts = np.flatnonzero(word_spans(data, ends, split)[0])
    return hashes_at(data, starts, split), np.searchsorted(starts, ends)


def hashes_at(data: np.ndarray, starts: np.ndarray, split: str) -> np.ndarray:
    """Hashes of the words that start at ``starts``."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _STRETCH)))
        low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
        up, down = _powers(high - low)
        at = starts[a:b] - low
        out[a:b] = np.add.reduceat(_VALUES[split][data[low:high]] * up[: high - low], at) * down[at]
        a = b
    return mix64(out)


def slices_of(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; a longer text is a part with few others."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for s, e in zip(cuts, cuts[1:]):
        if e > s:
            yield batch.slice(s, e - s)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def logistic_fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60
) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last coefficient is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(a)) if weight is None else weight
    beta, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], l2 * max(1.0, w.sum()))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        grad = a.T @ (w * (p - y)) + ridge * beta
        h = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def global_prefix(df: DataFrame, order: list[Column], weight: str, start: str) -> tuple[DataFrame, int]:
    """Adds ``start``, the sum of ``weight`` over all rows before a row in ``order``; returns the whole sum too.

    Range partitions are summed up one row after the other, each within its task; only one
    sum per partition meets in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(batch.schema.get_field_index(weight)).to_numpy()
            ends = before + np.cumsum(w)
            before = int(ends[-1]) if len(ends) else before
            extra = [pa.array(np.full(len(w), part, dtype=np.int64)), pa.array((ends - w).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__part", "__before"])

    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__before", T.LongType())])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.mapInArrow(run, schema), "prefix")
    sums = sorted(stored.groupBy("__part").agg(F.sum(weight)).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    found = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    out = stored.join(F.broadcast(found), "__part").withColumn(start, F.col("__offset") + F.col("__before"))
    return out.drop("__part", "__before", "__offset"), total
