"""Near-duplicate documents: MinHash banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_index, hashed_words, materialize, rolling, slices_of
from .graph import components, map_groups, smallest_reachable

#: 32 bands of 5 minima: at a similarity of 0.8 a pair meets in no band with probability 3e-6.
BANDS, ROWS = 32, 5
BLOCK = 256
#: A class of more rows than this, and than a 100,000th of all, is broadcast to its rows.
MANY, MANY_CLASSES = 10_000, 100_000


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; the whole sequence if it is shorter."""
    hashes, starts = hashed_words(texts, "space")
    grams = rolling(hashes, k)
    for s, e in zip(starts.tolist(), starts[1:].tolist()):
        if e - s >= k:
            yield np.unique(grams[s : e - k + 1])
        else:
            yield rolling(hashes[s:e], e - s) if e > s else np.empty(0, dtype=np.uint64)


def _universal(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    a = rng.integers(0, top, BANDS * ROWS, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, top, BANDS * ROWS, dtype=np.uint64, endpoint=True)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the hashes a * x + b (mod 2^64) over the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512, None] * a + b).min(axis=0), out=low)
    return low


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on every shingle of a set."""
    return (
        int((s * np.uint64(0xD6E8FEB86659FD93)).sum().astype(np.int64)),
        int(np.bitwise_xor.reduce(s * s * np.uint64(0xA0761D6478BD642F) + s).astype(np.int64)),
    )


def _sign(k: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(seed)
        weights = rolling(np.arange(1, BANDS + ROWS, dtype=np.uint64), ROWS)  # tells the bands apart
        odd = np.arange(1, 2 * ROWS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in (part for whole in batches for part in slices_of(whole)):
            n, fp1, fp2, keys = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                if not len(s):
                    fp1.append(None)
                    fp2.append(None)
                    keys.append(None)
                    continue
                sig = signature(s, a, b)
                one, two = fingerprint(s)
                fp1.append(one)
                fp2.append(two)
                x = (sig.reshape(BANDS, ROWS) * odd).sum(axis=1) ^ weights
                keys.append((x ^ (x >> np.uint64(31))).astype(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "fp1": pa.array(fp1, pa.int64()),
                    "fp2": pa.array(fp2, pa.int64()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    return sign


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            found = list(shingle_sets(batch.column("text"), k))
            prints = [fingerprint(s) if len(s) else (None, None) for s in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": batch.column("doc_id"), "fp1": pa.array([x for x, _ in prints], pa.int64()),
                    "fp2": pa.array([y for _, y in prints], pa.int64()), "shingles": pa.array([s.tobytes() for s in found], pa.binary()),
                }
            )

    return sets


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the ``columns`` of their class, by ``keys``. Classes of very many ``copies``, of which there are few, are broadcast, so
    that their rows stay spread over all tasks."""
    most = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(MANY, most // MANY_CLASSES)
    few = classes.where(hot).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in columns])
    rows = rows.join(F.broadcast(few), keys, "left")
    salt = F.when(F.col(f"__hot_{columns[0]}").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    rest = classes.where(~hot).select(*keys, F.shiftright("copies", 62).alias("__salt"), *columns)  # always 0
    joined = rows.withColumn("__salt", salt).join(rest, [*keys, "__salt"], "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"__hot_{c}", c))
    return joined.drop("__salt", *[f"__hot_{c}" for c in columns])


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Symmetric matrix of 100 * intersection >= percent * union, counted on the full sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one member adds to no intersection
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for at, (s, e) in enumerate(zip(cuts, cuts[1:])):
            part = np.zeros((len(sets), width), dtype=np.float32)
            part[owner[s:e], column[s:e] - at * width] = 1
            common += part @ part.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _verify(percent: int):
    def verify(cell: pa.Table) -> pa.Table | None:
        reps = np.asarray(cell.column("cid").to_numpy())
        reps, keep = np.unique(reps, return_index=True)
        if len(reps) < 2:
            return None
        raw = cell.column("shingles")
        linked = exact_links([np.frombuffer(raw[int(i)].as_py(), dtype=np.uint64) for i in keep], percent)
        np.fill_diagonal(linked, False)
        least = smallest_reachable(linked)
        own = np.flatnonzero(least != np.arange(len(reps)))
        return pa.table({"a": reps[own], "b": reps[least[own]]})

    return verify


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, seed: int = 7) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their sets of k-word shingles.

    Words are runs of other than ASCII white space after A-Z are lower-cased. Documents are
    linked if 100 * intersection >= percent * union. Steps:

    1. signatures and band keys of all texts, written once; documents of equal sets are one
       class with a key of its own from here on, whatever their number;
    2. classes that share a band key make candidate groups (connected components);
    3. candidate groups are dealt into blocks of at most 256 classes, and each pair of blocks
       that share a band key is compared by its full sets, as a matrix product inside a
       task; tasks give back one link per class at most, never all pairs;
    4. connected components of these links and of links between the classes of one doc_id, whose rows count as one document.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id =
    component_id), one row per input row. Null or empty texts and texts without words have
    no shingles and are linked with nothing; a null doc_id
    is linked with nothing; an empty table gives no rows; further columns, whatever their names, are ignored.
    Texts of any length are compared whole.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(
        light.mapInArrow(_sign(k, seed), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>"), "signed"
    )
    usable = signed.where("fp1 is not null and doc_id is not null")
    classes = usable.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    prints = ["n_shingles", "fp1", "fp2"]
    firsts = usable.join(classes.select(*prints, F.col("rep").alias("doc_id"), "cid"), [*prints, "doc_id"])
    rows = firsts.select("cid", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub < top")
    shared = materialize(rows.join(hubs.select("key", "hub"), "key"), "shared")

    groups = components(shared.select("cid", "hub").distinct(), "cid", "hub").withColumnRenamed("node", "cid")
    indexed, _ = global_index(groups.select("cid", "component"), [F.col("component"), F.col("cid")], "__row")
    spans = indexed.groupBy("component").agg(F.min("__row").alias("first"), F.count("*").alias("members"))
    placed = indexed.join(spans, "component").select(
        "component", "cid", F.expr(f"(__row - first) div {BLOCK}").alias("block"), (F.col("members") > BLOCK).alias("large")
    )
    placed = materialize(placed, "placed")

    small = placed.where("not large").select("component", "block", F.col("block").alias("i"), F.col("block").alias("j")).distinct()
    meets = shared.join(placed.where("large"), "cid").select("key", "component", "block").distinct()
    pairs = meets.join(meets.withColumnRenamed("block", "other"), ["key", "component"]).where("block <= other")
    pairs = pairs.select("component", F.col("block").alias("i"), F.col("other").alias("j")).distinct()
    cells = pairs.select("component", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j").union(small)

    named = placed.join(classes.select("cid", "rep", "fp1", "fp2"), "cid")
    texts = light.join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(k), "rep long, fp1 long, fp2 long, shingles binary")
    dealt = sets.join(named, ["rep", "fp1", "fp2"]).join(cells, ["component", "block"]).select("component", "i", "j", "cid", "shingles")
    links = map_groups(dealt, ["component", "i", "j"], _verify(percent), "a long, b long")

    own = signed.select("doc_id", *prints)
    coded = materialize(with_class(own.where("fp1 is not null and doc_id is not null"), classes, prints, ["cid"]).select("doc_id", "n_shingles", "cid"), "coded")
    several = coded.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).where("b < top").select("doc_id", "b")
    same = coded.join(several, "doc_id").where("cid <> b").select(F.col("cid").alias("a"), "b")
    found = components(links.union(same), "a", "b").withColumnRenamed("node", "cid")

    ends = classes.select("cid", "rep", "copies").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = ends.groupBy("component").agg(F.min("rep").alias("component_id"))
    ends = ends.join(smallest, "component").select("cid", "copies", "component_id")
    joined = with_class(coded, ends, ["cid"], ["component_id"]).select("doc_id", "n_shingles", "component_id")
    alone = own.where("fp1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
