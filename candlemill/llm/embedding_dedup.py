"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_index, materialize
from .graph import blocks_of_groups, components, map_groups, smallest_reachable

#: Vectors that fit the rotations (a hash-ordered sample); all vectors are indexed.
FIT_ROWS = 20_000
CODE_BITS, ITERATIONS, BLOCK = 128, 50, 512
#: Least share of pairs of exactly the demanded cosine that have a substring in common, whatever its length.
TABLE_RECALL = 0.99
#: Tables at most; where they wouldn't reach the share, substrings get shorter and buckets larger instead.
MOST_TABLES = 64


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    planes: np.ndarray  # dimension x bits

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.planes >= 0


def fit_itq(unit: np.ndarray, seed: int, bits: int = CODE_BITS) -> Quantiser:
    """Rotations of the principal axes under which signs lose least, found by alternating
    signs and the orthogonal Procrustes solution; as many rotations (from different random
    starts) as make ``bits`` bits."""
    rng = np.random.default_rng(seed)
    mean = unit.mean(axis=0)
    centred = unit - mean
    width = min(64, unit.shape[1])
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :width]
    v = centred @ axes
    planes = []
    for _ in range(-(-bits // width)):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ITERATIONS):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        planes.append(axes @ r)
    return Quantiser(mean, np.hstack(planes)[:, :bits] if width * len(planes) > bits else np.hstack(planes))


def planted_agreement(q: Quantiser, unit: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Shares of equal bits of pairs of exactly ``cosine``, two kinds x pairs: each sample vector and one turned from it in
    a random direction, and one turned towards another of the sample. They are measured in the space of the codes, so wherever the vectors lie."""
    rng = np.random.default_rng(seed)
    kinds = []
    for turn in (rng.standard_normal(unit.shape), unit[rng.permutation(len(unit))] + 1e-3 * rng.standard_normal(unit.shape)):
        turn = turn - (turn * unit).sum(axis=1, keepdims=True) * unit
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
        kinds.append((q.codes(unit) == q.codes(cosine * unit + np.sqrt(max(0.0, 1 - cosine * cosine)) * turn)).mean(axis=1))
    return np.stack(kinds)


def recall_of(agreement: np.ndarray, key_bits: int, tables: int) -> float:
    """The share of planted pairs of the worse kind that have one of ``tables`` substrings of ``key_bits`` bits in common."""
    return float((1 - (1 - agreement**key_bits) ** tables).mean(axis=1).min())


def tables_needed(agreement: np.ndarray, key_bits: int, recall: float = TABLE_RECALL, most: int = MOST_TABLES) -> tuple[int, int]:
    """Substring bits, ``key_bits`` or as many less as it takes, and the number of tables (at most ``most``) that reach ``recall``."""
    while key_bits > 1 and recall_of(agreement, key_bits, most) < recall:
        key_bits -= 1
    return key_bits, next((t for t in range(1, most) if recall_of(agreement, key_bits, t) >= recall), most)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    if n:  # components as large as 1e200 or as small as 1e-200 have a length too
        x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(q: Quantiser, key_bits: int):
    tables = max(1, q.bits // key_bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = q.codes(_units(batch.column("embedding")))
            code = bits[:, :CODE_BITS]  # what the radius is measured on; further bits only make tables
            code = np.packbits(np.pad(code, ((0, 0), (0, -code.shape[1] % 64))), axis=1)
            keys = np.stack(
                [
                    bits[:, t * key_bits : (t + 1) * key_bits] @ (1 << np.arange(min(key_bits, bits.shape[1]))) + (t << 40)
                    for t in range(tables)
                ],
                axis=1,
            )
            offsets = np.arange(0, keys.size + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "cid": batch.column("cid"),
                    "code": pa.array([c.tobytes() for c in code], pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().astype(np.int64))),
                }
            )

    return index


def _near_codes(radius: int):
    def near(cell: pa.Table) -> pa.Table | None:
        n = cell.num_rows
        if n < 2:
            return None
        reps = cell.column("cid").to_numpy()
        words = np.frombuffer(b"".join(cell.column("code").to_pylist()), dtype=np.uint64).reshape(n, -1)
        close = np.zeros((n, n), dtype=bool)
        for at in range(0, n, 256):
            part = np.bitwise_count(words[at : at + 256, None, :] ^ words[None, :, :]).sum(axis=2)
            close[at : at + 256] = part <= radius
        least = smallest_reachable(close)
        own = np.flatnonzero(least != np.arange(n))
        return pa.table({"a": reps[own], "b": reps[least[own]]}) if len(own) else None

    return near


def _rerank(cosine: float):
    def rerank(cell: pa.Table) -> pa.Table | None:
        n = cell.num_rows
        if n < 2:
            return None
        order = np.argsort(cell.column("cid").to_numpy(), kind="stable")
        cell = cell.take(pa.array(order))
        reps, block = cell.column("cid").to_numpy(), cell.column("block").to_numpy()
        unit = _units(cell.column("embedding"))
        linked = unit @ unit.T >= cosine
        if cell.column("cell_i")[0].as_py() != cell.column("cell_j")[0].as_py():
            linked &= block[:, None] != block[None, :]  # pairs inside a block have a cell of their own
        np.fill_diagonal(linked, False)
        n_links = linked @ cell.column("copies").to_numpy()
        least = smallest_reachable(linked)
        return pa.table({"cid": reps, "n_links": n_links.astype(np.int64), "least": reps[least]})

    return rerank


def link_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    seed: int = 11,
    fit_rows: int = FIT_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    key_bits: int | None = None,
) -> DataFrame:
    """Links vectors of cosine >= ``cosine`` (double precision) and finds their components.

    1. equal vectors become one class with a count and a key of its own, so different vectors of one id stay apart;
    2. balanced codes of 128 bits or more from rotations fitted on a bounded hash-ordered sample;
    3. multi-index Hamming tables: a code is cut into substrings of about log2(rows) - 3 bits (``key_bits`` sets another
       number); codes that share a substring and whose first 128 bits lie within a Hamming radius are candidates. How many
       tables that takes is measured: pairs of exactly ``cosine`` are planted around the sample, their codes compared, and there are as many
       tables as give such a pair a shared substring with a probability of 0.99. The radius is four and a half standard
       deviations above what they differ by. Where vectors lie in a narrow cone, a pair at the cosine is hardly nearer than any other:
       64 tables may not do, then substrings are shorter and buckets larger, and in the end all is compared, block by block.
       Large buckets are dealt into pairs of blocks, and a task returns spanning links only;
    4. groups of candidates are compared by their original vectors as matrix products, block by block, each two blocks
       that share a substring: link counts and spanning links come out, never all pairs;
    5. connected components.

    Null or zero vectors, and those with null or non-finite components, are linked with
    nothing, as are rows of a null id and vectors of another length than the commonest (of
    equally common lengths the smallest). Repeated rows count as further vectors; components of any finite size
    are fine. Of equal vectors the smallest id stands for all. An empty table
    gives no rows; further columns, whatever their names, are ignored.
    Returns vec_id, n_links, component_id, kept.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    infinite = F.lit(float("inf"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    zero = ~F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(~bad & ~zero, F.lit(False)) & F.col("vec_id").isNotNull()
    raw = raw.withColumn("fp1", F.when(fine, F.xxhash64("embedding")))
    raw = raw.withColumn("fp2", F.when(fine, F.xxhash64(F.lit(1), "embedding")))
    lengths = raw.where("fp1 is not null").groupBy(F.size("embedding").alias("d")).count().collect()
    if not lengths:
        return raw.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    d = min(lengths, key=lambda r: (-r[1], r[0]))[0]
    usable = raw.where(F.col("fp1").isNotNull() & (F.size("embedding") == d))
    classes = materialize(
        usable.groupBy("fp1", "fp2").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding")
        ).withColumn("cid", F.monotonically_increasing_id()),
        "vectors",
    )
    rows = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64(F.lit(seed), "rep"), "fp1", "fp2").limit(fit_rows).toArrow()
    key_bits = key_bits or int(np.clip(round(np.log2(max(rows, 2))) - 3, 6, 24))
    unit = _units(sample.column("embedding"))
    first = fit_itq(unit, seed)
    agreement = planted_agreement(first, unit, cosine, seed)
    key_bits, tables = tables_needed(agreement, key_bits)
    q = fit_itq(unit, seed, max(CODE_BITS, key_bits * tables))
    apart = min(CODE_BITS, first.bits) * (1 - agreement)
    radius = int(np.ceil((apart.mean(axis=1) + 4.5 * apart.std(axis=1)).max() + 1))

    coded = materialize(
        classes.select("cid", "embedding").mapInArrow(_index(q, key_bits), "cid long, code binary, keys array<long>"), "codes"
    )
    entries = coded.select("cid", "code", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    entries = entries.join(sizes, "key")
    blocks = F.expr(f"(members - 1) div {2 * BLOCK} + 1")
    entries = entries.withColumn("place", F.pmod(F.xxhash64("cid"), blocks) * 2 * BLOCK)
    cells = blocks_of_groups(entries, 2 * BLOCK).select("key", "cell_i", "cell_j", "cid", "code")
    candidates = map_groups(cells, ["key", "cell_i", "cell_j"], _near_codes(radius), "a long, b long")

    groups = components(candidates, "a", "b").withColumnRenamed("node", "cid")
    indexed, _ = global_index(groups.select("cid", "component"), [F.col("component"), F.col("cid")], "__row")
    spans = indexed.groupBy("component").agg(F.min("__row").alias("first"), F.count("*").alias("members"))
    placed = indexed.join(spans, "component").select(
        "component", "cid", F.expr(f"(__row - first) div {BLOCK}").alias("block"), (F.col("members") > BLOCK).alias("large")
    )
    placed = materialize(placed, "placed")
    small = placed.where("not large").select("component", "block", F.col("block").alias("cell_i"), F.col("block").alias("cell_j")).distinct()
    meets = coded.select("cid", F.explode("keys").alias("key")).join(placed.where("large"), "cid").select("key", "component", "block").distinct()
    pairs = meets.join(meets.withColumnRenamed("block", "other"), ["key", "component"]).where("block <= other")
    pairs = pairs.select("component", F.col("block").alias("cell_i"), F.col("other").alias("cell_j")).distinct()
    cells = pairs.select("component", F.explode(F.array_distinct(F.array("cell_i", "cell_j"))).alias("block"), "cell_i", "cell_j").union(small)
    dealt = placed.join(cells, ["component", "block"]).join(classes.select("cid", "copies", "embedding"), "cid").select(
        "component", "cell_i", "cell_j", "block", "cid", "copies", "embedding"
    )
    ranked = materialize(
        map_groups(dealt, ["component", "cell_i", "cell_j"], _rerank(cosine), "cid long, n_links long, least long"), "reranked"
    )
    counts = ranked.groupBy("cid").agg(F.sum("n_links").alias("links"))
    found = components(ranked.where("cid <> least"), "cid", "least").withColumnRenamed("node", "cid")

    by_class = classes.select("cid", "fp1", "fp2", "rep", "copies").join(counts, "cid", "left").join(found, "cid", "left")
    by_class = by_class.withColumn("component", F.coalesce("component", "cid"))
    smallest = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(smallest, "component").select(
        "fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = raw.select("vec_id", "fp1", "fp2").join(by_class, ["fp1", "fp2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
