"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_index, mix64

ROUNDS = 6


def feistel(rows: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A permutation of 0..total-1: a balanced Feistel network on the next even number of
    bits, walked on along its cycle until the value is below ``total``."""
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed & (2**63 - 1)) * np.uint64(ROUNDS + 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix64(right ^ key) & mask)
        return (left << half) | right

    out = once(rows.astype(np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def shard_rows(
    docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deals all rows into ``shards`` shards whose row counts differ by one at most.

    Row r of the global order (id, text checksum, size) goes to place p = permutation(r);
    its shard is p mod shards and its slot p div shards, so any reader can compute where a
    row lies, and slots of a shard are gapless from 0.

    A null text counts as empty, a null id sorts first, equal rows get different places, an
    empty table gives an empty result; further columns are ignored.
    Returns id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    indexed, total = global_index(light, order, "__row")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), total, seed))

    return indexed.withColumn("__place", place("__row")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__place div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
