"""The dealt operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, embedding_dedup, langid, licenses, lm_scoring, minhash_dedup, oracles, packing, periodic_runs, quality, secrets, sharding, toxicity
from .common import table


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


#: The vocabulary file; queries take the installed public one.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target proportions: each source's tokens to the power 0.7, so small sources come sooner and run dry one after the other."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), temperature=0.7))


def op9_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; the source stands for the host, its languages for paths."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs, labels, ["doc_id"], host=F.col("source"), path=F.col("lang"))
    return judged.select("doc_id", *[F.col(c).alias(c.removeprefix("quality_")) for c in judged.columns[1:]])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after repeats are planted in every tenth."""
    docs = periodic_runs.plant_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.find_runs(docs, ["doc_id"]))


def op12_recurrent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its score by real sites: the host and the first directory of its address; learned from ``documents``."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", page_text(F.col("html")).alias("text"))
    directory = F.regexp_extract(F.try_parse_url("url", F.lit("PATH")), "^/([^/]*)", 1)
    judged = quality.judge(
        pages, table(spark, sf_dir, "labels"), ["doc_id"], F.lower(F.try_parse_url("url", F.lit("HOST"))), directory,
        train=table(spark, sf_dir, "documents"),
    )
    return judged.select(F.col("doc_id").alias("page_id"), *[F.col(c).alias(c.removeprefix("quality_")) for c in judged.columns[1:]])


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags."""
    hidden = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(hidden, "<[^>]*>", "\n"), "\\s*\\n\\s*", "\n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_feistel_sharding, op2_itq_near_dedup, op3_secret_scan, op4_latent_decontamination, op5_weak_toxicity, op6_license_diagonals, op7_minhash_near_dedup, op8_mixture_packing, op9_kernel_language_id, op10_site_quality, op11_periodic_runs, op12_recurrent_scoring, op13_phrase_collocations, page_quality)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
