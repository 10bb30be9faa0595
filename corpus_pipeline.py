"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

1. quality: documents whose site-aware quality score is below one half go;
2. near_dedup: of each group of near copies (5-word shingles, Jaccard 0.8) one document stays;
3. decontamination: documents that hold a benchmark item go;
4. secrets: every secret in a text becomes a mark, the documents stay;
5. packing: the token ids of what is left, in full sequences.

Every stage takes null and empty texts, texts of any length, null ids, repeated rows, ties and empty tables as its operator says, works on
the whole of what it is given and, but for the last, returns its columns unchanged in name and type. Columns it doesn't know
come through; names beginning with two underscores are kept for the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import decontam, minhash_dedup, packing, quality, secrets
from candlemill.llm.common import shared_folder, table
from candlemill.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents below the threshold, so null, empty and blank texts go; the others stay as they are. Labels of ids that aren't there don't matter."""
    labels = table(spark, sf_dir, "labels")
    judged = quality.judge(docs, labels, docs.columns, host=F.col("source"), path=F.col("lang"), prefix="__quality_")
    return judged.where("__quality_kept").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays, and texts without words; repeated rows (one doc_id, one text) become one; rows of a null doc_id stay."""
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    once = own.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return once.union(docs.where("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a leak. An empty benchmark drops none; null and empty texts stay."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), column="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; spans become a mark, and n_chars, if there is one, follows the text (null for a null text)."""
    clean = secrets.redact(secrets.scan_secrets(docs, keep=docs.columns, out="__spans"), spans="__spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; a null text is a document of one id. Sources are mixed as in the query of the packing operator."""
    return packing.digest(packing.pack(docs, tokenizer_path(), temperature=0.7), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_copy),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned scores, latent spaces and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; every stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
