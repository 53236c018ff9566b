"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.llm import decontaminate, pattern_packing, quality_model, secret_scan, simhash
from insight_spark.llm.common import crc_bucket, free_name, kept_table
from insight_spark.session import load_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.3; labels of every fifth id stay unseen."""
    model = quality_model.train(docs, load_table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return quality_model.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, fingerprints at most three bits apart."""
    return simhash.keep_one(docs, words=3, bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    flag = free_name(docs, "cut")
    cut = secret_scan.redact(docs, flag=flag)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(flag), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it stands in which sequence, and the checksum of its ids."""
    return pattern_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
# Hashes of the fingerprints, a learned model and token ids are beyond SQL; tests/llm holds the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = load_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
