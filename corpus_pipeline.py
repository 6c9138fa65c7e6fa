"""The corpus pipeline: documents are judged, thinned, cleaned, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; it is written as Parquet and
read back before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, packing, quality_classifier, secret_scans, simhash
from tidemark.llm.arrow import fresh, prepare, table
from tidemark.llm.scratch import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    score = fresh(docs, "_score")
    scored = quality_classifier.score_documents(docs, quality_classifier.production_model(spark, docs, sf_dir), "text", score)
    return scored.where(F.col(score) >= quality_classifier.KEEP_FROM).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_one(docs, Scratch(spark))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    prepare(spark)
    clean = docs.withColumn("text", secret_scans.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that tokens meet the target shares of sources, languages and topics."""
    return mixing.mixed(docs, mixing.TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its place in a sequence."""
    return packing.pack_documents(docs, Scratch(spark))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_distinct),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            done = scratch.cut(done)
            scratch.drop(docs)
        docs = done
    return docs
