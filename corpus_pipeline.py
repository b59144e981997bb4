"""A training corpus from raw documents: stages that each take what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.bpe import encode
from tessera.llm.leaks import drop_leaks
from tessera.llm.minhash import keep_one
from tessera.llm.repetition import keep_clean
from tessera.llm.shared import Written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the repetition rules reject go."""
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of copies and near copies stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data are replaced by their kind; ``n_chars`` follows the text."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the ids of each document, with their number."""
    return encode(docs).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("personal data", personal_data), ("byte-pair encoding", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = Written(out)
            docs = out.df
            if before:
                before.drop()
            before = out
    return out
