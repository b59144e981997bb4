"""Queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.bpe import encode_and_check
from tessera.llm.language import fit, identify
from tessera.llm.leaks import leaks
from tessera.llm.licenses import licenses
from tessera.llm.minhash import near_groups
from tessera.llm.repetition import repetition
from tessera.llm.site import main_text
from tessera.llm.sql import ORACLE_SQL  # noqa: F401
from tessera.llm.suffixes import repeated_passages
from tessera.llm.urls import url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op2_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(_table(spark, folder, "documents"))


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_table(spark, folder, "documents"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(_table(spark, folder, "pages"))


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter(_table(spark, folder, "pages"), _table(spark, folder, "labels"))


def op5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses(_table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return identify(docs, fit(docs))


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    spans = repeated_passages(_table(spark, folder, "documents"))
    return spans.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.start", "span.end")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_check(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_repetition, op3_main_text, op4_urls, op5_leaks, op6_licenses, op7_pii, op8_language, op9_repeated_passages, op10_bpe)}
