"""Facets: counts of values, ranges and percentiles over filtered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a facet reports.
TOP = 25
#: Buckets of a range facet.
BUCKETS = 6


def terms(rows: DataFrame, value: Column, top: int = TOP) -> DataFrame:
    """``value, n``: the most frequent values, nulls left out, ties by value (AG1)."""
    counted = rows.select(value.cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("value")).limit(top)


def flags(rows: DataFrame, value: Column) -> DataFrame:
    """Counts of ``true`` and ``false`` (AG2)."""
    return terms(rows, F.when(value, "true").when(~value, "false"))


def elements(rows: DataFrame, values: Column, top: int = TOP) -> DataFrame:
    """Counts of an array's elements; one that an array holds twice counts twice (AG3)."""
    return terms(rows.select(F.explode(values).alias("element")), F.col("element"), top)


def ranges(rows: DataFrame, value: Column, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, lo, hi, n, least, most, mean``: equal-width buckets from least to most, empty ones too (AG4).

    One bucket where all values are equal, none where there is no value. Two passes over the column, and no row
    leaves its task: what is shuffled are partial counts.
    """
    x = rows.select(value.cast("double").alias("x")).where("x is not null")
    whole = x.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.count("x").alias("all"))
    width = (F.col("most") - F.col("least")) / buckets
    at = F.when(F.col("most") == F.col("least"), 0).otherwise(F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.col("x") - F.col("least"), width))))).cast("int")
    counted = x.crossJoin(F.broadcast(whole)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    frame = whole.where("all > 0").select("*", F.explode(F.when(F.col("most") == F.col("least"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))).alias("bucket"))
    lo = F.col("least") + width * F.col("bucket")
    hi = F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(F.col("least") + width * (F.col("bucket") + 1))
    return frame.join(counted, "bucket", "left").select("bucket", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "least", "most", "mean")


def budget(rows: DataFrame, price: Column, by: Column | None = None, cheap: float = 0.30, premium: float = 0.75) -> DataFrame:
    """Continuous percentiles that stand for "cheap" and "premium", of all rows or by category (AG6)."""
    grouped = rows.select(price.cast("double").alias("price"), (by if by is not None else F.lit("all")).alias("category")).where("price is not null").groupBy("category")
    return grouped.agg(F.percentile("price", F.lit(cheap)).alias("cheap"), F.percentile("price", F.lit(premium)).alias("premium"))


def probe(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows each condition alone would keep, in one pass (AG8)."""
    counts = rows.agg(*[F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias(k) for k, c in conditions.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in conditions])).alias("x")).select("x.*")


def census(rows: DataFrame, *fields: str) -> DataFrame:
    """``field, value, n`` of every value of every field (AG14)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
