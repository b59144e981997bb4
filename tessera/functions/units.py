"""Units of quantity and size: aliases, families and factors as a table and as Column lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each canonical unit its family, and aliases by factor (SC5).
_TABLE = {
    ("pcs", "count"): {1.0: "pcs pc piece pieces pccs pisces nos no item unit units", 12.0: "dozen doz", 2.0: "pair pairs", 144.0: "gross"},
    ("g", "mass"): {1.0: "g gm gram grams", 1000.0: "kg kilo kilogram", 0.001: "mg"},
    ("ml", "volume"): {1.0: "ml cc", 1000.0: "l ltr litre liter"},
    ("mm", "length"): {1.0: "mm", 10.0: "cm", 1000.0: "m", 25.4: "inch"},
    ("bottle", "count"): {1.0: "bottle"},
    ("packet", "count"): {1.0: "packet pack"},
    ("box", "count"): {1.0: "box"},
    ("bag", "count"): {1.0: "bag"},
}
UNITS = {alias: (canonical, family, factor) for (canonical, family), by in _TABLE.items() for factor, names in by.items() for alias in names.split()}
#: How far two sizes may be apart to be the same.
NEAR = 0.5


def unit_table(spark: SparkSession) -> DataFrame:
    """``alias, canonical, family, factor`` of every known unit."""
    return spark.createDataFrame([(a, *rest) for a, rest in UNITS.items()], "alias string, canonical string, family string, factor double")


def _lookup(unit: Column, at: int) -> Column:
    known = F.create_map(*[F.lit(x) for a, rest in UNITS.items() for x in (a, rest[at])])
    return F.try_element_at(known, F.lower(F.trim(F.coalesce(unit, F.lit("")))))


def canonical_unit(unit: Column) -> Column:
    return _lookup(unit, 0)


def family(unit: Column) -> Column:
    return _lookup(unit, 1)


def factor(unit: Column) -> Column:
    return _lookup(unit, 2)


def same_size(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """Whether two sizes agree (JN9): either is unknown, both are of one family and near in its base unit, or the bare
    numbers are near. Lookups of literals, so that the gate is part of a join's condition and needs no join of its own."""
    based = (family(unit) == family(other_unit)) & (F.abs(value * factor(unit) - other * factor(other_unit)) < NEAR)
    return value.isNull() | other.isNull() | F.coalesce(based, F.lit(False)) | F.coalesce(F.abs(value - other) < NEAR, F.lit(False))


def parsed_name(c: Column) -> Column:
    """What a product's name says by its form: ``item, size_value, size_unit, code`` (PRJ15); a parser of one's own may
    take its place (UD3). A size is a number before a known unit, a code has letters and digits and a dash."""
    names = "|".join(sorted((a for a in UNITS if a not in ("no", "m", "g", "l")), key=len, reverse=True)) + "|[mgl]"
    size = rf"(?i)(\d+(?:\.\d+)?)\s*({names})(?![\p{{L}}\p{{N}}])"
    code = r"\b([A-Z]+\d*-[A-Z0-9-]*\d[A-Z0-9-]*)\b"
    got = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    item = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, size, " "), code, " "), r"\s+", " "))
    return F.struct(F.lower(item).alias("item"), got(size, 1).cast("double").alias("size_value"), F.lower(got(size, 2)).alias("size_unit"), got(code, 1).alias("code"))
