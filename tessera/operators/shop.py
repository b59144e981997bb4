"""What a shop puts around search: personal taste, constraints of an assistant, explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constraints(wanted: dict) -> dict:
    """An assistant's constraints as filters (FLT19)."""
    out: dict = {}
    if wanted.get("inStock"):
        out["available"] = True
    price = {op: wanted[k] for k, op in (("minPrice", "gte"), ("maxPrice", "lte")) if wanted.get(k) is not None}
    if price:
        out["price"] = price
    for name in ("brand", "category", "size"):
        if wanted.get(name) is not None:
            out[name] = wanted[name]
    return out


def taste(brand: Column, price: Column, colours: Column, size: Column, style: Column, viewed: Column, *, blocked: list[str] = (), preferred: list[str] = (), band: tuple[float, float] | None = None, sizes: list[str] = (), avoided: list[str] = (), affinity: dict[str, float] | None = None) -> Column:
    """A sum of likes and dislikes (MD10): brands blocked -2 or preferred +1, seen -0.35, price in the band +0.3 or not
    -0.3, size +0.5, an avoided style -1, the best-liked colour; what is unknown adds nothing."""
    yes = lambda c, x, no=0.0: F.when(c, x).otherwise(no)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = yes(low(brand).isin([b.lower() for b in blocked]), -2.0) + yes(low(brand).isin([b.lower() for b in preferred]), 1.0) + yes(F.coalesce(viewed, F.lit(False)), -0.35)
    if band:
        out = out + F.when(price.isNull(), 0.0).when(price.between(*band), 0.3).otherwise(-0.3)
    out = out + yes(low(size).isin([s.lower() for s in sizes]), 0.5) + yes(low(style).isin([s.lower() for s in avoided]), -1.0)
    if affinity:
        liked = F.create_map(*[x for k, v in affinity.items() for x in (F.lit(k.lower()), F.lit(float(v)))])
        best = F.array_max(F.transform(F.coalesce(colours, F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at(liked, F.lower(c)), F.lit(0.0))))
        out = out + F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0))
    return out


def decisive(rows: DataFrame, channels: dict[str, Column], combine: Callable[..., Column], weights: dict[str, float]) -> DataFrame:
    """Rows with ``combined`` and ``decisive``: the channel without which the score falls most, ties by name (MD13)."""
    whole = combine(*[(weights[k], c) for k, c in channels.items()])
    falls = [F.struct((whole - combine(*[(weights[k], F.lit(0.0) if k == left else c) for k, c in channels.items()])).alias("fall"), F.lit(left).alias("channel")) for left in sorted(channels, reverse=True)]
    top = F.array_max(F.transform(F.array(*falls), lambda x: F.struct(x["fall"], x["channel"])))
    return rows.withColumn("combined", whole).withColumn("decisive", F.when(top["fall"] > 0, top["channel"]))


def summary(parts: dict[str, Column], longest: int = 240) -> Column:
    """``name: value | name: value`` without empty parts (SC36)."""
    return F.concat_ws(" | ", *[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{k}: "), F.left(c.cast("string"), F.lit(longest)))) for k, c in parts.items()])


def fresh(at: Column, now: Column, hours: int = 24) -> Column:
    """Whether something was updated within so many hours; unknown dates aren't (PRJ13)."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) <= hours * 3600, F.lit(False))
