"""Quotations: list prices, markups, quantity breaks, rules, totals; formulas compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical, half_up


def formula(text: str, most: int = 500, depth: int = 100) -> Column:
    """A Column from ``+ - * / ( )``, numbers and names; anything else is an error (SC26)."""
    if len(text) > most:
        raise ValueError("formula is too long")
    tokens = re.findall(r"\s*(\d+\.?\d*|\.\d+|[A-Za-z_]\w*|[-+*/()]|\S)", text)
    at = 0

    def take(*options: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at] in options:
            at += 1
            return tokens[at - 1]
        return None

    def atom(level: int) -> Column:
        nonlocal at
        if level > depth:
            raise ValueError("formula is too deep")
        if take("("):
            inner = total(level + 1)
            if not take(")"):
                raise ValueError("formula lacks )")
            return inner
        if take("-"):
            return -atom(level + 1)
        if at >= len(tokens) or not re.fullmatch(r"\d+\.?\d*|\.\d+|[A-Za-z_]\w*", tokens[at]):
            raise ValueError(f"formula breaks at {tokens[at] if at < len(tokens) else 'its end'}")
        at += 1
        return F.lit(float(tokens[at - 1])) if tokens[at - 1][0] in ".0123456789" else F.col(tokens[at - 1]).cast("double")

    def product(level: int) -> Column:
        out = atom(level)
        while sign := take("*", "/"):
            out = out * atom(level) if sign == "*" else F.try_divide(out, atom(level))
        return out

    def total(level: int) -> Column:
        out = product(level)
        while sign := take("+", "-"):
            out = out + product(level) if sign == "+" else out - product(level)
        return out

    out = total(0)
    if at < len(tokens):
        raise ValueError(f"formula breaks at {tokens[at]}")
    return out


def first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule whose condition holds (FLT26)."""
    out = F.when(F.lit(False), otherwise)
    for when, value in rules:
        out = out.when(when, value)
    return out.otherwise(otherwise)


def unit_price(list_price: Column, markup: Column, brand_markup: Column, discount: Column) -> Column:
    """List price with markups, less discount (MD12)."""
    return list_price * (1 + markup + brand_markup) * (1 - discount)


def totals(lines: DataFrame, by: list[str], amount: str, discount: str, tax: float, digits: int = 2, lead: str | None = None) -> DataFrame:
    """``subtotal, discounts, tax, total`` of each quotation, rounded halves up, and the longest lead time (AG27)."""
    out = lines.groupBy(*by).agg(F.sum(amount).alias("_s"), F.sum(discount).alias("_d"), *([F.max(lead).alias("lead")] if lead else []))
    net = F.col("_s") - F.col("_d")
    return out.select(*by, half_up(F.col("_s"), digits).alias("subtotal"), half_up(F.col("_d"), digits).alias("discounts"), half_up(net * tax, digits).alias("tax"), half_up(net * (1 + tax), digits).alias("total"), *(["lead"] if lead else []))


def compatible(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Whether hard specifications agree; an unknown one on either side does (FLT25)."""
    out = F.lit(True)
    for a, b in pairs.values():
        out = out & (a.isNull() | b.isNull() | (a == b))
    return out


def when_matches(fields: dict[str, Column], when: dict[str, object], synonyms: dict[str, str] = {}) -> Column:  # noqa: B006
    """Whether a rule's conditions hold: a value or one of a list, in canonical form (FLT26); a null field doesn't match."""
    out = F.lit(True)
    for name, wanted in when.items():
        many = [canonical(F.lit(str(w)), synonyms) for w in (wanted if isinstance(wanted, list) else [wanted])]
        out = out & F.coalesce(canonical(fields[name].cast("string"), synonyms).isin(*many), F.lit(False))
    return out


def rule_price(fields: dict[str, Column], rules: list[tuple[dict[str, object], str]], synonyms: dict[str, str] = {}) -> Column:  # noqa: B006
    """The formula of the first rule that matches, over the fields that are numbers; null where none does (MD12, SC39)."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for when, text in rules:
        out = out.when(when_matches(fields, when, synonyms), formula(text))
    return out


def best_break(quantity: Column, breaks: list[tuple[float, float]]) -> Column:
    """The greatest discount of all quantity breaks ``(least, discount)`` that a quantity reaches, else 0 (WN12)."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(quantity >= least, F.lit(float(d))).otherwise(0.0) for least, d in breaks])


def priced(lines: DataFrame, parts: DataFrame, code: str, description: str) -> DataFrame:
    """Lines with the catalogue's part of their code, else of their description in the same words, else null (JN20).

    ``parts`` has ``code, description, list_price``; of parts that repeat one, the cheapest counts.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    by = lambda c, name: parts.where(F.trim(F.col(c)) != "").groupBy(low(F.col(c)).alias(f"_{c}")).agg(F.min("list_price").alias(name))
    rows = lines.withColumns({"_code": low(F.col(code)), "_description": low(F.col(description))})
    out = rows.join(by("code", "_one"), "_code", "left").join(by("description", "_two"), "_description", "left")
    how = F.when(F.col("_one").isNotNull(), "code").when(F.col("_two").isNotNull(), "description").otherwise("none")
    return out.withColumns({"list_price": F.coalesce("_one", "_two"), "found_by": how}).drop("_code", "_description", "_one", "_two")


def rollup(lines: DataFrame, kind: str, amount: str, cost: str, digits: int = 2) -> DataFrame:
    """``kind, n, amount, cost, margin`` of each bucket of lines, rounded halves up (AG28, AG32)."""
    out = lines.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(amount).alias("_a"), F.sum(cost).alias("_c"))
    return out.select("kind", "n", half_up(F.col("_a"), digits).alias("amount"), half_up(F.col("_c"), digits).alias("cost"), half_up(100 * F.try_divide(F.col("_a") - F.col("_c"), F.col("_a")), 1).alias("margin"))


def hit_rate(rows: DataFrame, label: Column, rule: Column) -> DataFrame:
    """``n, hit_rate``: how often a rule says what a label does; rows without a label don't count (AG32)."""
    return rows.where(label.isNotNull()).agg(F.count("*").alias("n"), F.avg(F.coalesce((label == rule).cast("int"), F.lit(0))).alias("hit_rate"))
