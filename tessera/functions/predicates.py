"""Filters as dictionaries, checked against a collection's fields and compiled to one Column."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.model import Collection, Field, RequestError

_BARE = {"eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains", "exclude", "not"}


def predicates(filters: dict[str, Any], of: Collection) -> list[tuple[Field, str, Any]]:
    """``(field, operator, operand)`` of each condition; a client's mistake raises :class:`RequestError`."""
    out = []
    for name, given in filters.items():
        field = of.fields.get(name)
        if field is None or not field.filterable:
            raise RequestError(f"{name} is no filterable field")
        conditions = given if isinstance(given, dict) else {"contains" if field.is_array else "in" if isinstance(given, list) else "eq": given}
        for key, operand in conditions.items():
            op = key.removeprefix("$")
            if op not in _BARE:
                raise RequestError(f"{key} is no operator")
            if op in ("gt", "gte", "lt", "lte") and (field.kind != "number" or isinstance(operand, bool) or not isinstance(operand, (int, float))):
                raise RequestError(f"{name}: {op} takes a number")
            if op in ("in", "nin", "exclude") and not isinstance(operand, list):
                raise RequestError(f"{name}: {op} takes a list")
            if op == "exclude" and not field.is_array or op == "not" and field.kind != "text":
                raise RequestError(f"{name}: {op} doesn't fit {field.kind}")
            out.append((field, op, operand))
    return out


def _overlap(c: Column, values: list) -> Column:
    return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(False)


def condition(field: Field, op: str, v: Any) -> Column:
    """One condition with the null semantics of its operator: ``ne``, ``nin`` and ``not`` keep nulls, others drop them."""
    c = F.col(field.name)
    if op == "eq":
        if field.is_array:
            return c == F.array(*map(F.lit, v))
        return c.isin(v, *field.also[v]) if v in field.also else c == F.lit(v)
    if op == "ne":
        return c.isNull() | (c != F.lit(v))
    if op in ("gt", "gte", "lt", "lte"):
        return {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    if op == "in":
        return c.isin(*v) if v else F.lit(False)
    if op == "nin":
        return c.isNull() | ~c.isin(*v) if v else F.lit(True)
    if op == "contains":
        return _overlap(c, v if isinstance(v, list) else [v]) if field.is_array else c.ilike(f"%{v}%")
    if op == "exclude":
        return c.isNotNull() & ~_overlap(c, v)
    return c.isNull() | ~c.rlike(f"(?i){java_quoted(str(v))}")


def java_quoted(text: str) -> str:
    """A pattern that matches the text itself (SC9)."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def where(filters: dict[str, Any], of: Collection, skip_soft: bool = False) -> tuple[Column, list[str]]:
    """The conjunction of all conditions, and the soft fields among them; with ``skip_soft`` those are left out."""
    found = predicates(filters, of)
    soft = [f.name for f, *_ in found if f.soft]
    used = [condition(*p) for p in found if not (skip_soft and p[0].soft)]
    return reduce(lambda a, b: a & b, used, F.lit(True)), soft


def without_terms(columns: list[str], terms: list[str]) -> Column:
    """Rows none of whose texts has any of the terms, without regard to case; a null text counts as empty (FLT13)."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return reduce(lambda a, b: a & b, [~text.rlike(f"(?i){java_quoted(t)}") for t in terms], F.lit(True))


def scoped(scope: dict[str, Any], of: Collection) -> Column:
    """Equality on every scope key; a missing one is a mistake, as it would show one tenant's rows to another (FLT17)."""
    if missing := [k for k in of.scopes if scope.get(k) is None]:
        raise RequestError(f"scope lacks {', '.join(missing)}")
    return reduce(lambda a, b: a & b, [F.col(f"scope_{k}") == F.lit(scope[k]) for k in of.scopes], F.lit(True))


def visible() -> Column:
    """Rows that are ready, or have no pipeline (FLT16)."""
    return F.col("pipeline_status").isNull() | (F.col("pipeline_status") == "ready")


def verdicts(wanted: dict[str, Column]) -> Column:
    """For each named condition ``satisfied``, ``violated`` or, where it is null, ``unknown`` (FLT20)."""
    return F.create_map(*[x for name, c in wanted.items() for x in (F.lit(name), F.when(c.isNull(), "unknown").when(c, "satisfied").otherwise("violated"))])


def blocked(columns: list[str], terms: list[str]) -> Column:
    """Whether any of the texts has one of the terms as whole words, case aside (FLT20); null texts have none."""
    text = F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns])
    return reduce(lambda a, b: a | b, [text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}]){java_quoted(t)}(?![\p{{L}}\p{{N}}])") for t in terms], F.lit(False))


def strict(verdict: Column) -> Column:
    """Whether all verdicts of a map are ``satisfied``; lenient callers ask that none is ``violated`` (FLT20)."""
    return F.forall(F.map_values(verdict), lambda v: v == "satisfied")
