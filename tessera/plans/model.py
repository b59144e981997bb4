"""Declared collections and entities, checked on construction, and what follows from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RequestError(ValueError):
    """A request that doesn't fit the declared collection."""


_IDENT = re.compile(r"^[a-zA-Z][a-zA-Z0-9_]{0,62}$")
KINDS = {"text": T.StringType(), "enum": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}


def identifier(name: str) -> str:
    """The name, if it may name a column: a letter, then letters, digits and underscores, 63 characters at most."""
    if not _IDENT.match(name):
        raise RequestError(f"{name!r} is no identifier")
    return name


@dataclass(frozen=True)
class Field:
    """A typed field, read from ``path`` of the document's JSON (``enriched.`` first reads from the enrichment)."""

    name: str
    kind: str = "text"
    path: str | None = None
    searchable: bool = False
    filterable: bool = False
    facet: bool = False
    soft: bool = False
    also: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        identifier(self.name)
        if self.kind not in KINDS:
            raise RequestError(f"{self.name}: {self.kind} is no kind")
        if self.facet and self.searchable and self.kind == "number":
            raise RequestError(f"{self.name}: a number isn't searchable")

    @property
    def is_array(self) -> bool:
        return self.kind == "array"


@dataclass(frozen=True)
class Collection:
    """A table of documents: typed fields, scope keys and channels."""

    name: str
    fields: dict[str, Field]
    scopes: tuple[str, ...] = ()
    channels: dict[str, float] = field(default_factory=lambda: {"fts": 1.0, "cosine": 1.0, "recency": 0.0})

    def __post_init__(self):
        identifier(self.name)
        seen: dict[str, str] = {}
        for k, f in self.fields.items():
            if k != f.name or seen.setdefault(k.lower(), k) != k:
                raise RequestError(f"{k}: names must be their keys and differ in more than case")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType(), False), *[T.StructField(f"scope_{identifier(s)}", T.StringType(), False) for s in self.scopes], *[T.StructField(f.name, KINDS[f.kind]) for f in self.fields.values()]])


def collection(name: str, *fields: Field, **rest) -> Collection:
    return Collection(name, {f.name: f for f in fields}, **rest)


def read_field(f: Field, data: Column, enriched: Column) -> Column:
    """The typed value of a field from the JSON texts (PRJ1 to PRJ4); what isn't of the kind is null."""
    path = f.path or f.name
    source, path = (enriched, path.removeprefix("enriched.")) if path.startswith("enriched.") else (data, path.removeprefix("data."))
    raw = F.get_json_object(source, f"$.{path}")
    if f.is_array:
        return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull() & ~raw.startswith("["), F.split(raw, ",")))
    return raw.try_cast(KINDS[f.kind]) if f.kind in ("number", "boolean") else raw


def project(docs: DataFrame, of: Collection) -> DataFrame:
    """``id``, scopes and typed fields of documents with ``id``, ``data`` and, if there is any, ``enriched``."""
    enriched = F.col("enriched") if "enriched" in docs.columns else F.lit(None).cast("string")
    scopes = [F.get_json_object("data", f"$.{s}").alias(f"scope_{s}") for s in of.scopes]
    return docs.select("id", *scopes, *[read_field(f, F.col("data"), enriched).alias(f.name) for f in of.fields.values()])


def template(text: str) -> Column:
    """``"$title by $brand"`` as a Column over the named fields: arrays joined, blanks collapsed (PRJ5)."""
    parts = [F.coalesce(F.col(p[1:]).cast("string"), F.lit("")) if p.startswith("$") else F.lit(p) for p in re.split(r"(\$[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)", text) if p]
    return F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))


def source(expression: str) -> Column:
    """A source expression (PRJ6): a template if it has a ``$``, else names with bars between, of which the first that is
    neither null nor blank counts."""
    return template(expression) if "$" in expression else first_filled(*[F.col(p.strip()).cast("string") for p in expression.split("|")])


def default_surfaces(of: Collection, text: str | None = None) -> dict[str, Column]:
    """``doc`` from a template, else from all searchable fields; ``heavy`` and ``light`` text for ranking by words: the first
    searchable field, which names the thing, and the others (PRJ7)."""
    names = [f.name for f in of.fields.values() if f.searchable]
    join = lambda ns: F.trim(F.regexp_replace(F.concat_ws(" ", *[F.concat_ws(" ", F.col(n)) if of.fields[n].is_array else F.col(n).cast("string") for n in ns]), r"\s+", " "))
    return {"doc": template(text) if text else join(names), "heavy": join(names[:1]), "light": join(names[1:])}


def dedup_settings(of: Collection, given: dict) -> dict:
    """Settings of deduplication, checked (PP18): channels with a weight above 0 on fields that are there, and thresholds
    in order."""
    channels = given.get("channels") or {}
    for name, weight in channels.items():
        if name.split(":")[-1] not in {*of.fields, "cosine"} or not weight > 0:
            raise RequestError(f"dedup: channel {name} needs a field and a weight above 0")
    if (key := given.get("exact_key")) is not None and key not in of.fields:
        raise RequestError(f"dedup: no field {key}")
    if not channels and key is None:
        raise RequestError("dedup: neither channels nor an exact key")
    auto, suggest = given.get("auto", 0.7), given.get("suggest", 0.4)
    if not 0 <= suggest <= auto <= 1:
        raise RequestError("dedup: thresholds must be 0 <= suggest <= auto <= 1")
    return {"channels": dict(channels), "exact_key": key, "auto": auto, "suggest": suggest}


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank (PRJ6)."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def surfaces(rows: DataFrame, build: dict[str, Column], gate: Column | None = None) -> DataFrame:
    """Text surfaces and ``pipeline_status``: quarantined with a reason where one is empty or the gate rejects (PRJ8)."""
    out = rows.withColumns(build)
    reason = F.lit(None).cast("string") if gate is None else F.when(~F.coalesce(gate, F.lit(False)), "gate")
    for name in reversed(build):
        reason = F.when(F.coalesce(F.trim(name), F.lit("")) == "", f"empty:{name}").otherwise(reason)
    return out.withColumn("gate_reason", reason).withColumn("pipeline_status", F.when(F.col("gate_reason").isNull(), "ready").otherwise("quarantined"))


def evolution(old: Collection, new: Collection) -> dict[str, list[str]]:
    """What a new declaration changes: additions, fields to index again, and what destroys data (PP9)."""
    both = old.fields.keys() & new.fields.keys()
    changed = [k for k in sorted(both) if old.fields[k].kind != new.fields[k].kind]
    return {
        "additions": sorted(new.fields.keys() - old.fields.keys()),
        "reindex": sorted(k for k in both if k not in changed and (old.fields[k].path != new.fields[k].path or old.fields[k].searchable != new.fields[k].searchable)),
        "destructive": sorted(old.fields.keys() - new.fields.keys()) + changed + [f"scope {s}" for s in sorted(set(old.scopes) ^ set(new.scopes))],
    }
