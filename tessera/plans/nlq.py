"""Query understanding: enumerated values in a query become filters, and what an injected model says is checked and merged."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from tessera.plans.model import Collection, Field

_NOT = {"no", "not", "without", "except", "never"}


@dataclass
class Understood:
    filters: dict[str, list[str]]
    excluded: dict[str, list[str]]
    rest: str


def words(text: str) -> list[str]:
    """Runs of letters and digits, compatibility forms folded, in lower case (SC12)."""
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower())


def budget(a: str, b: str) -> int:
    """Edits within which two words are the same: none up to 2 letters, 1 up to 5, else 2, by the shorter (SC13)."""
    n = min(len(a), len(b))
    return 0 if n <= 2 else 1 if n <= 5 else 2


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def same(a: str, b: str) -> bool:
    """Equal but for a plural ending (SC14)."""
    return a == b or a in (b + "s", b + "es") or b in (a + "s", a + "es")


def understand(query: str, of: Collection, values: dict[str, list[str]]) -> Understood:
    """Filters from the values of enumerated fields that a query names.

    Longest phrases first, each word used once; a phrase that several fields have says nothing; one after a negation
    excludes. What isn't used is the rest, to search for.
    """
    asked = words(query)
    phrases = sorted(((words(v), f, v) for f, vs in values.items() if f in of.fields for v in vs), key=lambda p: (-len(p[0]), p[1], p[2]))
    used = [False] * len(asked)
    filters: dict[str, list[str]] = {}
    excluded: dict[str, list[str]] = {}
    for phrase, f, v in phrases:
        others = {g for p, g, _ in phrases if p == phrase}
        for i in range(len(asked) - len(phrase) + 1):
            span = range(i, i + len(phrase))
            if phrase and not any(used[j] for j in span) and all(same(asked[j], w) for j, w in zip(span, phrase)):
                if len(others) > 1:
                    continue
                for j in span:
                    used[j] = True
                if i and asked[i - 1] in _NOT:
                    used[i - 1] = True
                    excluded.setdefault(f, []).append(v)
                else:
                    filters.setdefault(f, []).append(v)
    return Understood(filters, excluded, " ".join(w for w, u in zip(asked, used) if not u))


# What a model is asked, and what is made of its answer.


def schema(of: Collection, values: dict[str, list[str]], aspects: tuple[str, ...] = (), most: int = 60) -> dict[str, dict]:
    """The JSON schema of an answer (NL1, NL2): enumerated fields with their values, numbers with bounds and a hint at the
    budget, arrays and texts, each with what to exclude; and a weight and a query of its own for each aspect."""
    out: dict[str, dict] = {"semantic_query": {"type": "string"}, "lexical_query": {"type": "string"}, "exclude_terms": {"type": "array"}}
    for f in of.fields.values():
        if not f.filterable:
            continue
        known = {"enum": values[f.name][:most]} if values.get(f.name) else {}
        if f.kind == "number":
            out |= {f"min_{f.name}": {"type": "number"}, f"max_{f.name}": {"type": "number"}, f"{f.name}_budget_hint": {"enum": ["cheap", "premium", "none"]}}
        elif f.kind == "boolean":
            out[f.name] = {"type": "boolean"}
        else:
            out[f.name] = {"type": "array", "items": known} if f.is_array else {"type": "string"} | ({"enum": [*known["enum"], "any"]} if known else {})
            out[f"exclude_{f.name}"] = {"type": "array", "items": known}
    if aspects:
        out["aspects"] = {"type": "object", "properties": {a: {"weight": "number", "query": "string"} for a in aspects}}
    return out


def key(query: str, of: Collection, version: str = "1") -> str:
    """The key under which an answer is kept (PP29): the query in folded form, the collection and a version."""
    return hashlib.sha1("|".join([version, of.name, " ".join(sorted(of.fields)), " ".join(query.lower().split())]).encode()).hexdigest()


def prompt(query: str, asked: dict[str, dict]) -> str:
    """The question to the model (PP29)."""
    return f"Say what this search asks for as JSON of the given form, and leave out what it doesn't say.\nForm: {json.dumps(asked, sort_keys=True)}\nSearch: {query}"


def _texts(v: Any) -> list[str]:
    return [x for x in v if isinstance(x, str) and x] if isinstance(v, list) else []


def filters_of(answer: dict[str, Any], of: Collection) -> tuple[dict[str, Any], list[str], dict[str, str]]:
    """Filters, terms to exclude and hints at the budget from an answer (NL6); bounds that aren't above 0 say nothing, a
    bound makes a hint void."""
    filters: dict[str, Any] = {}
    hints: dict[str, str] = {}
    for name, f in of.fields.items():
        if not f.filterable:
            continue
        given, out = answer.get(name), _texts(answer.get(f"exclude_{name}"))
        if f.kind == "number":
            bounds = {op: answer[k] for op, k in (("lte", f"max_{name}"), ("gte", f"min_{name}")) if isinstance(answer.get(k), (int, float)) and not isinstance(answer[k], bool) and answer[k] > 0}
            if bounds:
                filters[name] = bounds
            elif answer.get(f"{name}_budget_hint") in ("cheap", "premium"):
                hints[name] = answer[f"{name}_budget_hint"]
        elif f.kind == "boolean":
            if isinstance(given, bool):
                filters[name] = given
        else:
            want: Any = _texts(given) if f.is_array else given if isinstance(given, str) and given and given != "any" else None
            ops = {("contains" if f.is_array or f.kind == "text" else "in"): [want] if f.kind == "enum" else want} if want else {}
            if out:
                ops["exclude" if f.is_array else "nin"] = out
            if ops:
                filters[name] = want if want and not out else ops
    return filters, _texts(answer.get("exclude_terms")), hints


def _values(raw: Any, keep: Callable[[str], str | None]) -> tuple[Any, list[str]]:
    """A filter with its positive values mapped by ``keep``, those it gives None for gone; and the gone ones."""
    gone: list[str] = []

    def one(v: Any) -> Any:
        if not isinstance(v, str):
            return v
        new = keep(v)
        if new is None:
            gone.append(v)
        return new

    def many(v: Any) -> Any:
        if isinstance(v, list):
            return [x for x in map(one, v) if x is not None] or None
        return one(v)

    if isinstance(raw, dict):
        kept = {op: v if op in ("nin", "ne", "exclude", "not") else many(v) for op, v in raw.items()}
        kept = {op: v for op, v in kept.items() if v is not None}
        return kept or None, gone
    return many(raw), gone


def corroborated(filters: dict[str, Any], of: Collection, query: str, lexical: str | None = None) -> tuple[dict[str, Any], dict[str, list[str]]]:
    """Filters without hard enumerated values that the query doesn't name, in itself or as corrected, plural or not, by
    their own words or by those of what they also stand for (NL4); and what was dropped. Exclusions stay."""
    said = words(query) + words(lexical or "")
    out, dropped = {}, {}
    for name, raw in filters.items():
        f = of.fields[name]
        if f.soft or f.kind not in ("enum", "array"):
            out[name] = raw
            continue

        def keep(v: str, f: Field = f) -> str | None:
            forms = [words(v), *[words(a) for a in f.also.get(v, [])]]
            return v if any(w and all(any(same(x, s) for s in said) for x in w) for w in forms) else None

        kept, gone = _values(raw, keep)
        if kept is not None:
            out[name] = kept
        if gone:
            dropped[name] = gone
    return out, dropped


def merged(answered: dict[str, Any], certain: dict[str, Any], explicit: dict[str, Any], of: Collection) -> dict[str, Any]:
    """Filters of an answer, soft ones replaced by what the query's own words say, all by what the client asks (NL5)."""
    return answered | {k: v for k, v in certain.items() if of.fields[k].soft} | explicit


def grounded(filters: dict[str, Any], decisions: dict[str, dict[str, str | None]], semantic: str) -> tuple[dict[str, Any], str]:
    """Filters with values mapped to known ones, and the text to search for with those that aren't known appended (NL7).

    ``decisions`` has, for each field and value, the known value or None, as :func:`tessera.operators.search.ground`
    and :func:`known_values` give them; values without a decision stay."""
    out, text = {}, semantic.strip()
    for name, raw in filters.items():
        kept, gone = _values(raw, lambda v, name=name: decisions.get(name, {}).get(v, v))
        if kept is not None:
            out[name] = kept
        for v in gone:
            if v.lower() not in text.lower():
                text = f"{text} {v}".strip()
    return out, text


def known_values(filters: dict[str, Any], vocabulary: dict[str, list[str]]) -> dict[str, dict[str, str | None]]:
    """Decisions by equality without case, for stores without similarity (NL10)."""
    out: dict[str, dict[str, str | None]] = {}
    for name, raw in filters.items():
        if name in vocabulary:
            low = {v.lower(): v for v in sorted(vocabulary[name], reverse=True)}
            found: dict[str, str | None] = {}
            _values(raw, lambda v, low=low, found=found: found.setdefault(v, low.get(v.lower())))
            out[name] = found
    return out


def guarded(query: str, lexical: Any) -> str | None:
    """A corrected query, if it only corrects: no more words than the query has, each within a few edits of one of them (NL8)."""
    if not isinstance(lexical, str) or not lexical.strip():
        return None
    own, new = words(query), words(lexical)
    fine = new and len(new) <= len(own) and all(any(within(w, o, budget(w, o)) for o in own) for w in new)
    return lexical.strip() if fine else None


@dataclass
class Plan:
    """What a query asks for: filters, of which some only by derivation, texts to search for, and how it came about."""

    filters: dict[str, Any]
    derived: frozenset[str]
    semantic: str
    lexical: str
    excluded: list[str] = field(default_factory=list)
    hints: dict[str, str] = field(default_factory=dict)
    aspects: dict[str, tuple[float, str]] = field(default_factory=dict)
    dropped: dict[str, list[str]] = field(default_factory=dict)
    certain: dict[str, Any] = field(default_factory=dict)
    degraded: bool = False


def clamped(raw: Any, semantic: str, known: tuple[str, ...]) -> dict[str, tuple[float, str]]:
    """Routes of an answer: a weight between 0 and 1 and a text for each known aspect (PP29); what isn't a number is 0."""
    out = {}
    for name, route in raw.items() if isinstance(raw, dict) else ():
        if name in known and isinstance(route, dict):
            w = route.get("weight")
            good = isinstance(w, (int, float)) and not isinstance(w, bool) and w == w and abs(w) != float("inf")
            own = route.get("query")
            out[name] = (min(1.0, max(0.0, float(w))) if good else 0.0, own.strip() if isinstance(own, str) and own.strip() else semantic)
    return out


def plan(query: str, of: Collection, values: dict[str, list[str]], explicit: dict[str, Any] | None = None, generate: Callable[[str], str] | None = None, kept: dict[str, dict] | None = None, seconds: float = 8.0, aspects: tuple[str, ...] = ()) -> Plan:
    """Understands a query (NL9): by an injected model within so many seconds and with answers kept by key, and where there
    is none, or it fails, by the query's own words alone, which marks the plan as degraded."""
    explicit = explicit or {}
    own = understand(query, of, values)
    certain = {k: v if of.fields[k].is_array or len(v) > 1 else v[0] for k, v in own.filters.items()}
    certain = {k: {"in": v} if isinstance(v, list) and not of.fields[k].is_array else v for k, v in certain.items()}
    for k, v in own.excluded.items():
        op = "exclude" if of.fields[k].is_array else "nin"
        certain[k] = {op: v} | ({("contains" if of.fields[k].is_array else "in"): own.filters[k]} if k in own.filters else {})
    answer = None
    if generate:
        at = key(query, of)
        answer = (kept or {}).get(at)
        if answer is None:
            pool = ThreadPoolExecutor(1)
            try:
                got = json.loads(pool.submit(generate, prompt(query, schema(of, values, aspects))).result(seconds))
                answer = got if isinstance(got, dict) else None
            except Exception:  # noqa: BLE001 - a search goes on without it
                answer = None
            finally:
                pool.shutdown(wait=False)
            if answer is not None and kept is not None:
                kept[at] = answer
    if answer is None:
        return Plan(certain | explicit, frozenset(certain.keys() - explicit.keys()), query.strip(), query.strip(), certain=certain, degraded=True)
    filters, excluded, hints = filters_of(answer, of)
    lexical = guarded(query, answer.get("lexical_query"))
    filters, dropped = corroborated(filters, of, query, lexical)
    decisions = known_values({k: v for k, v in filters.items() if of.fields[k].kind == "text"}, values)
    semantic = answer.get("semantic_query")
    filters, semantic = grounded(filters, decisions, semantic if isinstance(semantic, str) and semantic.strip() else query)
    whole = merged(filters, certain, explicit, of)
    return Plan(whole, frozenset(whole.keys() - explicit.keys()), semantic, lexical or query.strip(), excluded, {k: h for k, h in hints.items() if k not in whole}, clamped(answer.get("aspects"), semantic, aspects), dropped, certain)
