"""One search from a request to a page of results: a chain of lazy frames, with driver loops only over a few counts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import condition, predicates, scoped, verdicts, visible, where, without_terms
from tessera.operators import facets, metrics, search, shop
from tessera.plans import nlq
from tessera.plans.model import Collection, RequestError

#: Hits that a page may skip, and that it may have.
MOST_OFFSET, MOST_LIMIT = 200, 100
#: Results that soft filters are relaxed for.
TARGET = 3


@dataclass(frozen=True)
class Request:
    """What a client asks for. ``mode`` is ``keyword``, ``similar`` (meaning alone) or ``intent`` (meaning first)."""

    filters: dict[str, Any] = field(default_factory=dict)
    scope: dict[str, Any] = field(default_factory=dict)
    derived: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)
    mode: str = "keyword"
    limit: int = 10
    offset: int = 0
    floor: float | None = None
    group: str | None = None
    facets: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 < self.limit <= MOST_LIMIT or not 0 <= self.offset <= MOST_OFFSET:
            raise RequestError("page is out of bounds")
        if self.mode not in ("keyword", "similar", "intent"):
            raise RequestError(f"{self.mode} is no mode")


def leg_weights(of: Collection, request: Request) -> dict[str, float]:
    """Weights of the legs by mode; those of the request win (SE2)."""
    w = dict(of.channels)
    if request.mode == "similar":
        w["fts"] = 0.0
    elif request.mode == "intent":
        w["fts"] = min(w.get("fts", 0.0), 0.3 * w.get("cosine", 0.0))
    if unknown := request.weights.keys() - w.keys():
        raise RequestError(f"no channel {', '.join(sorted(unknown))}")
    return w | request.weights


def base(docs: DataFrame, of: Collection, request: Request, drop: list[str] = []) -> DataFrame:  # noqa: B006
    """Documents that the request may see: scope, visibility and filters, those of dropped soft fields left out."""
    cond, _ = where({k: v for k, v in request.filters.items() if k not in drop}, of)
    out = docs.where(scoped(request.scope, of)).where(cond)
    return out.where(visible()) if "pipeline_status" in docs.columns else out


def relaxable(docs: DataFrame, of: Collection, request: Request) -> list[str]:
    """Soft fields whose filters were derived and not asked for, those that alone keep most rows first (SE5, AG8)."""
    found = predicates(request.filters, of)
    names = sorted({f.name for f, *_ in found if f.soft and f.name in request.derived})
    if not names:
        return []
    conds = {n: reduce(lambda a, b: a & b, [condition(*p) for p in found if p[0].name == n]) for n in names}
    counts = {r.field: r.n for r in facets.probe(docs.where(scoped(request.scope, of)), conds).collect()}
    return sorted(names, key=lambda n: (-counts[n], n))


@dataclass
class Result:
    """A page of hits, facets of what the request may see, and what was dropped to get there."""

    hits: DataFrame
    facets: dict[str, DataFrame]
    relaxed: list[str]
    relaxed_by: dict[Any, list[str]] = field(default_factory=dict)


def run(docs: DataFrame, queries: DataFrame, of: Collection, request: Request, as_of: Column | None = None, half_life_days: float = 90.0) -> Result:
    """Searches ``docs`` (``doc_id, text, vec, updated_at`` and the fields) for ``queries`` (``query_id, text, vec``).

    Legs, fusion, floor, cutoff (only where no filter applies), one hit of each group, the page. A query with fewer than
    TARGET hits has derived soft filters dropped one by one and is searched for again; ``relaxed_by`` of the result tells
    for each query which.
    """
    weights = leg_weights(of, request)

    def hits(drop: list[str], queries: DataFrame) -> DataFrame:
        rows = base(docs, of, request, drop)
        legs: dict[str, tuple[DataFrame, float]] = {}
        if weights.get("fts"):
            legs["fts"] = (search.lexical(rows.select("doc_id", "text"), queries.select("query_id", "text")), weights["fts"])
        if weights.get("cosine"):
            legs["doc"] = (search.vector(rows.select("doc_id", "vec"), queries.select("query_id", "vec")), weights["cosine"])
        if not legs:  # browsing: filters and scope apply, newest first
            found = rows.crossJoin(search.small(queries.select("query_id"))).select("query_id", "doc_id", F.lit(0.0).alias("score"), "updated_at", F.lit(True).alias("fts"), F.lit(None).cast("double").alias("cos"))
            return search.ranked(found, F.desc_nulls_last("updated_at"))
        if weights.get("recency") and as_of is not None:
            seen = reduce(DataFrame.unionByName, [df.select("query_id", "doc_id") for df, _ in legs.values()])
            legs["recency"] = (search.recent(seen, rows.select("doc_id", F.col("updated_at").alias("at")), as_of, half_life_days), weights["recency"])
        fused = search.fuse(legs)
        fused = fused.withColumn("fts", F.col("fts_rank").isNotNull() if "fts" in legs else F.lit(False))
        if request.floor is not None and "doc" in legs:
            fused = fused.where(F.col("fts") | (F.col("cos") >= request.floor))
        out = search.ranked(fused, F.desc("score"))
        return out if request.filters else search.score_drop(out)

    # Each query is relaxed for itself: those that still have too few hits go on with one filter less, all at once.
    order, target = relaxable(docs, of, request), min(TARGET, request.limit)
    dropped: list[str] = []
    page, relaxed = hits([], queries), {}
    for name in order:
        few = queries.select("query_id").join(page.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= target), "query_id", "left_anti")
        ids = [r.query_id for r in few.collect()]  # of the batch of queries
        if not ids:
            break
        dropped.append(name)
        relaxed |= {i: list(dropped) for i in ids}
        again = F.col("query_id").isin(ids)
        page = page.where(~again).unionByName(hits(dropped, queries.where(again)), allowMissingColumns=True)
    if request.group:
        page = search.diversify(page.join(docs.select("doc_id", request.group), "doc_id", "left"), request.group, by="rank")
        page = page.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    page = page.where((F.col("rank") > request.offset) & (F.col("rank") <= request.offset + request.limit))
    return Result(page, query_facets(base(docs, of, request, dropped), of, request.facets), dropped, relaxed)


def query_facets(rows: DataFrame, of: Collection, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The facet of each field by its kind; a field that isn't declared as one is a mistake (AG5, SE13)."""
    out = {}
    for name in names:
        f = of.fields.get(name)
        if f is None or not f.facet:
            raise RequestError(f"{name} is no facet")
        kind = {"number": facets.ranges, "boolean": facets.flags, "array": facets.elements}.get(f.kind, facets.terms)
        out[name] = kind(rows, F.col(name))
    return out


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    """A page within the bounds, for clients that are to be served rather than refused (TK11)."""
    return min(MOST_LIMIT, max(1, limit or 10)), min(MOST_OFFSET, max(0, offset or 0))


def aspect_weights(configured: dict[str, float], routes: dict[str, tuple[float, str]], semantic: str, mode: str = "intent", degraded: bool = False, image: bool = False) -> dict[str, tuple[float, str]]:
    """Weight and text of each aspect that a search uses (SE3). Configured aspects come in order, the first is primary.

    Without a route an intent is searched for in all aspects, a degraded one in the primary alone. With routes, an
    aspect counts with its route's weight and text; one without a route is off, but for the primary, which only an
    explicit weight of 0 turns off. An image keeps aspects without a route on.
    """
    out = {}
    for i, (name, weight) in enumerate(configured.items()):
        if weight <= 0:
            continue
        text = semantic
        if mode == "intent":
            if not image and degraded:
                if i:
                    continue
            elif routes and name in routes:
                share, text = routes[name]
                if share <= 0:
                    continue
                weight *= share
            elif routes and not image and i:
                continue
        out[name] = (weight, text)
    return out


def kind_of(op: str, field_kind: str) -> str:
    """The class of a condition as a trace names it (FLT27)."""
    named = {"ne": "not_eq", "gt": "min", "gte": "min", "lt": "max", "lte": "max", "in": "in", "nin": "not_in", "contains": "contains", "exclude": "exclude", "not": "exclude"}
    return named.get(op, "boolean" if field_kind == "boolean" else "eq")


def trace(of: Collection, applied: dict[str, Any], explicit: dict[str, Any], certain: dict[str, Any] = {}, derived: dict[str, Any] = {}, hints: dict[str, str] = {}, relaxed: list[str] = [], excluded: list[str] = []) -> dict[str, Any]:  # noqa: B006
    """Where each condition of a search came from and what became of it (SE15, PP22)."""

    def source(name: str) -> str:
        if name in explicit:
            return "explicit"
        if name in certain:
            return "deterministic"
        return "budget_hint" if name in hints and name not in derived else "nlq"

    items = [{"field": f.name, "source": source(f.name), "kind": kind_of(op, f.kind), "operator": op, "value": v, "soft": f.soft} for f, op, v in predicates(applied, of)]
    return {"items": items, "explicit": dict(explicit), "derived": dict(derived), "applied": dict(applied), "relaxed": sorted({*relaxed}), "excluded": list(excluded), "hints": dict(hints)}


def hinted(docs: DataFrame, filters: dict[str, Any], hints: dict[str, str], category: Column | None = None) -> dict[str, Any]:
    """Filters with hints at the budget as bounds: up to the 30th percentile of what is there for ``cheap``, from the 75th on
    for ``premium`` (SE20). A field that already has a bound keeps it."""
    out = dict(filters)
    rows = docs if category is None else docs.where(category)
    for name, hint in hints.items():
        if name not in out:
            at = rows.agg(F.percentile(F.col(name), 0.30 if hint == "cheap" else 0.75).alias("p")).first().p
            if at is not None:
                out[name] = {"lte" if hint == "cheap" else "gte": at}
    return out


def rescued(found: Callable[[str], tuple[Any, int]], query: str, propose: Callable[[str], list[str]], embed: Callable[[str], list[float]], target: int = TARGET, near: float = 0.6, most: int = 3) -> tuple[Any, str | None]:
    """A search again in other words where it found too little (SE6): of ``most`` proposals the first that means nearly the
    same is tried, and stands if it finds more. ``found`` gives a result and its number of hits; what a proposer or an
    embedder raises leaves the first result."""
    result, n = found(query)
    if n >= target or not query.strip():
        return result, None
    try:
        own = embed(query)
        for other in propose(query)[:most]:
            if other.strip().lower() != query.strip().lower() and _cosine(own, embed(other)) >= near:
                again, more = found(other)
                return (again, other) if more > n else (result, None)
    except Exception:  # noqa: BLE001 - the first result stands
        pass
    return result, None


def _cosine(a: list[float], b: list[float]) -> float:
    size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / size if size and len(a) == len(b) else -1.0


@dataclass
class Search:
    """A collection with all that a search of it needs, injected where models have a part (SE1, SE12, SE19, PP24, UD10).

    ``embed`` makes a vector of a text (UD1), ``generate`` answers a prompt, ``propose`` gives other words for a query,
    ``judge`` grades texts for a query; without them the search does with words and filters.
    """

    docs: DataFrame
    of: Collection
    values: dict[str, list[str]] = field(default_factory=dict)
    embed: Callable[[str], list[float]] | None = None
    generate: Callable[[str], str] | None = None
    propose: Callable[[str], list[str]] | None = None
    judge: Callable[[str, list[str]], list[float | None]] | None = None
    offers: tuple[DataFrame, str, tuple[str, ...]] | None = None
    policy: Callable[[DataFrame], DataFrame] | None = None

    def _asked(self, text: str, semantic: str) -> DataFrame:
        vec = [float(x) for x in self.embed(semantic)] if self.embed else None
        return self.docs.sparkSession.createDataFrame([(0, text, vec)], "query_id int, text string, vec array<double>")

    def query(self, text: str, request: Request, as_of: Column | None = None) -> tuple[Result, dict[str, Any]]:
        """A page of results for a text, and the trace of its conditions.

        The text is understood, filters derived from it are added to the request's, budget hints become bounds, the
        search runs and is rescued by other words if it finds too little; hits are reranked, put in the order of the
        policy, cut to the page and given their documents' fields and offers.
        """
        understood = nlq.plan(text, self.of, self.values, request.filters, self.generate)
        scope = self.docs.where(scoped(request.scope, self.of))
        applied = hinted(scope, understood.filters, understood.hints)
        docs = self.docs if not understood.excluded else self.docs.where(without_terms(["text"], understood.excluded))
        wide = replace(request, filters=applied, derived=frozenset(applied.keys() - request.filters.keys()), offset=0, limit=max(50, request.limit + request.offset) if request.limit + request.offset <= MOST_LIMIT else MOST_LIMIT)
        if not self.embed:
            wide = replace(wide, weights=wide.weights | {"cosine": 0.0})

        def found(words: str) -> tuple[tuple[Result, DataFrame], int]:
            asked = self._asked(words, understood.semantic if words == understood.lexical else words)
            r = run(docs, asked, self.of, wide, as_of)
            return (r, asked), r.hits.limit(TARGET).count()

        if self.propose and self.embed and not request.filters:
            (result, asked), other = rescued(found, understood.lexical, self.propose, self.embed)
        else:
            (result, asked), other = found(understood.lexical)[0], None
        hits = search.attached(result.hits.drop("updated_at"), self.docs, "text", *self.of.fields)
        if self.judge:
            hits = search.reranked(hits, F.col("text"), self.judge, asked).drop("rank").withColumnRenamed("place", "rank")
        if self.policy:
            hits = search.ranked(self.policy(hits).drop("rank"), F.desc("policy_score"))
        hits = hits.where((F.col("rank") > request.offset) & (F.col("rank") <= request.offset + request.limit))
        if self.offers:
            hits = search.offers(hits, self.offers[0], self.offers[1], *self.offers[2])
        told = trace(self.of, applied, request.filters, understood.certain, understood.filters, understood.hints, result.relaxed, understood.excluded)
        return Result(hits, result.facets, result.relaxed, result.relaxed_by), told | {"rewritten": other, "degraded": understood.degraded}

    def explain(self, text: str, request: Request) -> DataFrame:
        """The first 20 hits with each leg's rank and the fused score (SE11, SE12)."""
        plain = replace(request, limit=min(20, request.limit))
        if not self.embed:
            plain = replace(plain, weights=plain.weights | {"cosine": 0.0})
        return run(self.docs, self._asked(text, text), self.of, plain).hits

    def similar(self, id_: Any, request: Request) -> DataFrame:
        """Documents near one of them in meaning, itself left out (SE18)."""
        one = self.docs.where(F.col("doc_id") == F.lit(id_)).select(F.lit(0).alias("query_id"), F.col("text"), F.col("vec"))
        rest = self.docs.where(F.col("doc_id") != F.lit(id_))
        return search.attached(run(rest, one, self.of, replace(request, mode="similar")).hits, self.docs, *self.of.fields)

    def find(self, text: str, wanted: dict[str, Any], request: Request, strict: bool = False) -> DataFrame:
        """What an assistant is shown (SE18, PP12): hits with, for each constraint, whether it is satisfied; strict ones
        leave out what is violated or unknown."""
        filters = {k: v for k, v in shop.constraints(wanted).items() if k in self.of.fields}
        hits = self.query(text, request)[0].hits
        conds = {f"{f.name}_{op}": condition(f, op, v) for f, op, v in predicates(filters, self.of)}
        if not conds:
            return hits
        checked = hits.withColumn("constraints", verdicts(conds))
        return checked.where(F.forall(F.map_values("constraints"), lambda v: v == "satisfied")) if strict else checked


def shop_page(page: DataFrame, taste: Column, weight: float = 0.2, keep: int = 10) -> DataFrame:
    """A shop's page (SE17): hits in the order of their policy score and the customer's taste, with what spoke for each."""
    scored = page.withColumn("taste", taste).withColumn("shop_score", F.coalesce("policy_score", "score") + weight * F.col("taste"))
    why = F.array_compact(F.array(F.when(F.col("fts"), "matches your words"), F.when(F.col("cos") >= 0.5, "close in meaning"), F.when(F.col("taste") > 0, "fits your taste"), F.when(F.col("taste") < 0, "against your taste")))
    return search.ranked(scored.drop("rank"), F.desc("shop_score"), keep=keep).withColumn("why", why)


def sweep(runs: dict[str, Callable[[], DataFrame]], grades: DataFrame, k: int = 10) -> DataFrame:
    """``config, ndcg`` of each configuration of a search, the best first, ties by name (SE24). Hits without a grade have 0."""
    each = [metrics.ndcg(make().join(grades, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade")), k).select(F.lit(name).alias("config"), "ndcg") for name, make in runs.items()]
    return reduce(DataFrame.unionAll, each).groupBy("config").agg(F.avg("ndcg").alias("ndcg")).orderBy(F.desc("ndcg"), "config")


class Cache:
    """Results by key for a while; the oldest goes when there are too many, a collection's go when it changes (SE16)."""

    def __init__(self, seconds: float = 60, most: int = 500, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.kept: dict[tuple[str, str], tuple[float, Any]] = {}

    def get(self, collection: str, key: str, make: Callable[[], Any]) -> Any:
        at = self.kept.get((collection, key))
        if at and self.clock() - at[0] < self.seconds:
            return at[1]
        value = make()
        self.kept.pop((collection, key), None)
        self.kept[collection, key] = (self.clock(), value)
        while len(self.kept) > self.most:
            del self.kept[next(iter(self.kept))]
        return value

    def drop(self, collection: str) -> None:
        for k in [k for k in self.kept if k[0] == collection]:
            del self.kept[k]
