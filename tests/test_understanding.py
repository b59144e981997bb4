import json

import pytest

from tessera.plans import nlq
from tessera.plans.model import Field, RequestError, collection, dedup_settings
from tessera.plans.search import aspect_weights, clamp_page, kind_of, rescued, trace

SHOP = collection(
    "shop",
    Field("category", "enum", filterable=True, also={"tops": ["blouse"]}),
    Field("colour", "array", filterable=True, soft=True),
    Field("brand", filterable=True),
    Field("price", "number", filterable=True),
    Field("available", "boolean", filterable=True),
)
VALUES = {"category": ["tops", "dresses"], "colour": ["red", "navy blue"], "brand": ["Acme", "Zeta"]}


def test_schema_and_filters_of_an_answer():
    asked = nlq.schema(SHOP, VALUES, ("look",))
    assert asked["category"]["enum"] == ["tops", "dresses", "any"] and "max_price" in asked and "exclude_colour" in asked and "look" in asked["aspects"]["properties"]
    filters, out, hints = nlq.filters_of({"category": "any", "colour": ["red"], "exclude_colour": ["navy blue"], "max_price": 20, "min_price": 0, "available": True, "exclude_terms": ["kids", 3], "brand": ""}, SHOP)
    assert filters == {"colour": {"contains": ["red"], "exclude": ["navy blue"]}, "price": {"lte": 20}, "available": True} and out == ["kids"] and hints == {}
    assert nlq.filters_of({"price_budget_hint": "cheap", "category": "tops", "exclude_category": ["dresses"]}, SHOP)[::2] == ({"category": {"in": ["tops"], "nin": ["dresses"]}}, {"price": "cheap"})


def test_only_what_the_query_says_is_a_hard_filter():
    kept, gone = nlq.corroborated({"category": "tops", "colour": ["red"]}, SHOP, "saree blouses")
    assert kept == {"category": "tops", "colour": ["red"]} and gone == {}
    kept, gone = nlq.corroborated({"category": {"in": ["dresses", "tops"], "nin": ["dresses"]}}, SHOP, "red top")
    assert kept == {"category": {"in": ["tops"], "nin": ["dresses"]}} and gone == {"category": ["dresses"]}
    assert nlq.corroborated({"category": "dresses"}, SHOP, "gown", "dress")[0] == {"category": "dresses"}
    assert nlq.merged({"colour": ["red"], "category": "tops"}, {"colour": ["navy blue"], "category": "dresses"}, {"price": {"lte": 5}}, SHOP) == {"colour": ["navy blue"], "category": "tops", "price": {"lte": 5}}


def test_grounding_and_the_guard():
    filters = {"brand": "ACME", "price": {"lte": 3}}
    assert nlq.grounded(filters, nlq.known_values(filters, VALUES), "shirt") == ({"brand": "Acme", "price": {"lte": 3}}, "shirt")
    odd = {"brand": {"contains": "Nope"}}
    assert nlq.grounded(odd, nlq.known_values(odd, VALUES), "shirt") == ({}, "shirt Nope")
    assert nlq.guarded("red hoddie", "red hoodie") == "red hoodie" and nlq.guarded("hoddie", "streetwear hoodie") is None
    assert nlq.guarded("xxl tee", "xl tee") is None and nlq.guarded("a", 3) is None and nlq.guarded("a", "  ") is None


def test_orchestration():
    calls = []

    def generate(question):
        calls.append(question)
        return json.dumps({"semantic_query": "top in red", "lexical_query": "red tops", "category": "tops", "brand": "acme", "price_budget_hint": "cheap", "aspects": {"look": {"weight": 7, "query": "red"}, "odd": {"weight": 1}}})

    kept: dict = {}
    for _ in range(2):
        p = nlq.plan("Red top acme", SHOP, VALUES, {"available": True}, generate, kept, aspects=("look",))
        assert p.filters == {"category": "tops", "brand": "Acme", "colour": ["red"], "available": True} and p.derived == {"category", "brand", "colour"}
        assert (p.semantic, p.lexical, p.hints, p.aspects, p.degraded) == ("top in red", "red tops", {"price": "cheap"}, {"look": (1.0, "red")}, False)
    assert len(calls) == 1
    for bad in (lambda q: "no json", lambda q: 1 / 0, lambda q: "[]"):
        p = nlq.plan("red tops without navy blue", SHOP, VALUES, None, bad)
        assert p.degraded and p.filters == {"category": "tops", "colour": {"exclude": ["navy blue"], "contains": ["red"]}}


def test_aspects():
    on = {"doc": 1.0, "look": 0.5, "off": 0.0}
    assert aspect_weights(on, {}, "q") == {"doc": (1.0, "q"), "look": (0.5, "q")}
    assert aspect_weights(on, {}, "q", degraded=True) == {"doc": (1.0, "q")}
    assert aspect_weights(on, {"look": (0.5, "red")}, "q") == {"doc": (1.0, "q"), "look": (0.25, "red")}
    assert aspect_weights(on, {"doc": (0.0, "q")}, "q") == {} and aspect_weights(on, {"doc": (1.0, "x")}, "q", image=True) == {"doc": (1.0, "x"), "look": (0.5, "q")}
    assert aspect_weights(on, {"look": (0.0, "x")}, "q", mode="keyword") == {"doc": (1.0, "q"), "look": (0.5, "q")}


def test_trace_and_bounds():
    t = trace(SHOP, {"category": "tops", "price": {"lte": 5}, "colour": ["red"]}, {"category": "tops"}, {"colour": ["red"]}, {}, {"price": "cheap"}, ["colour", "colour"])
    assert [(i["field"], i["source"], i["kind"], i["soft"]) for i in t["items"]] == [("category", "explicit", "eq", False), ("price", "budget_hint", "max", False), ("colour", "deterministic", "contains", True)] and t["relaxed"] == ["colour"]
    assert kind_of("eq", "boolean") == "boolean" and kind_of("nin", "text") == "not_in"
    assert clamp_page(None, -3) == (10, 0) and clamp_page(10_000, 10_000) == (100, 200)


def test_rescue_by_other_words():
    hits = {"hoddie": 1, "hoodie": 5, "shirt": 9}
    found = lambda q: (q, hits[q])
    vec = {"hoddie": [1, 0], "hoodie": [0.9, 0.1], "shirt": [0, 1]}
    assert rescued(found, "hoddie", lambda q: ["shirt", "hoodie"], vec.get) == ("hoodie", "hoodie")
    assert rescued(found, "hoodie", lambda q: 1 / 0, vec.get) == ("hoodie", None)
    assert rescued(found, "hoddie", lambda q: 1 / 0, vec.get) == ("hoddie", None) and rescued(found, "hoddie", lambda q: ["shirt"], vec.get) == ("hoddie", None)


def test_settings_of_deduplication():
    assert dedup_settings(SHOP, {"channels": {"trigram:brand": 1.0, "cosine": 2.0}})["auto"] == 0.7
    for bad in ({}, {"channels": {"trigram:nope": 1}}, {"channels": {"cosine": 0}}, {"exact_key": "nope"}, {"exact_key": "brand", "auto": 0.1}):
        with pytest.raises(RequestError):
            dedup_settings(SHOP, bad)
