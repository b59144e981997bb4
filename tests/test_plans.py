import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, resolve, shop
from tessera.plans.model import Field, RequestError, collection
from tessera.plans.search import Cache, Request, leg_weights, relaxable, run

SHOP = collection("shop", Field("brand", filterable=True, facet=True, soft=True), Field("price", "number", filterable=True, facet=True, soft=True), Field("tags", "array", facet=True, filterable=True), scopes=("tenant",), channels={"fts": 1.0, "cosine": 1.0, "recency": 0.2})


@pytest.fixture(scope="module")
def docs(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, "red shirt", [1.0, 0.0], "a", 10.0, ["x"], "t", "ready", day(1)), (2, "red shoe", [0.9, 0.1], "a", 20.0, ["x", "y"], "t", None, day(2)), (3, "blue shirt", [0.0, 1.0], "b", 30.0, None, "t", "ready", day(3)), (4, "red shirt", [1.0, 0.0], "b", 10.0, [], "t", "failed", day(4)), (5, "red shirt", [1.0, 0.0], "a", 10.0, [], "u", "ready", day(5))]
    return spark.createDataFrame(rows, "doc_id int, text string, vec array<double>, brand string, price double, tags array<string>, scope_tenant string, pipeline_status string, updated_at timestamp")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "Red SHIRT", [1.0, 0.0])], "query_id int, text string, vec array<double>")


def ids(r):
    return [x.doc_id for x in r.hits.orderBy("rank").collect()]


def test_search_sees_only_its_scope_and_what_is_ready(spark, docs, asked):
    now = F.to_timestamp(F.lit("2024-01-10"))
    r = run(docs, asked, SHOP, Request(scope={"tenant": "t"}, facets=("brand", "tags", "price")), now)
    assert ids(r) == [1, 2, 3] and [tuple(x) for x in r.facets["brand"].collect()] == [("a", 2), ("b", 1)]
    assert {x.value: x.n for x in r.facets["tags"].collect()} == {"x": 2, "y": 1} and sum(x.n for x in r.facets["price"].collect()) == 3
    assert ids(run(docs, asked, SHOP, Request(scope={"tenant": "u"}))) == [5]
    for bad in (Request(), Request(scope={"tenant": "t"}, facets=("vec",))):
        with pytest.raises(RequestError):
            run(docs, asked, SHOP, bad)
    with pytest.raises(RequestError):
        Request(limit=0)


def test_pages_groups_and_browsing(docs, asked):
    at = {"tenant": "t"}
    assert ids(run(docs, asked, SHOP, Request(scope=at, limit=1, offset=1))) == [2]
    assert ids(run(docs, asked, SHOP, Request(scope=at, group="brand"))) == [1, 3]
    assert ids(run(docs, asked, SHOP, Request(scope=at, weights={"fts": 0, "cosine": 0}))) == [3, 2, 1]
    assert ids(run(docs, asked, SHOP, Request(scope=at, floor=0.5, mode="similar"))) == [1, 2]


def test_relaxing_derived_soft_filters(docs, asked):
    ask = Request(scope={"tenant": "t"}, filters={"brand": "a", "price": {"lte": 15}}, derived=frozenset({"brand", "price"}))
    assert relaxable(docs, SHOP, ask) == ["brand", "price"]
    r = run(docs, asked, SHOP, ask)
    assert set(r.relaxed) == {"brand", "price"} and len(ids(r)) == 3
    kept = run(docs, asked, SHOP, Request(scope={"tenant": "t"}, filters={"brand": "a", "price": {"lte": 15}}))
    assert kept.relaxed == [] and ids(kept) == [1]


def test_weights_by_mode():
    assert leg_weights(SHOP, Request(mode="similar"))["fts"] == 0 and leg_weights(SHOP, Request(mode="intent"))["fts"] == 0.3
    assert leg_weights(SHOP, Request(mode="similar", weights={"fts": 2.0}))["fts"] == 2.0
    with pytest.raises(RequestError):
        leg_weights(SHOP, Request(weights={"smell": 1.0}))


def test_cache():
    now, made = [0.0], []
    c = Cache(60, 2, lambda: now[0])
    get = lambda k: c.get("c", k, lambda: made.append(k) or len(made))
    assert [get("a"), get("a")] == [1, 1]
    now[0] = 61
    assert get("a") == 2 and get("b") == 3 and get("d") == 4 and get("a") == 5
    c.drop("c")
    assert not c.kept


def test_shop(spark):
    assert shop.constraints({"inStock": True, "maxPrice": 5, "brand": "x", "note": 1}) == {"available": True, "price": {"lte": 5}, "brand": "x"}
    df = spark.createDataFrame([(0.9, 0.0), (0.2, 1.0), (0.0, 0.0)], "cos double, phone double")
    out = shop.decisive(df, {"cosine": F.col("cos"), "phone": F.col("phone")}, resolve.noisy_or, {"cosine": 0.6, "phone": 1.0}).collect()
    assert [r.decisive for r in out] == ["cosine", "phone", None]
    one = spark.range(1).select(shop.summary({"a": F.lit("x"), "b": F.lit(" "), "c": F.lit(None).cast("string"), "d": F.lit("y" * 300)}).alias("s"), shop.fresh(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("f")).first()
    assert one.s == f"a: x | d: {'y' * 240}" and one.f is False


def test_enrichment(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok"), (4, None), (5, "old")], "id int, text string")

    def generate(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [f'{{"v": "{p}"}}' for p in prompts]

    first = enrich.stage(rows.where("id = 5"), "s", F.col("text"), lambda ps: ["cached"] * len(ps)).select("key", "output")
    seen = spark.createDataFrame(first.collect(), "key string, output string")
    out = {r.id: r for r in enrich.stage(rows, "s", F.col("text"), generate, seen).collect()}
    assert out[1].output == out[3].output == '{"v": "ok"}' and out[2].failure == "ValueError: no" and out[4].output is None and out[5].output == "cached"
    fails = spark.createDataFrame([("x" if i < 6 else None,) for i in range(10)], "failure string")
    assert enrich.aborts(fails) and not enrich.aborts(fails.limit(9)) and not enrich.aborts(fails.limit(0))
    merged = spark.range(1).select(enrich.corrected(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}')).alias("m"), enrich.corrected(F.lit(None).cast("string"), F.lit('{"b": "3"}')).alias("n")).first()
    assert merged.m == '{"a":"1","b":"3"}' and merged.n == '{"b":"3"}'
    queue = spark.createDataFrame([(1, '{"confidence": 0.9, "uncertain_fields": ["x"]}'), (2, '{"confidence": 0.1}'), (3, '{"confidence": 0.9}'), (4, '{"uncertain_fields": ["y"]}'), (5, None)], "id int, enriched string")
    assert [r.id for r in enrich.review(queue).collect()] == [2, 1, 4]
    images = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id int, image_token string, indexed_at int")
    new = spark.createDataFrame([(1, "a"), (2, "z")], "id int, token string")
    assert {r.id: (r.image_token, r.indexed_at) for r in enrich.revalidated(images, new).collect()} == {1: ("a", 1), 2: ("z", None), 3: ("c", 1)}
