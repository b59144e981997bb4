"""Steps whose cost once followed something other than their input."""

import random

import pytest

from tessera.operators import dedup


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_low_cosines_need_no_buckets(spark, monkeypatch):
    """at 0.4 buckets take hundreds of bands; products of blocks give every pair of each length, in any order of ids."""
    monkeypatch.setattr(dedup, "buckets", lambda *_: pytest.fail("buckets at a low cosine"))
    rng = random.Random(5)
    vecs = {f"k{rng.randrange(10**6)}": [rng.gauss(0, 1) for _ in range(8 if i % 3 else 5)] for i in range(120)}
    odd = [("null", None, 0), ("zero", [0.0] * 8, 0), ("none", [], 0), ("nan", [float("nan")] * 8, 0), (None, [1.0] * 8, 0), ("huge", [1e200] * 8, 7)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(vecs.items())] + odd, "id string, vec array<double>, n int")
    vecs["huge"] = [1.0] * 8
    n = {k: i for i, k in enumerate(vecs)} | {"huge": 7}
    rows = dedup.near_pairs(df, 0.4, "n").collect()
    want = {(a, b): cosine(x, y) for a, x in vecs.items() for b, y in vecs.items() if a < b and len(x) == len(y) and cosine(x, y) >= 0.4}
    assert {(r.a, r.b): pytest.approx(r.cos) for r in rows} == want and len(rows) == len(want)
    assert all((r.n_a, r.n_b) == (n[r.a], n[r.b]) for r in rows)


def test_tasks_link_nodes_once(spark):
    """of a task's links at most one for each node goes on, with the same components."""
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2], "a long, b long").repartition(2)
    few = dedup.forests(edges, most=50)
    assert few.count() <= 2 * 38
    assert {tuple(r) for r in dedup.components(edges).collect()} == {(i, i % 2) for i in range(40)}


def test_words_are_counted_in_matrices(spark, monkeypatch):
    """no pair of document and query goes through an aggregation; ids that several rows share add up all the same."""
    from tessera.operators import search

    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["été"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), rng.choice(words)) for i in range(400)] + [(400, None, None), (401, "", "W1"), (402, "W2, w2!", None)]
    asked = [(q, text(6)) for q in range(7)] + [(7, None), (8, "--"), (9, "unknown")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    monkeypatch.setattr(search, "MATRIX_DOCS", 32)
    plain = search._plain_hits
    for extra in ([], [(5, "w1 w2 w3", "w4"), (5, "w1 w9", None), (None, "w1", None), (None, "w2 w1", "w1")]):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, source string")
        seen = []
        monkeypatch.setattr(search, "_plain_hits", lambda *a: seen.append(1) or plain(*a))
        got = [sorted(map(tuple, f.collect()), key=str) for f in (search.lexical(docs, queries, 9), search.covered(docs, queries, {"text": 1.0, "source": 0.4}, 9))]
        assert bool(seen) == bool(extra)
        monkeypatch.setattr(search, "MATRIX_ROWS", 0)
        assert got == [sorted(map(tuple, f.collect()), key=str) for f in (search.lexical(docs, queries, 9), search.covered(docs, queries, {"text": 1.0, "source": 0.4}, 9))]
        monkeypatch.setattr(search, "MATRIX_ROWS", 2000)


def test_words_are_hashed_once(spark):
    """one expression that hashes words, and not one for each dimension; both ways of finding the slot agree."""
    from pyspark.sql import functions as F

    from tessera.functions import text as X

    df = spark.createDataFrame([("a b a, Été",), ("",), (None,)], "text string")
    wide = df.select(X.stub_embedding(F.col("text"), 8).alias("v"), X.stub_embedding(F.col("text"), 24).alias("w")).collect()
    for r in wide[:2]:
        assert [sum(r.w[i::8]) for i in range(8)] == r.v and sum(r.v) in (4, 0)
    plan = df.select(X.stub_embedding(F.col("text"))).schema, df.select(X.stub_embedding(F.col("text")))._jdf.queryExecution().analyzed().toString()
    inner = plan[1][plan[1].index("transform(sequence("):]
    assert "md5" not in inner.split("array(")[0]


def test_a_text_is_looked_through_once(spark):
    """the text that may name a category is put together once, and not for each word that it may name."""
    from pyspark.sql import functions as F

    from tessera.plans.presets import named_category

    df = spark.createDataFrame([("a Blue COAT",), ("shoe and shirt",), ("cup",), (None,)], "data string")
    out = df.select(named_category(F.concat(F.lit("x "), F.col("data"))).alias("c"))
    assert [r.c for r in out.collect()] == ["outerwear", "tops", None, None]
    assert out._jdf.queryExecution().analyzed().toString().count("concat(") == 1


def test_assets_are_compared_by_name(spark, monkeypatch):
    """names are compared once for each two of a scope, and the answer is that of all pairs."""
    from tessera.operators import resolve

    rng = random.Random(8)
    names, brands, units = ["red ring", "red bolt", "blue ring", "Red  RING!", "", None], ["a", "A", "b", "c", None], ["cm", "mm", "kg", None]
    row = lambda i, key: (i, rng.choice(names), rng.choice(brands), rng.choice([1.0, 10.0, None]), rng.choice(units), rng.choice(["", None, f"c{i % 9}", f"C{i % 9}"]), rng.choice(["s", "t", None]))
    side = lambda n, key: spark.createDataFrame([row(i, key) for i in range(n)] + [row(3, key)], f"{key} long, name string, brand string, size_value double, size_unit string, code string, scope string")
    q, e = side(150, "query_id"), side(150, "entity_id")
    seen, similar = [], resolve.similar
    monkeypatch.setattr(resolve, "similar", lambda left, right, *a: seen.append(left.count()) or similar(left, right, *a))
    run = lambda: sorted((r.query_id, r.entity_id, round(r.combined, 9), r.brand_match, r.by_code, r.nth) for r in resolve.match_assets(q, e, ["scope"], weights={"trigram": 0.9}, keep=3).collect())
    got = run()
    assert seen and max(seen) <= 3 * 3 and len(got) > 100  # three names in three scopes
    monkeypatch.setattr(resolve, "_assets_by_name", resolve._assets_by_pair)
    assert got == run()
