import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as X
from tessera.functions.vector import clamp, cosine, recency, unit
from tessera.operators import pricing
from tessera.plans.model import Field, RequestError, collection, evolution, first_filled, project, surfaces, template
from tessera.plans.nlq import budget, same, understand, within


def one(spark, *columns, **values):
    return tuple(spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(*columns).first())


def test_text(spark):
    assert one(spark, X.normalise(F.lit("  Crème-brûlée, N°5! ")), X.strip_html(F.lit("<p>a&amp;b</p> c"))) == ("creme brulee n°5", "a b c")
    a, b, c, d = one(spark, *[X.phonetic(F.lit(n)) for n in ("Amma", "අම්මා", "அம்மா", "Maaladhi")])
    assert a == b == c == "N" and d == one(spark, X.phonetic(F.lit("Maaladi")))[0]
    assert one(spark, X.phonetic(F.lit(None).cast("string")), X.phonetic_tokens(F.lit("Kumar Perera"))) == ("", "KNR PR")
    assert one(spark, X.half_up(F.lit(-2.5), 0), X.half_up(F.lit(2.345), 2), X.half_up(F.lit(0.5), 0)) == (-2.0, 2.35, 1.0)


def test_trigrams_against_sets(spark):
    rng = random.Random(0)
    grams = lambda s: {f" {s.lower()} "[i : i + 3] for i in range(max(1, len(s)))}
    for _ in range(15):
        a, b = ("".join(rng.choice("abC ") for _ in range(rng.randint(0, 8))) for _ in range(2))
        want = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        assert abs(one(spark, X.trigram_similarity(F.lit(a), F.lit(b)))[0] - want) < 1e-9


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, cosine(v(1.0, 0.0), v(1.0, 1.0)))[0] == pytest.approx(math.sqrt(0.5))
    assert one(spark, cosine(v(0.0, 0.0), v(1.0, 1.0)), cosine(v(1.0), v(1.0, 2.0))) == (0.0, None)
    assert one(spark, unit(v(3.0, 4.0)), unit(v(0.0, 0.0))) == ([0.6, 0.8], [0.0, 0.0])
    assert one(spark, clamp(F.lit(float("nan"))), clamp(F.lit(2.0)), clamp(F.lit(None).cast("double"))) == (0.0, 1.0, 0.0)
    assert one(spark, recency(F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-11")), 10.0))[0] == pytest.approx(0.5)


ITEMS = collection("items", Field("name", filterable=True, searchable=True), Field("price", "number", filterable=True, soft=True), Field("colours", "array", filterable=True), Field("hidden"), Field("note", path="enriched.a.b"), scopes=("tenant",))


@pytest.mark.parametrize("filters", [{"nope": 1}, {"hidden": "x"}, {"price": {"gt": "5"}}, {"price": {"gt": True}}, {"name": {"like": "x"}}, {"name": {"in": "x"}}, {"name": {"exclude": ["x"]}}, {"price": {"not": "x"}}])
def test_requests_that_are_mistakes(filters):
    with pytest.raises(RequestError):
        P.where(filters, ITEMS)


def test_predicates_with_nulls(spark):
    df = spark.createDataFrame([(1, "a.b", 5.0, ["red", None]), (2, None, None, None), (3, "AxB", 7.0, []), (4, "50%", 9.0, ["blue"])], "id int, name string, price double, colours array<string>")
    ids = lambda f, **k: sorted(r.id for r in df.where(P.where(f, ITEMS, **k)[0]).collect())
    assert ids({"name": {"ne": "AxB"}}) == [1, 2, 4] and ids({"name": {"nin": ["AxB", "50%"]}}) == [1, 2]
    assert ids({"name": {"not": "A.b"}}) == [2, 3, 4] and ids({"name": {"contains": "a"}}) == [1, 3]
    assert ids({"colours": ["red"]}) == [1] and ids({"colours": {"exclude": ["red"]}}) == [3, 4] and ids({"colours": {"eq": ["blue"]}}) == [4]
    assert ids({"price": {"gte": 7}}) == [3, 4] and ids({"price": {"gte": 7}}, skip_soft=True) == [1, 2, 3, 4]
    assert P.where({"price": 5}, ITEMS)[1] == ["price"] and ids({}) == [1, 2, 3, 4] and ids({"name": []}) == []
    with pytest.raises(RequestError):
        P.scoped({}, ITEMS)
    v = df.select(P.verdicts({"cheap": F.col("price") < 6}).alias("v")).collect()
    assert [r.v["cheap"] for r in v] == ["satisfied", "unknown", "violated", "violated"]


def test_projection_and_surfaces(spark):
    df = spark.createDataFrame([("1", '{"name": "x", "price": "12.5", "colours": ["a"], "tenant": "t"}', '{"a": {"b": "n"}}'), ("2", '{"price": "cheap", "colours": "a,b"}', None), ("3", None, None)], "id string, data string, enriched string")
    rows = project(df, ITEMS).collect()
    assert [(r.name, r.price, r.colours, r.note, r.scope_tenant) for r in rows] == [("x", 12.5, ["a"], "n", "t"), (None, None, ["a", "b"], None, None), (None, None, None, None, None)]
    assert project(df, ITEMS).drop("id").dtypes == [(f.name, f.dataType.simpleString()) for f in ITEMS.schema][1:]
    out = surfaces(project(df, ITEMS), {"doc": template("$name by  $note")}, F.col("price") > 1).collect()
    assert [(r.pipeline_status, r.gate_reason) for r in out] == [("ready", None), ("quarantined", "gate"), ("quarantined", "gate")]
    assert one(spark, first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit("z")))[0] == "z"


def test_declarations():
    for bad in (lambda: Field("1x"), lambda: Field("x", "money"), lambda: collection("c", Field("a"), Field("A"))):
        with pytest.raises(RequestError):
            bad()
    new = collection("items", Field("name", "number"), Field("price", "number", path="cost"), Field("extra"), scopes=())
    assert evolution(ITEMS, new) == {"additions": ["extra"], "reindex": ["price"], "destructive": ["colours", "hidden", "note", "name", "scope tenant"]}


def test_formula(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    for text, want in (("1 + 2 * a", 5.0), ("-(a - 5) / 2", 1.5), ("a / b", None), ("2 - 3 - 4", -5.0), (".5 * a", 1.0)):
        assert df.select(pricing.formula(text)).first()[0] == want
    for bad in ("1 +", "(1", "a b", "1; drop", "exp(a)", "1" * 501, "(" * 120 + "1" + ")" * 120):
        with pytest.raises(ValueError):
            pricing.formula(bad)


def test_understanding():
    values = {"colours": ["red", "dark red", "blue"], "name": ["shirt", "blue"]}
    got = understand("Dark red shirts, not blue and no RED shoes", collection("c", Field("colours", "array"), Field("name")), values)
    assert got.filters == {"colours": ["dark red"], "name": ["shirt"]} and got.excluded == {"colours": ["red"]} and got.rest == "not blue and shoes"
    assert [budget("ab", "abc"), budget("abcd", "abcde"), budget("abcdef", "abcdefg")] == [0, 1, 2]
    assert within("kitten", "sitting", 3) and not within("kitten", "sitting", 2) and same("boxes", "box") and not same("bus", "bu1")
