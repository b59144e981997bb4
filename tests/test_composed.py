"""Composed operators: matching, clusters, the whole search, presets, enrichment, stores."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import units as U
from tessera.functions.predicates import blocked, strict, verdicts
from tessera.functions.vector import clamp
from tessera.operators import dedup, enrich, metrics, resolve, search
from tessera.operators.similar import similar
from tessera.plans.model import Field, collection, default_surfaces, source, template
from tessera.plans.presets import PRESETS
from tessera.plans.search import Request, Search, run, shop_page, sweep
from tessera.sources import feeds, tables


def trigrams(s):
    return {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similarity_join_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    names = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    df = spark.createDataFrame([(i, i % 3, n) for i, n in enumerate(names)] + [(500, 0, None), (501, 0, ""), (0, 0, names[0])], "id long, scope long, name string")
    tok = df.where("name <> ''").select("id", "scope", X.word_trigrams(F.col("name")).alias("tokens")).distinct()
    got = {(r.query_id, r.entity_id): r.similarity for r in similar(tok.withColumnRenamed("id", "query_id"), tok.withColumnRenamed("id", "entity_id"), 0.3, ["scope"]).collect()}
    want = {(i, j): jaccard(trigrams(a), trigrams(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i % 3 == j % 3 and jaccard(trigrams(a), trigrams(b)) >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_people_with_all_channels(spark):
    e = spark.createDataFrame([(1, "Jon Smith", "111", [1.0, 0.0]), (2, "Smyth, John", "222", [0.0, 1.0]), (3, "Ann Lee", "333", [1.0, 1.0]), (4, None, "444", None)], "entity_id long, name string, phone string, vec array<double>")
    q = spark.createDataFrame([(10, "jon smith", None, [1.0, 0.0]), (11, "Zed", "4-4-4", None), (12, None, None, None), (13, "Lee Ann", "999", [0.0, -1.0])], "query_id long, name string, phone string, vec array<double>")
    past = spark.createDataFrame([(3, "jon smith", 0, 3)], "entity_id long, alias string, confirmed long, declined long")
    got = {(r.query_id, r.entity_id): r for r in resolve.match_people(q, e, history_=past, least=0.2).collect()}
    assert got[10, 1].nth == 1 and got[10, 1].phonetic_equal and abs(got[10, 1].combined - (1 - 0.4 * 0.75 * 0.85)) < 1e-9
    assert got[11, 4].phone_equal and got[11, 4].decision == "auto" and not any(k[0] == 12 for k in got) and got[13, 3].trigram == 1
    assert (10, 3) not in got or got[10, 3].combined < 0.3
    made, counts = resolve.match_batch(q, e, history_=past)
    assert {r.query_id: r.method for r in made.collect()} == {10: "name-exact", 11: "no-match", 12: "no-match", 13: "combined-match"} or {r.query_id: r.method for r in made.collect()}[10] == "name-exact"
    assert sum(r.n for r in counts.collect()) == 4


def test_assets_gates(spark):
    schema = "name string, brand string, size_value double, size_unit string, code string"
    e = spark.createDataFrame([(1, "olive oil", "Acme", 1.0, "l", "AB-1"), (2, "olive oil", "Zeta", 1000.0, "ml", None), (3, "olive oil", None, 5.0, "kg", None), (4, "motor", "Acme", None, None, "X-9")], f"entity_id long, {schema}")
    q = spark.createDataFrame([(10, "Olive Oil", "acme", 1000.0, "ML", None), (11, "whatever", None, 3.0, "pcs", "x-9")], f"query_id long, {schema}")
    got = {(r.query_id, r.entity_id): (round(r.combined, 3), r.brand_match, r.by_code) for r in resolve.match_assets(q, e, weights={"trigram": 0.6}, least=0.1).collect()}
    assert got == {(10, 1): (0.78, "match", False), (10, 2): (0.12, "mismatch", False), (11, 4): (1.0, "unknown", True)}
    row = spark.createDataFrame([("Olive Oil 750ML AB-12X", "Ring 3 Stones", None)], "a string, b string, c string").select(U.parsed_name(F.col("a")).alias("a"), U.parsed_name(F.col("b")).alias("b"), U.parsed_name(F.col("c")).alias("c")).first()
    assert tuple(row.a) == ("olive oil", 750.0, "ml", "AB-12X") and row.b.size_value is None and row.c.item is None


def test_decisions_and_telemetry(spark):
    m = spark.createDataFrame([(1, 7, 0.91239, 1), (1, 8, 0.5, 2), (2, 9, 0.4, 1)], "query_id long, entity_id long, combined double, nth int")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    shown = resolve.telemetry(m, at)
    d = spark.createDataFrame([(1, 8, "confirm", "2024-01-01 00:04:00"), (2, 9, "confirm", "2024-01-01 00:06:00")], "query_id long, entity_id long, outcome string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.query_id: (r.outcome, [tuple(c) for c in r.candidates]) for r in resolve.with_outcomes(shown, d).collect()}
    assert got == {1: ("ignored", [(1, 7, 0.9124), (2, 8, 0.5)]), 2: (None, [(1, 9, 0.4)])}
    s = spark.createDataFrame([("{}", 0.9, 0.5)], "scope string, auto double, suggest double")
    assert {r.scope: r.auto for r in resolve.with_thresholds(s, "x", 0.8, 0.6).collect()} == {"{}": 0.9, "x": 0.8}
    with pytest.raises(ValueError):
        resolve.with_thresholds(s, "x", 0.5, 0.6)
    a = resolve.with_aliases(s.select(F.lit(1).cast("long").alias("entity_id"), F.lit("jon").alias("alias")), spark.createDataFrame([(1, "JON!"), (2, "")], "entity_id long, name string"))
    assert [tuple(r) for r in a.collect()] == [(1, "jon")]
    rows = spark.createDataFrame([(1, 0.95), (2, 0.6), (3, 0.1)], "id long, p double").select("id", resolve.band(F.col("p")).alias("b")).collect()
    assert [r.b for r in rows] == ["match", "review", "different"]


def test_clusters_follow_the_loop(spark):
    import random

    rng = random.Random(3)
    n = 80
    records = [("s" if i % 4 else "t", i, rng.randint(0, 30)) for i in range(n)]
    edges = {i: (rng.choice([j for j in range(n) if j != i]), rng.random()) for i in range(n) if rng.random() < 0.9}
    place = {i: (s, q) for s, i, q in records}
    cluster, what = {}, {}
    for s, i, q in sorted(records, key=lambda r: (r[2], r[1])):
        j, w = edges.get(i, (None, 0.0))
        known = j in cluster and place[j][0] == s
        cluster[i] = cluster[j] if known and w >= 0.6 else i
        what[i] = "linked" if known and w >= 0.6 else "suggested" if known and w >= 0.3 else "founded"
    df = spark.createDataFrame(records, "scope string, id long, seq long")
    best = spark.createDataFrame([(i, j, w) for i, (j, w) in edges.items()], "id long, candidate long, score double")
    assert {r.id: (r.cluster, r.decision) for r in dedup.greedy(df, best, 0.6, 0.3).collect()} == {i: (cluster[i], what[i]) for i in range(n)}
    first = {i for s, i, q in records if q < 15}
    known = spark.createDataFrame([(i, cluster[i]) for i in first], "id long, cluster long")
    later = dedup.greedy(df, best, 0.6, 0.3, known=known).collect()
    assert {r.id for r in later} == set(range(n)) - first
    fixed = spark.createDataFrame([(0, 5), (5, 5)], "id long, group long")
    assert {r.id: r.cluster for r in dedup.rebuild(df, best, fixed, 0.6, 0.3).collect()}[0] == 5


def test_probes_listing_and_confirmation(spark):
    r = spark.createDataFrame([(1, "s", "red ring", [1.0, 0.0], "k"), (2, "s", "red rings", [1.0, 0.1], None), (3, "s", "tool", [0.0, 1.0], "k"), (4, "t", "red ring", [1.0, 0.0], "k"), (5, "s", None, None, "")], "id long, scope string, name string, vec array<double>, key string")
    got = {(x.id, x.candidate): (x.trigram is not None, x.cos is not None, x.exact) for x in dedup.probes(r).collect()}
    assert got == {(1, 2): (True, True, False), (2, 1): (True, True, False), (1, 3): (False, False, True), (3, 1): (False, False, True)}
    g = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 3, False), (4, 4, True)], "id long, group long, confirmed boolean")
    assert [(x.group, x.n, x.members) for x in dedup.listing(g).collect()] == [(1, 2, [1, 2])]
    done = dedup.confirm(g, spark.createDataFrame([(3,), (9,)], "id long"), spark.createDataFrame([(1,)], "group long"))
    assert {x.id: (x.group, x.confirmed) for x in done.collect()} == {1: (1, False), 2: (1, False), 3: (1, True), 4: (4, True)}
    s = dedup.suggestions(spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.5)], "id long, candidate long, score double"), r, "s")
    assert [tuple(x) for x in s.collect()] == [(1, 2, 0.5)]


COLOURS = collection("things", Field("colour", "enum", filterable=True, soft=True, facet=True), Field("price", "number", filterable=True), Field("brand", filterable=True), scopes=("tenant",))


def things(spark):
    rows = [(1, "red cotton shirt", [1.0, 0.0], "red", 10.0, "a", "t", "2024-01-01"), (2, "blue cotton shirt", [0.9, 0.1], "blue", 20.0, "a", "t", "2024-01-02"), (3, "red silk dress", [0.0, 1.0], "red", 90.0, "b", "t", "2024-01-03"), (4, "green wool hat", [0.1, 0.9], "green", 5.0, None, "t", "2024-01-04"), (5, "red shirt", [1.0, 0.0], "red", 9.0, "a", "u", "2024-01-05")]
    return spark.createDataFrame(rows, "doc_id long, text string, vec array<double>, colour string, price double, brand string, scope_tenant string, at string").withColumn("updated_at", F.to_timestamp("at")).drop("at")


def test_each_query_is_relaxed_for_itself(spark):
    docs = things(spark)
    asked = spark.createDataFrame([(1, "red cotton silk shirt dress"), (2, "blue green")], "query_id int, text string")
    ask = Request(scope={"tenant": "t"}, filters={"colour": "red"}, derived=frozenset({"colour"}), weights={"cosine": 0.0}, limit=2)
    r = run(docs, asked, COLOURS, ask)
    got = {}
    for x in r.hits.collect():
        got.setdefault(x.query_id, set()).add(x.doc_id)
    assert got == {1: {1, 3}, 2: {2, 4}} and r.relaxed == ["colour"] and r.relaxed_by == {2: ["colour"]}


def test_browsing_by_group_stays_newest_first(spark):
    asked = spark.createDataFrame([(1, "")], "query_id int, text string")
    ask = Request(scope={"tenant": "t"}, weights={"fts": 0.0, "cosine": 0.0}, group="brand")
    assert [x.doc_id for x in run(things(spark), asked, COLOURS, ask).hits.orderBy("rank").collect()] == [4, 3, 2]


def test_whole_search(spark):
    offers = spark.createDataFrame([("a", 9.5, "x"), ("a", 8.5, "y")], "brand string, cost double, vendor string")
    s = Search(things(spark), COLOURS, {"colour": ["red", "blue", "green"]}, embed=lambda x: [1.0, 0.0], judge=lambda q, ts: [1.0 if "silk" in x else 0.0 for x in ts], offers=(offers, "brand", ("cost", "vendor")))
    page, told = s.query("red cotton", Request(scope={"tenant": "t"}))
    rows = page.hits.orderBy("rank").collect()
    assert {r.doc_id for r in rows} >= {1, 3} and told["items"][0]["source"] == "deterministic" and told["degraded"]
    one = next(r for r in rows if r.doc_id == 1)
    assert [tuple(o) for o in one.offers] == [(8.5, "y"), (9.5, "x")] and one.colour == "red" and next(r for r in rows if r.doc_id == 3).offers is None
    broken = Search(things(spark), COLOURS, {}, embed=lambda x: [1.0, 0.0], judge=lambda q, ts: 1 / 0)
    assert [r.doc_id for r in broken.query("cotton", Request(scope={"tenant": "t"}))[0].hits.orderBy("rank").collect()][0] in (1, 2)
    assert [r.doc_id for r in s.similar(1, Request(scope={"tenant": "t"}, limit=1)).collect()] == [2]
    found = s.find("red cotton", {"maxPrice": 15, "brand": "a"}, Request(scope={"tenant": "t"}), strict=True)
    assert [r.doc_id for r in found.collect()] == [1]
    shown = s.explain("red cotton", Request(scope={"tenant": "t"}))
    assert "fts_rank" in shown.columns and shown.count() >= 2
    page = shop_page(page.hits.withColumn("policy_score", F.col("score")), F.when(F.col("brand") == "b", 5.0).otherwise(-1.0))
    first = page.orderBy("rank").first()
    assert first.doc_id == 3 and "fits your taste" in first.why
    grades = spark.createDataFrame([(0, 1, 3)], "query_id int, doc_id long, grade int")
    best = sweep({"words": lambda: s.explain("red cotton", Request(scope={"tenant": "t"})), "none": lambda: s.explain("green", Request(scope={"tenant": "t"}))}, grades).collect()
    assert best[0].config == "words" and best[0].ndcg > 0


def test_lexical_cover_and_counts(spark):
    docs = things(spark).select("doc_id", "text", "brand")
    q = spark.createDataFrame([(1, "red shirt"), (2, "zzz")], "query_id int, text string")
    got = [(r.doc_id, r.whole, r.density) for r in search.covered(docs, q, {"text": 1.0, "brand": 0.4}, sound=X.phonetic).orderBy("rank").collect()]
    assert got[0] == (1, True, 2.0) and got[1] == (5, True, 2.0) and {g[0] for g in got} >= {2, 3}
    fused = spark.createDataFrame([(1, 7, 1, None), (1, 8, None, 0.1)], "query_id int, doc_id long, fts_rank int, cos double")
    assert sorted(map(tuple, search.counts(fused, 0.2, q).collect())) == [(1, 2, 1), (2, 0, 0)]
    same = spark.createDataFrame([(1, 1, 0.5, "A ", "x"), (1, 2, 0.9, "a", "X"), (1, 3, 0.1, None, None), (1, 4, 0.1, "", None)], "query_id int, doc_id long, score double, title string, brand string")
    assert sorted(r.doc_id for r in search.one_each(same, "title", "brand").collect()) == [2, 3, 4]
    e = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "doc_id long, vec array<double>")
    v = spark.createDataFrame([("x", [1.0, 0.0])], "query_id string, vec array<double>")
    assert [(r.doc_id, round(r.cos, 3)) for r in search.evidence(e, v).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707)]
    assert [r.doc_id for r in search.evidence(e, v, parents=spark.createDataFrame([(2,)], "doc_id long")).collect()] == [2]


def test_policy_axes(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, True, 0.5), (1, 2, 0.0, False, 1.0)], "query_id int, doc_id long, score double, there boolean, business double")
    score = lambda **k: [round(r.policy_score, 4) for r in search.policy(hits, F.col("there"), F.col("business"), F.lit(0.0), {"business": 2.0, "availability": 1.0, "visual": 0.5, "personalization": 1.0}, **k).orderBy("doc_id").collect()]
    assert score() == [2.0, 2.0] and score(hard=("availability", "business")) == [0.25, 0.0]
    assert score(hard=("business",), visual=F.lit(2.0), personal=F.lit(-1.0)) == [-0.25, -0.5] and score(burying=False) == [2.0, 2.0]


def test_presets(spark):
    rows = [
        ({"title": "Red Dress", "price": 10}, {"category": "dresses", "confidence": 0.9}, None),
        ({"title": "Lamp"}, {"is_apparel_product": False}, "non-apparel"),
        ({"title": "x"}, {"category": "other"}, "category-other"),
        ({"title": "x", "price": 0}, {"category": "tops"}, "invalid-price"),
        ({"title": "x"}, {"confidence": 0.45}, "low-confidence"),
        ({"title": "x"}, {"uncertain_fields": ["Gender"]}, "uncertain-load-bearing"),
        ({"title": "Blue jeans"}, {"category": "tops"}, "cross-signal-disagree"),
        ({}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(d), json.dumps(e) if e else None) for i, (d, e, _) in enumerate(rows)], "id long, data string, enriched string")
    p = PRESETS["fashion"]
    got = df.select("id", p.reason().alias("r"), *[f().alias(k) for k, f in p.surfaces.items()], PRESETS["products"].reason().alias("q")).orderBy("id").collect()
    assert [r.r for r in got] == [w for *_, w in rows] and got[0].embed_doc == "Red Dress." and "Category: dresses" in got[0].rerank_doc and all(r.q is None for r in got)


def test_enrichment_to_the_end(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    store = tables.Store(spark, str(tmp_path / "store"), enrich.Enricher.SCHEMA)

    def generate(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad")
        return [json.dumps({"colour": p.split()[-1]}) for p in prompts]

    e = enrich.Enricher(store, F.concat(F.lit("colour of "), F.get_json_object("data", "$.t")), generate)
    at = lambda s: F.to_timestamp(F.lit(s))
    put = lambda *rows: e.upsert(spark.createDataFrame([(i, json.dumps({"t": x})) for i, x in rows], "id string, data string"), "s", at("2024-01-01"))
    put(("1", "a red"), ("2", "bad"))
    e.run(at("2024-01-01 01:00:00"))
    seen = {r.id: (r.status, r.attempts, r.enriched) for r in store.read().collect()}
    assert seen == {"1": ("ready", 0, '{"colour": "red"}'), "2": ("failed", 1, None)}
    put(("1", "a red"), ("2", "now blue"))
    assert {r.id: r.status for r in store.read().collect()} == {"1": "ready", "2": "dirty"}
    e.run(at("2024-01-01 02:00:00"))
    gold = spark.createDataFrame([("1", ["red"]), ("2", ["green"])], "id string, colour array<string>")
    r = e.evaluate(gold, ["colour"]).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1) and len(store.versions()) == 2
    e.remove(spark.createDataFrame([("1",)], "id string"))
    assert [x.id for x in store.read().collect()] == ["2"]
    m = metrics.macro(metrics.accuracy(gold.withColumn("got", F.array(F.lit("red"))), {"colour": (F.col("colour"), F.col("got"))})).first()
    assert (m.p, m.r, m.f1, m.macro_f1) == (0.5, 0.5, 0.5, 0.5)


def test_embedding_and_grading(spark):
    df = spark.createDataFrame([("1", "aa"), ("2", "boom"), ("3", " "), ("4", "ccc")], "id string, text string")

    def embed(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [[float(len(x))] * (2 if len(x) < 3 else 3) for x in texts]

    got = {r.id: (r.vec, r.failure is not None) for r in enrich.embedded(df.coalesce(1), F.col("text"), embed, 2).collect()}
    assert got == {"1": ([2.0, 2.0], False), "2": (None, True), "3": (None, False), "4": (None, True)}
    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("z", "a")], "query string, text string")
    cache = enrich.graded(pairs.where("query = 'z'"), lambda q, ts: [3] * len(ts)).select("key", "grade")
    got = {(r.query, r.text): (r.grade, r.sure) for r in enrich.graded(pairs, lambda q, ts: [2, "x"][: len(ts)], cache).collect()}
    assert got["z", "a"] == (3, True) and sorted(got[k] for k in (("q", "a"), ("q", "b"))) == [(0, False), (2, True)]
    assert enrich.apart("openmodel-4", "other-2") and not enrich.apart("x/openmodel-4", "openmodel-mini")


def test_tables_and_texts(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    old = spark.createDataFrame([("1", "s", "d", "h", "e")], "id string, scope string, data string, content_hash string, enriched string").withColumns({"indexed_at": ts("2024-01-01"), "enriched_at": ts("2024-01-02"), "ingested_at": ts("2024-01-01")})
    assert tables.row(old, "1").first().data == "d" and {r.id: r.indexed for r in tables.index_status(old, spark.createDataFrame([("1",), ("2",)], "id string")).collect()} == {"1": True, "2": False}
    assert tables.stale(old).count() == 1 and tables.oldest(old, 1, F.lit(True)).count() == 1
    made = tables.with_indexed(old, spark.createDataFrame([("1", "text")], "id string, doc string"), ts("2024-01-03"))
    assert made.first().doc == "text" and tables.stale(made).count() == 0
    done = tables.with_enrichment(old, spark.createDataFrame([("1", None, "boom")], "id string, output string, failure string"), ts("2024-01-04")).first()
    assert done.enriched == "e" and done.failure == "boom"
    ev = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, t string")
    assert [tuple(r) for r in tables.with_evidence(ev, ev.limit(0), spark.createDataFrame([(1,)], "id long")).collect()] == [(2, "b")]
    ent = tables.upsert_entities(spark.createDataFrame([("x", "Old", "1"), ("y", "Kept", "2")], "external_id string, name string, phone string"), spark.createDataFrame([("x", "Néw", None)], "external_id string, name string, phone string"))
    assert {r.external_id: (r.name_normalised, r.phone) for r in ent.collect()} == {"x": ("new", None), "y": ("kept", "2")}
    cache = spark.createDataFrame([("k", "v", "2024-01-01"), ("k", "w", "2024-01-03"), ("l", "v", "2020-01-01")], "key string, value string, at string").withColumn("at", F.to_timestamp("at"))
    assert [(r.key, r.value) for r in tables.unexpired(cache, ts("2024-01-05"), 7).collect()] == [("k", "w")]
    page = spark.createDataFrame([(json.dumps({"products": [{"id": 1, "title": "t", "tags": "a, b,"}, {"id": 2, "title": "u", "tags": ["c"]}]}),)], "value string")
    tags = {json.loads(r.data)["title"]: json.loads(r.data).get("tags") for r in feeds.shopify(page, "x").collect()}
    assert tags == {"t": ["a", "b"], "u": ["c"]}
    row = spark.createDataFrame([(float("inf"), "A-b C", None, ["X", None], "t", "blue shirts")], "n double, a string, b string, l array<string>, title string, c string")
    got = row.select(clamp(F.col("n")).alias("n"), X.canonical(F.col("a"), {"ABC": "z"}).alias("c"), X.first_filled(F.col("b"), F.col("title")).alias("f"), X.known_values({"l": True, "b": False, "title": False}).alias("k"), X.overlaps(F.col("l"), F.array(F.lit("x"))).alias("o"), X.quantity(F.lit(-1), F.lit(12)).alias("q"), X.bigrams(F.lit("a b c")).alias("w"), blocked(["c"], ["shirt"]).alias("x"), blocked(["c"], ["SHIRTS"]).alias("y"), source("b|title").alias("s"), template("$title of $c!").alias("t"), strict(verdicts({"p": F.lit(True), "u": F.lit(None).cast("boolean")})).alias("v")).first()
    assert got.asDict() == {"n": 0.0, "c": "z", "f": "t", "k": ["x", "t"], "o": True, "q": 12.0, "w": ["a b", "b c"], "x": False, "y": True, "s": "t", "t": "t of blue shirts!", "v": False}
    assert X.image_hash(b"") == "00001505" and default_surfaces(COLOURS)["doc"] is not None
    assert metrics.gate(spark.createDataFrame([(0.9, 0.2)], "ndcg double, bad double"), {"ndcg": 0.95}, {"bad": 0.1}).first().failed == ["ndcg", "bad"]
