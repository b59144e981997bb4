import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, metrics, resolve, search
from tessera.sources import feeds, tables
from tessera.streaming import changes


def loop_cutoff(hits, max_drop, min_anchor):
    if not any(h[1] for h in hits):
        cos = [h[2] for h in hits if h[2] is not None]
        if cos and max(cos) < min_anchor:
            return []
    base = cliff = None
    for rank, fts, cos in hits:
        if cos is None:
            continue
        if fts:
            base = cos if base is None else max(base, cos)
            continue
        if base is not None and cos < base * (1 - max_drop):
            cliff = rank
            break
        base = cos
    return [h[0] for h in hits if cliff is None or h[0] < cliff or h[1]]


def test_score_drop_against_a_loop(spark):
    rng = random.Random(3)
    lists = {q: [(r, rng.random() < 0.3, None if rng.random() < 0.15 else round(rng.random(), 3)) for r in range(1, rng.randint(2, 12))] for q in range(300)}
    df = spark.createDataFrame([(q, 100 * q + r, r, f, c) for q, hits in lists.items() for r, f, c in hits], "query_id int, doc_id int, rank int, fts boolean, cos double")
    got = {}
    for r in search.score_drop(df).collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert {q: sorted(got.get(q, [])) for q in lists} == {q: loop_cutoff(h, 0.5, 0.3) for q, h in lists.items()}


def test_fusion_is_the_outer_join(spark):
    rng = random.Random(1)
    legs = {n: {(q, d): r for q in range(5) for r, d in enumerate(rng.sample(range(30), 12), 1)} for n in ("a", "b", "c")}
    frame = lambda leg: spark.createDataFrame([(q, d, r) for (q, d), r in leg.items()], "query_id int, doc_id int, rank int")
    got = {(r.query_id, r.doc_id): r for r in search.fuse({n: (frame(v), w) for (n, v), w in zip(legs.items(), (1.0, 0.5, 0.25))}).collect()}
    for key in {k for v in legs.values() for k in v}:
        assert got[key].score == pytest.approx(sum(w / (60 + v[key]) for v, w in zip(legs.values(), (1.0, 0.5, 0.25)) if key in v))
        assert got[key].a_rank == legs["a"].get(key)


def test_relaxation():
    left = {(): 1, ("x",): 2, ("x", "y"): 5}
    assert search.relax(lambda d: left[tuple(d)], ["x", "y", "z"], 3) == (["x", "y"], 5)


def test_diversify_keeps_those_without_group(spark):
    df = spark.createDataFrame([(1, 1, 0.9, "g"), (1, 2, 0.8, "g"), (1, 3, 0.7, None), (1, 4, 0.6, ""), (1, 5, 0.6, "")], "query_id int, doc_id int, score double, g string")
    assert sorted(r.doc_id for r in search.diversify(df, "g").collect()) == [1, 3, 4, 5]


def test_greedy_against_a_loop(spark):
    rng = random.Random(2)
    rows = [("s" if i % 2 else "t", i, rng.randint(0, 50)) for i in range(60)]
    edges = [(i, c, rng.random()) for _, i, _ in rows if rng.random() < 0.8 and (c := rng.choice([j for j in range(60) if j % 2 == i % 2 and j != i])) is not None]
    got = {r.id: (r.cluster, r.decision) for r in dedup.greedy(spark.createDataFrame(rows, "scope string, id long, seq int"), spark.createDataFrame(edges, "id long, candidate long, score double")).collect()}
    best, cluster, want = {i: (c, s) for i, c, s in edges}, {}, {}
    for _, i, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        c, s = best.get(i, (None, 0))
        known = c in cluster
        cluster[i] = cluster[c] if known and s >= 0.7 else i
        want[i] = (cluster[i], "linked" if known and s >= 0.7 else "suggested" if known and s >= 0.4 else "founded")
    assert got == want


def test_split_and_declined(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "id int, group int")
    kept, pairs = dedup.split(groups, spark.createDataFrame([(1,)], "id int"))
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (2, 2), (3, 2), (9, 9)] and sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)]
    left = dedup.without_declined(spark.createDataFrame([(1, 2), (3, 1), (2, 3)], "a int, b int"), spark.createDataFrame([(2, 1), (1, 3)], "a int, b int"))
    assert [tuple(r) for r in left.collect()] == [(2, 3)]


def test_near_pairs_miss_nothing_and_take_nulls(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    vecs = [(i, [x + rng.gauss(0, 0.1) for x in base[i % 10]]) for i in range(60)] + [(100, None), (101, [0.0] * 16), (102, [])]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(vecs, "id long, vec array<double>"), 0.95).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == {(i, j) for i, a in vecs[:60] for j, b in vecs[:60] if i < j and dot(a, b) >= 0.95 * (dot(a, a) * dot(b, b)) ** 0.5}


def test_thresholds_and_history(spark):
    scopes = spark.createDataFrame([("a",), ("b",)], "scope string")
    rules = spark.createDataFrame([("a", 0.9, 0.5), ("{}", 0.8, 0.4)], "scope string, auto double, suggest double")
    assert {r.scope: (r.auto, r.suggest) for r in resolve.thresholds(scopes, rules).collect()} == {"a": (0.9, 0.5), "b": (0.8, 0.4)}
    assert {r.scope: r.auto for r in resolve.thresholds(scopes, rules.limit(0)).collect()} == {"a": 0.92, "b": 0.92}
    old = spark.createDataFrame([("k", 1, 0)], "k string, confirmed long, declined long")
    new = spark.createDataFrame([("k", "decline"), ("m", "confirm"), ("m", "confirm")], "k string, outcome string")
    assert sorted(map(tuple, resolve.history(old, new, ["k"]).collect())) == [("k", 1, 1), ("m", 2, 0)]


def test_metrics_by_hand(spark):
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (2, 1, 2), (2, 2, 1)], "query_id int, rank int, grade int")
    got = {r.query_id: round(r.ndcg, 4) for r in metrics.ndcg(judged).collect()}
    assert got == {1: 0.6309, 2: 1.0} and {r.query_id: (r.mrr, r.hit) for r in metrics.reciprocal(judged, 2, 1).collect()} == {1: (0.5, 0), 2: (1.0, 1)}
    lat = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 3, 9)], "ms double")
    assert [r.value for r in metrics.lower_percentiles(lat, F.col("ms"), 0, 50, 95, 100).orderBy("percent").collect()] == [1.0, 3.0, 5.0, 9.0]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "data": {"title": "one", "price": 3}}\n{"data": {"external_id": 2, "title": "two"}}\n{"id": "3", "data": {}}\nnot json\n')
    (tmp_path / "s.json").write_text('{"products": [{"id": 7, "title": "Shirt", "handle": "shirt", "body_html": "<b>ok</b>", "tags": ["x"], "variants": [{"price": "9.50", "available": false}, {"price": "1", "available": true}], "images": [{"src": "i"}]}, {"id": 8}]}')
    (tmp_path / "w.json").write_text('[{"id": 1, "name": "Mug", "prices": {"price": "1250", "currency_minor_unit": 2}, "is_in_stock": true, "categories": [{"name": "a"}, {"name": "b"}]}]')
    kinds = [{"kind": "jsonl", "path": str(tmp_path / "a.jsonl")}, {"kind": "shopify", "path": str(tmp_path / "s.json"), "shop": "shop.example.com"}, {"kind": "woocommerce", "path": str(tmp_path / "w.json")}]
    rows = {r.id: r.data for r in feeds.pull(spark, kinds).collect()}
    assert set(rows) == {"1", "2", "7"} and '"one"' in rows["1"] and '"available":true' in rows["7"] and '"price":9.5' in rows["7"] and "shop.example.com/products/shirt" in rows["7"]
    assert '"price":12.5' in feeds.woo(spark.read.text(kinds[2]["path"], wholetext=True)).first().data
    with pytest.raises(ValueError):
        feeds.pull(spark, [{"kind": "fax"}])
    sheet = spark.createDataFrame([(0, ["Quote", "", ""]), (1, ["Part Number", " Qty ", "x"]), (2, ["A1", "2", ""]), (3, ["", "5", ""]), (4, ["B2", "0", ""])], "seq int, cells array<string>")
    assert [(r.sku, r.qty) for r in feeds.grid(sheet, {"sku": ["sku", "part number"], "qty": ["qty"]}, ["sku", "qty"]).collect()] == [("A1", "2")]


def test_upsert_delete_dirty(spark):
    schema = "id string, scope string, data string, content_hash string, enriched string, indexed_at timestamp, ingested_at timestamp"
    now = F.to_timestamp(F.lit("2024-01-01"))
    old = spark.createDataFrame([("1", "s", "a", "h1", "e", None, None), ("2", "s", "b", "h2", "e", None, None)], schema)
    new = spark.createDataFrame([("1", "s", "a", "h1"), ("2", "s", "c", "h3"), ("4", "s", "d", "h4")], "id string, scope string, data string, content_hash string")
    assert {r.id: (r.data, r.enriched) for r in tables.upsert(old, new, now).collect()} == {"1": ("a", "e"), "2": ("c", None), "4": ("d", None)}
    with pytest.raises(Exception, match="another scope"):
        tables.upsert(old, new.withColumn("scope", F.lit("z")), now).collect()
    assert tables.delete(old, new.limit(1), "s").count() == 1 and tables.delete(old, new, "z").count() == 2
    assert sorted(r.id for r in tables.dirty(new, old).collect()) == ["2", "4"]
    assert {r.attempts: (r.status, r.due is None) for r in tables.after_failure(spark.createDataFrame([(0,), (4,)], "attempts int"), now).collect()} == {1: ("failed", False), 5: ("dead", True)}


def events(spark):
    rows = [("a", "upsert", {"t": "1", "p": "5"}, 1, 1), ("a", "price", {"p": "6"}, 2, 2), ("b", "upsert", {"t": "2"}, 1, 3), ("b", "delete", None, 3, 4), ("c", "delete", None, 1, 5), ("c", "image", {"i": "x"}, 2, 6), ("d", "inventory", {"n": "0"}, 1, 7)]
    return spark.createDataFrame(rows, "id string, kind string, data map<string,string>, ts int, event_id int")


def test_change_events_in_one_batch_or_many(spark, tmp_path):
    empty = spark.createDataFrame([("c", {"old": "1"}, False), ("d", {"t": "9"}, False)], "id string, data map<string,string>, needs_reindex boolean")
    plain = lambda df: {r.id: (r.data, r.needs_reindex) for r in df.collect()}
    whole = plain(changes.apply(empty, events(spark)))
    assert whole == {"a": ({"t": "1", "p": "6"}, True), "c": ({"i": "x"}, True), "d": ({"t": "9", "n": "0"}, False)}
    state = empty
    for ts in (1, 2, 3):
        state = changes.apply(state, events(spark).where(F.col("ts") == ts))
    assert plain(state) == whole


def test_change_events_as_a_stream(spark, tmp_path):
    for ts in (1, 2, 3):
        events(spark).where(F.col("ts") == ts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = changes.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = {r.id: r.data for r in spark.read.parquet(str(tmp_path / "out" / f"v={last}")).collect()}
    assert got == {"a": {"t": "1", "p": "6"}, "c": {"i": "x"}, "d": {"n": "0"}}


def test_vocabulary_of_changes(spark):
    df = spark.createDataFrame([("f", None, "x"), ("f", "x", "y"), ("f", None, "x")], "field string, old string, new string")
    assert {r.value: r.n for r in changes.vocabulary(df).collect()} == {"x": 1, "y": 1}
