"""Named queries of search, gates, tables and work lists, with DuckDB's SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import enrich, search
from tessera.plans.presets import PRESETS
from tessera.queries import _CENTRES, _COS, _HYB, _LEX, _TOK, _centres, _fused, _hits, _lexical, _questions, _vectors, query, t
from tessera.sources import tables

_DOCS = f"qt AS (SELECT item_id AS query_id, len(list_distinct({_TOK.format('text')})) AS asked, unnest(list_distinct({_TOK.format('text')})) AS token FROM benchmark), dt AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS token, 1.0 AS w FROM documents UNION ALL SELECT doc_id, unnest(list_distinct({_TOK.format('source')})), 0.4 FROM documents)"


@query(f"WITH {_DOCS}, m AS (SELECT doc_id, token, max(w) AS w FROM dt GROUP BY 1, 2), h AS (SELECT query_id, doc_id, count(*) = max(asked) AS whole, round(sum(w)::DOUBLE, 6) AS density FROM m JOIN qt USING (token) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, density DESC, doc_id) AS rank FROM h) WHERE rank <= 50")
def lexical_cover(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", "text", "source")
    out = search.covered(docs, _questions(spark, folder), {"text": 1.0, "source": 0.4}, keep=50)
    return out.select("query_id", "doc_id", "whole", F.round("density", 6).alias("density"), "rank")


@query(f"WITH {_HYB}, c AS (SELECT query_id, count(*) AS candidates, count_if(fts_rank IS NOT NULL OR coalesce(cos >= 0.2, false)) AS eligible FROM fused GROUP BY 1) SELECT q.query_id, coalesce(candidates, 0) AS candidates, coalesce(eligible, 0) AS eligible FROM (SELECT item_id AS query_id FROM benchmark UNION SELECT -1) q LEFT JOIN c ON c.query_id = q.query_id")
def candidate_counts(spark, folder):
    asked = _questions(spark, folder).select("query_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id")))
    return search.counts(_fused(spark, folder), 0.2, asked)


@query(
    f"WITH {_HYB}, n AS (SELECT h.*, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS rel FROM hits h WINDOW w AS (PARTITION BY query_id))"
    " SELECT query_id, n.doc_id, round(pow(rel, 1.5) * CASE WHEN coalesce(quality = 1, true) THEN 1.0 ELSE 0.2 END * pow((n.doc_id % 10) / 10.0::DOUBLE, 0.5) + 0.1 * least(greatest(coalesce(cos, 0), 0), 1) - 0.35 * (n.doc_id % 2), 6) AS policy_score FROM n LEFT JOIN labels l ON l.doc_id = n.doc_id"
)
def ranking_hard_business(spark, folder):
    hits = _hits(spark, folder).join(t(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    weights = {"business": 0.5, "visual": 0.1, "personalization": 0.35}
    out = search.policy(hits, F.col("quality") == 1, (F.col("doc_id") % 10) / 10.0, F.lit(0.0), weights, exponent=1.5, visual=F.coalesce("cos", F.lit(0.0)), personal=-(F.col("doc_id") % 2).cast("double"), hard=("business",))
    return out.select("query_id", "doc_id", F.round("policy_score", 6).alias("policy_score"))


@query(f"WITH {_CENTRES}, s AS (SELECT c.query_id, e.vec_id % 100 AS doc_id, max({_COS.format('e.embedding', 'c.vec')}) AS cos FROM embeddings e, cent c WHERE (e.vec_id % 100) % 3 = 1 GROUP BY 1, 2) SELECT query_id, doc_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM s")
def evidence_of_parents(spark, folder):
    parts = t(spark, folder, "embeddings").select((F.col("vec_id") % 100).alias("doc_id"), F.col("embedding").alias("vec"))
    parents = spark.range(100).select(F.col("id").alias("doc_id")).where("doc_id % 3 = 1")
    return search.evidence(parts, _centres(spark, folder), parents=parents).select("query_id", "doc_id", F.round("cos", 6).alias("cos"), "rank")


@query(f"WITH {_LEX}, h AS (SELECT l.query_id, l.doc_id, l.overlap, lower(trim(coalesce(d.source, ''))) || '|' || lower(trim(coalesce(d.lang, ''))) AS k FROM lex l JOIN documents d USING (doc_id)) SELECT query_id, doc_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY overlap DESC, doc_id) AS nth FROM h) WHERE nth = 1 OR k = '|'")
def one_of_each_identity(spark, folder):
    named = t(spark, folder, "documents").select("doc_id", "source", "lang")
    hits = search.attached(_lexical(spark, folder), named, "source", "lang").withColumn("score", F.col("overlap"))
    return search.one_each(hits, "source", "lang").select("query_id", "doc_id", "overlap")


@query(f"WITH {_LEX.replace('unnest(list_distinct(' + _TOK.format('text') + ')) AS token FROM documents)', 'unnest(list_distinct(' + _TOK.format('text') + chr(41) + ') AS token FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, doc_id, overlap, rank FROM lex WHERE rank <= 10")
def bag_of_words(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", "text", "lang")
    return search.bag_search(docs, _questions(spark, folder), F.col("lang") == "en")


@query(
    r"WITH m AS (SELECT doc_id, string_split_regex(text, '[0-9]{16}') AS s, regexp_extract_all(text, '[0-9]{16}') AS f FROM documents), e AS (SELECT doc_id, s, f, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0)"
    " SELECT doc_id, i::INT AS nth, right(s[i], 30) || f[i] || left(s[i + 1], 30) AS context FROM e WHERE i <= 50"
)
def grep_contexts(spark, folder):
    return search.grep(t(spark, folder, "documents"), "[0-9]{16}").select("doc_id", "nth", "context")


@query("SELECT event_id AS id, value / 100 AS confidence FROM events WHERE (value < 10 OR event_id % 9 = 0) AND value IS NOT NULL ORDER BY value / 100, event_id LIMIT 100")
def review_uncertain(spark, folder):
    made = F.struct((F.col("value") / 100).alias("confidence"), F.when(F.col("event_id") % 9 == 0, F.array(F.lit("colour"))).otherwise(F.array().cast("array<string>")).alias("uncertain_fields"))
    rows = t(spark, folder, "events").where("value is not null").select(F.col("event_id").alias("id"), F.to_json(made).alias("enriched"))
    return enrich.review(rows, 0.1).select("id", "confidence")


@query(
    "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'non-apparel' WHEN p_size % 7 = 0 THEN 'category-other' WHEN p_retailprice - 905 <= 0 THEN 'invalid-price' WHEN p_size < 10 THEN 'low-confidence' WHEN p_size % 5 = 0 THEN 'uncertain-load-bearing' WHEN p_size % 3 = 1 THEN 'cross-signal-disagree' END AS fashion,"
    " CASE WHEN p_size < 8 THEN 'low-confidence' END AS products FROM part"
)
def index_gates(spark, folder):
    # A part is few bytes and much work: spread by rows, not by the bytes of the file.
    parts = t(spark, folder, "part").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    size = F.col("p_size")
    data = F.to_json(F.struct(F.concat("p_name", F.lit(" coat")).alias("title"), (F.col("p_retailprice") - 905).alias("price")))
    category = F.when(size % 7 == 0, "other").when(size % 3 == 1, "tops").otherwise("outerwear")
    enriched = F.to_json(F.struct((size % 11 != 0).alias("is_apparel_product"), category.alias("category"), (size / 20).alias("confidence"), F.when(size % 5 == 0, F.array(F.lit("Colors"))).alias("uncertain_fields")))
    rows = parts.select("p_partkey", data.alias("data"), enriched.alias("enriched"))
    return rows.select("p_partkey", PRESETS["fashion"].reason().alias("fashion"), PRESETS["products"].reason().alias("products"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderdate < TIMESTAMP '1998-01-01'")
def stale_rows(spark, folder):
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp"))
    rows = t(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), at.alias("indexed_at"), F.to_timestamp(F.lit("1998-01-01")).alias("enriched_at"))
    return tables.stale(rows).select("id")


@query("SELECT user_id AS key, max(event_id) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last, (SELECT max(ts) FROM events) AS now FROM events) WHERE ts = last AND epoch(now) - epoch(ts) < 7 * 86400 GROUP BY 1")
def unexpired_entries(spark, folder):
    e = t(spark, folder, "events")
    now = F.lit(e.agg(F.max("ts").alias("m")).first().m)
    return tables.unexpired(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("at")), now, 7).select("key", "value")


@query("SELECT c_custkey::VARCHAR AS external_id, c_mktsegment AS name, trim(regexp_replace(lower(c_mktsegment), '[[:punct:]]+', ' ', 'g')) AS name_normalised FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey::VARCHAR, c_name, trim(regexp_replace(lower(c_name), '[[:punct:]]+', ' ', 'g')) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def entity_upsert(spark, folder):
    c = t(spark, folder, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("external_id"), F.col("c_mktsegment").alias("name"))
    return tables.upsert_entities(old, new).select("external_id", "name", "name_normalised")


@query(f"SELECT e.vec_id AS doc_id, e.label, {_COS.format('e.embedding', 'e.embedding')} > 0.99 AS self, d.source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def hit_shaping(spark, folder):
    hits = _vectors(spark, folder).join(t(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return search.attached(hits, t(spark, folder, "documents"), "source").select("doc_id", "label", F.col("vec").isNotNull().alias("self"), "source")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE p_name END AS rerank_text FROM part")
def rerank_text(spark, folder):
    size = F.col("p_size") % 3
    text = X.first_filled(F.when(size == 0, F.col("p_brand")), F.when(size == 1, F.col("p_type")).otherwise(" "), F.col("p_name"))
    return t(spark, folder, "part").select("p_partkey", text.alias("rerank_text"))
