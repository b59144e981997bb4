"""Named queries over the test tables, one or more for each operator, with DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as X
from tessera.operators import dedup, enrich, facets, metrics, pricing, resolve, search, shop
from tessera.plans.model import Field, collection
from tessera.sources import tables
from tessera.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2002-01-01"


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Filters

PARTS = collection("parts", Field("p_name", searchable=True, filterable=True), Field("p_brand", filterable=True, facet=True, also={"Brand#2": ["Brand#12"]}), Field("p_type", "enum", filterable=True, facet=True), Field("p_size", "number", filterable=True), Field("p_retailprice", "number", filterable=True, soft=True))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE (p_brand = 'Brand#2' OR p_brand IN ('Brand#12')) AND (p_type IS NULL OR p_type <> 'PROMO') AND p_size > 3 AND p_size <= 45 AND p_retailprice >= 900 AND p_retailprice < 2000 AND p_name ILIKE '%r%' AND (p_name IS NULL OR NOT regexp_matches(p_name, '(?i)gadget'))")
def filter_all_ops(spark, folder):
    cond, _ = P.where({"p_brand": "Brand#2", "p_type": {"ne": "PROMO"}, "p_size": {"gt": 3, "lte": 45}, "p_retailprice": {"gte": 900, "lt": 2000}, "p_name": {"contains": "r", "not": "gadget"}}, PARTS)
    return t(spark, folder, "part").where(cond).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') AND (p_type IS NULL OR NOT p_type IN ('SMALL', 'LARGE'))")
def filter_in_nin(spark, folder):
    cond, _ = P.where({"p_brand": ["Brand#1", "Brand#3"], "p_type": {"nin": ["SMALL", "LARGE"]}}, PARTS)
    return t(spark, folder, "part").where(cond).select("p_partkey")


_NULLS = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'F' THEN string_split(o_orderpriority, '-') END AS parts FROM orders"
ORDERS = collection("orders", Field("status", filterable=True), Field("parts", "array", filterable=True))


@query(
    f"WITH o AS ({_NULLS}) SELECT o_orderkey, (status IS NULL OR status <> 'O') AS ne, (status IS NULL OR NOT status IN ('O')) AS nin, (status IS NULL OR NOT regexp_matches(status, '(?i)o')) AS no, coalesce(status = 'O', false) AS eq,"
    " coalesce(list_has_any(parts, ['1', 'LOW']), false) AS has, (parts IS NOT NULL AND NOT coalesce(list_has_any(parts, ['1', 'LOW']), false)) AS hasnt FROM o"
)
def filter_null_semantics(spark, folder):
    o = t(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderstatus") != "F", F.split("o_orderpriority", "-")).alias("parts"))
    one = lambda f: F.coalesce(P.where(f, ORDERS)[0], F.lit(False))
    return o.select("o_orderkey", one({"status": {"ne": "O"}}).alias("ne"), one({"status": {"nin": ["O"]}}).alias("nin"), one({"status": {"not": "o"}}).alias("no"), one({"status": "O"}).alias("eq"), one({"parts": ["1", "LOW"]}).alias("has"), one({"parts": {"exclude": ["1", "LOW"]}}).alias("hasnt"))


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(f"SELECT doc_id FROM documents WHERE coalesce(list_has_any({_TOK.format('text')}, ['license', 'rights', 'token']), false)")
def array_overlap_filter(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", X.tokens(F.col("text")).alias("words"))
    return docs.where(P.condition(Field("words", "array", filterable=True), "contains", ["license", "rights", "token"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, '') || ' ' || coalesce(source, ''), '(?i)idiot') AND NOT regexp_matches(coalesce(text, '') || ' ' || coalesce(source, ''), '(?i)src1')")
def exclude_terms(spark, folder):
    return t(spark, folder, "documents").where(P.without_terms(["text", "source"], ["idiot", "src1"])).select("doc_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7'")
def tenancy_scope(spark, folder):
    customers = collection("customers", Field("c_acctbal", "number", filterable=True), scopes=("nation",))
    rows = t(spark, folder, "customer").withColumn("scope_nation", F.col("c_nationkey").cast("string"))
    return rows.where(P.scoped({"nation": "7"}, customers)).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 1000 THEN 'satisfied' ELSE 'violated' END AS price, CASE WHEN p_size <= 20 THEN 'satisfied' ELSE 'violated' END AS size FROM part")
def verify_constraints(spark, folder):
    v = P.verdicts({"price": F.col("p_retailprice") <= 1000, "size": F.col("p_size") <= 20})
    return t(spark, folder, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")["price"].alias("price"), F.col("v")["size"].alias("size"))


# Facets


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def facet_terms(spark, folder):
    return facets.terms(t(spark, folder, "part"), F.col("p_brand"))


@query("SELECT CASE WHEN l_discount > 0.05 THEN 'true' ELSE 'false' END AS value, count(*) AS n FROM lineitem GROUP BY 1")
def facet_boolean(spark, folder):
    return facets.flags(t(spark, folder, "lineitem"), F.col("l_discount") > 0.05)


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def facet_array(spark, folder):
    return facets.elements(t(spark, folder, "part"), F.split("p_name", " "))


@query(
    "WITH w AS (SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS most, avg(l_extendedprice) AS mean FROM lineitem), c AS (SELECT least(5, greatest(0, floor((l_extendedprice - least) / ((most - least) / 6))))::INT AS bucket, count(*) AS n FROM lineitem, w GROUP BY 1)"
    " SELECT b.bucket::INT AS bucket, least + (most - least) / 6 * b.bucket AS lo, least + (most - least) / 6 * (b.bucket + 1) AS hi, coalesce(n, 0) AS n, least, most, round(mean, 4) AS mean FROM w, range(6) AS b(bucket) LEFT JOIN c ON c.bucket = b.bucket"
)
def facet_range(spark, folder):
    return facets.ranges(t(spark, folder, "lineitem"), F.col("l_extendedprice")).withColumn("mean", F.round("mean", 4))


@query("SELECT p_brand AS category, round(quantile_cont(p_retailprice::DOUBLE, 0.30), 6) AS cheap, round(quantile_cont(p_retailprice::DOUBLE, 0.75), 6) AS premium FROM part GROUP BY 1")
def budget_percentile(spark, folder):
    out = facets.budget(t(spark, folder, "part"), F.col("p_retailprice"), F.col("p_brand"))
    return out.select("category", F.round("cheap", 6).alias("cheap"), F.round("premium", 6).alias("premium"))


@query("SELECT 'brand' AS field, count(*) FILTER (p_brand = 'Brand#2') AS n FROM part UNION ALL SELECT 'size', count(*) FILTER (p_size > 40) FROM part UNION ALL SELECT 'price', count(*) FILTER (p_retailprice < 950) FROM part")
def relax_probe_counts(spark, folder):
    return facets.probe(t(spark, folder, "part"), {"brand": F.col("p_brand") == "Brand#2", "size": F.col("p_size") > 40, "price": F.col("p_retailprice") < 950})


@query("SELECT field, value, count(*) AS n FROM (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part) WHERE value IS NOT NULL GROUP BY 1, 2")
def vocab_census(spark, folder):
    return facets.census(t(spark, folder, "part"), "p_brand", "p_type", "p_name")


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: substr(' ' || lower({0}) || ' ', i, 3)))"


def _similar(a: str, b: str) -> str:
    x, y = _TRI.format(a), _TRI.format(b)
    return f"(len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))))"


_ASKED = [("p_type", "econmy"), ("p_type", "PROMO"), ("p_name", "smal ring"), ("p_name", "purple cow"), ("p_brand", "brand#7")]
_VOCAB = "v AS (SELECT field, value, count(*) AS n FROM (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part) WHERE value IS NOT NULL GROUP BY 1, 2), a(field, input) AS (VALUES " + ", ".join(map(str, _ASKED)) + ")"


def _asked(spark):
    return spark.createDataFrame(_ASKED, "field string, input string")


@query(f"WITH {_VOCAB} SELECT field, input, value, round(s, 6) AS similarity FROM (SELECT a.field, input, value, {_similar('input', 'value')} AS s, row_number() OVER (PARTITION BY a.field, input ORDER BY {_similar('input', 'value')} DESC, n DESC, value) AS r FROM a JOIN v ON a.field = v.field WHERE {_similar('input', 'value')} > 0.25) WHERE r <= 8")
def vocab_candidates(spark, folder):
    vocab = facets.census(t(spark, folder, "part"), "p_brand", "p_type", "p_name")
    near = vocab.join(search.small(_asked(spark)), "field").withColumn("s", X.trigram_similarity(F.col("input"), F.col("value"))).where("s > 0.25")
    nth = F.row_number().over(Window.partitionBy("field", "input").orderBy(F.desc("s"), F.desc("n"), "value"))
    return near.withColumn("r", nth).where("r <= 8").select("field", "input", "value", F.round("s", 6).alias("similarity"))


@query(
    f"WITH {_VOCAB}, e AS (SELECT a.field, input, min(value) AS same FROM a JOIN v ON a.field = v.field AND lower(input) = lower(value) GROUP BY 1, 2), s AS (SELECT a.field, input, value, {_similar('input', 'value')} AS s, row_number() OVER (PARTITION BY a.field, input ORDER BY {_similar('input', 'value')} DESC, n DESC, value) AS r FROM a JOIN v ON a.field = v.field)"
    " SELECT s.field, s.input, CASE WHEN same IS NOT NULL THEN same WHEN s >= 0.4 THEN value END AS value, CASE WHEN same IS NOT NULL THEN 'kept' WHEN s >= 0.4 THEN 'mapped' ELSE 'dropped' END AS how FROM s LEFT JOIN e ON e.field = s.field AND e.input = s.input WHERE r = 1"
)
def vocab_ground(spark, folder):
    return search.ground(_asked(spark), facets.census(t(spark, folder, "part"), "p_brand", "p_type", "p_name"), X.trigram_similarity)


# Retrieval

_CENTRES = "cent AS (SELECT label AS query_id, list(x ORDER BY i) AS vec FROM (SELECT label, i, avg(e::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
_VEC = _CENTRES + f", vec AS (SELECT query_id, vec_id AS doc_id, cos, rank FROM (SELECT query_id, vec_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM (SELECT c.query_id, e.vec_id, {_COS.format('e.embedding', 'c.vec')} AS cos FROM embeddings e, cent c)) WHERE rank <= 150)"


def _centres(spark, folder):
    """Each label's mean vector as a query."""
    e = t(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("l")).select("query_id", F.col("l.x").alias("vec"))


def _vectors(spark, folder):
    return t(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


@query(f"WITH {_VEC} SELECT query_id, doc_id, round(cos, 6) AS cos, rank FROM vec")
def vector_topk(spark, folder):
    return search.vector(_vectors(spark, folder), _centres(spark, folder)).select("query_id", "doc_id", F.round("cos", 6).alias("cos"), "rank")


@query(f"WITH {_CENTRES}, s AS (SELECT c.query_id, e.vec_id % 100 AS doc_id, max({_COS.format('e.embedding', 'c.vec')}) AS cos FROM embeddings e, cent c GROUP BY 1, 2) SELECT query_id, doc_id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM s) WHERE rank <= 150")
def evidence_maxsim(spark, folder):
    parts = t(spark, folder, "embeddings").select((F.col("vec_id") % 100).alias("doc_id"), F.col("embedding").alias("vec"))
    return search.evidence(parts, _centres(spark, folder)).select("query_id", "doc_id", F.round("cos", 6).alias("cos"), "rank")


_LEX = (
    f"q AS (SELECT item_id AS query_id, list_distinct({_TOK.format('text')}) AS toks FROM benchmark), qt AS (SELECT query_id, len(toks) AS asked, unnest(toks) AS token FROM q), dt AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS token FROM documents),"
    " lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, count(*) AS overlap, count(*)::DOUBLE / max(asked) AS share FROM dt JOIN qt USING (token) GROUP BY 1, 2)) WHERE rank <= 150)"
)


def _questions(spark, folder):
    return t(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, folder):
    return search.lexical(t(spark, folder, "documents").select("doc_id", "text"), _questions(spark, folder))


@query(f"WITH {_LEX} SELECT query_id, doc_id, overlap, round(share, 6) AS share, rank FROM lex")
def lexical_overlap_rank(spark, folder):
    return _lexical(spark, folder).select("query_id", "doc_id", "overlap", F.round("share", 6).alias("share"), "rank")


_AGE = f"exp(-0.6931471805599453 * ((epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400.0) / 90.0)"


@query(f"SELECT o_custkey AS query_id, o_orderkey AS doc_id, round({_AGE}, 9) AS decay, row_number() OVER (PARTITION BY o_custkey ORDER BY {_AGE} DESC, o_orderkey) AS rank FROM orders")
def recency_rank(spark, folder):
    o = t(spark, folder, "orders")
    pairs = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    out = search.recent(pairs, o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("at")), F.to_timestamp(F.lit(AS_OF)), 90.0)
    return out.select("query_id", "doc_id", F.round("decay", 9).alias("decay"), "rank")


# A benchmark item asks in words, and for the vectors of a label: the legs of hybrid retrieval.
_HYB = (
    f"{_LEX}, {_VEC.replace('cent AS', 'cent0 AS', 1).replace('embeddings e, cent c', 'embeddings e, cent0 c')}, sem AS (SELECT b.item_id AS query_id, v.doc_id, v.cos, v.rank FROM benchmark b JOIN vec v ON v.query_id = b.item_id % 10),"
    f" cand AS (SELECT query_id, doc_id FROM lex UNION SELECT query_id, doc_id FROM sem), rec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_AGE} DESC, doc_id) AS rank FROM cand JOIN orders ON o_orderkey = doc_id),"
    " fused AS (SELECT c.query_id, c.doc_id, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(0.8::DOUBLE / (60 + s.rank), 0) + coalesce(0.2::DOUBLE / (60 + r.rank), 0) AS score, l.rank AS fts_rank, s.rank AS doc_rank, r.rank AS recency_rank, s.cos, l.share"
    " FROM cand c LEFT JOIN lex l ON l.query_id = c.query_id AND l.doc_id = c.doc_id LEFT JOIN sem s ON s.query_id = c.query_id AND s.doc_id = c.doc_id LEFT JOIN rec r ON r.query_id = c.query_id AND r.doc_id = c.doc_id),"
    " hits AS (SELECT *, fts_rank IS NOT NULL AS fts, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused WHERE fts_rank IS NOT NULL OR cos >= 0.2)"
)


def _legs(spark, folder):
    lex = _lexical(spark, folder)
    ask = t(spark, folder, "benchmark").select("item_id", (F.col("item_id") % 10).alias("query_id"))
    sem = search.vector(_vectors(spark, folder), _centres(spark, folder)).withColumn("query_id", F.col("query_id").cast("long")).join(F.broadcast(ask), "query_id").select(F.col("item_id").alias("query_id"), "doc_id", "cos", "rank")
    cand = lex.select("query_id", "doc_id").unionByName(sem.select("query_id", "doc_id"))
    dates = t(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("at"))
    return lex, sem, search.recent(cand, dates, F.to_timestamp(F.lit(AS_OF)), 90.0)


def _fused(spark, folder):
    lex, sem, rec = _legs(spark, folder)
    return search.fuse({"fts": (lex, 1.0), "doc": (sem, 0.8), "recency": (rec, 0.2)})


def _hits(spark, folder):
    kept = search.floor(_fused(spark, folder), 0.2)
    return search.ranked(kept.withColumn("fts", F.col("fts_rank").isNotNull()), F.desc("score"))


@query(f"WITH {_HYB} SELECT query_id, doc_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM fused) WHERE place <= 20")
def hybrid_rrf(spark, folder):
    top = search.ranked(_fused(spark, folder), F.desc("score"), keep=20)
    return top.select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_HYB} SELECT query_id, doc_id, round(score, 9) AS score, coalesce(fts_rank, 0) AS fts_rank, coalesce(doc_rank, 0) AS doc_rank, coalesce(recency_rank, 0) AS recency_rank, round(coalesce(cos, -1), 6) AS cos FROM fused")
def hybrid_explain(spark, folder):
    return _fused(spark, folder).select("query_id", "doc_id", F.round("score", 9).alias("score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fts_rank", "doc_rank", "recency_rank")], F.round(F.coalesce("cos", F.lit(-1.0)), 6).alias("cos"))


@query(f"WITH {_HYB} SELECT query_id, doc_id, round(coalesce(0.5 * share, 0) + coalesce(1.5 * cos, 0), 6) AS score FROM fused")
def hybrid_linear(spark, folder):
    lex, sem, _ = _legs(spark, folder)
    return search.linear({"fts": (lex, "share", 0.5), "doc": (sem, "cos", 1.5)}).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_HYB} SELECT query_id, doc_id, rank FROM hits")
def relevance_floor(spark, folder):
    return _hits(spark, folder).select("query_id", "doc_id", "rank")


# Hits by meaning alone, for cutoffs: a lexical hit here and there.
_SEM = f"{_VEC}, h AS (SELECT query_id, doc_id, rank, cos, doc_id % 7 = 3 AS fts FROM vec)"


def _semantic(spark, folder):
    return search.vector(_vectors(spark, folder), _centres(spark, folder)).withColumn("fts", F.col("doc_id") % 7 == 3)


@query(
    f"WITH {_SEM}, s AS (SELECT *, sum(CASE WHEN NOT fts THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS seg FROM h), b AS (SELECT query_id, seg, max(cos) AS base FROM s GROUP BY 1, 2), f AS (SELECT s.*, b.base FROM s LEFT JOIN b ON b.query_id = s.query_id AND b.seg = s.seg - 1),"
    " c AS (SELECT query_id, min(rank) FILTER (NOT fts AND cos < base * 0.97) AS cliff FROM f GROUP BY 1) SELECT query_id, doc_id, rank FROM f JOIN c USING (query_id) WHERE cliff IS NULL OR rank < cliff OR fts"
)
def cutoff_score_drop(spark, folder):
    return search.score_drop(_semantic(spark, folder), max_drop=0.03).select("query_id", "doc_id", "rank")


@query(
    f"WITH {_VEC}, h AS (SELECT v.*, e.label AS value FROM vec v JOIN embeddings e ON e.vec_id = v.doc_id), top AS (SELECT query_id, max(cos) AS m FROM h GROUP BY 1), n AS (SELECT query_id, value, count(*) AS n FROM h WHERE rank <= 10 GROUP BY 1, 2), s AS (SELECT query_id, max(n) / sum(n) AS majority FROM n GROUP BY 1)"
    " SELECT query_id, doc_id, rank, value FROM h JOIN s USING (query_id) JOIN top USING (query_id) WHERE majority >= 0.5 AND m >= 0.3"
)
def cutoff_coherence(spark, folder):
    label = t(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("value"))
    hits = search.vector(_vectors(spark, folder), _centres(spark, folder)).join(label, "doc_id").withColumn("fts", F.lit(False))
    return search.coherence(hits, "value").select("query_id", "doc_id", "rank", "value")


@query(f"WITH {_HYB} SELECT query_id, doc_id, source FROM (SELECT h.query_id, h.doc_id, d.source, row_number() OVER (PARTITION BY h.query_id, source ORDER BY score DESC, h.doc_id) AS nth FROM hits h LEFT JOIN documents d ON d.doc_id = h.doc_id) WHERE source IS NULL OR nth = 1")
def diversify_best(spark, folder):
    group = t(spark, folder, "documents").select("doc_id", "source")
    return search.diversify(_hits(spark, folder).join(group, "doc_id", "left"), "source").select("query_id", "doc_id", "source")


@query(
    f"WITH {_HYB}, n AS (SELECT h.*, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS rel FROM hits h WINDOW w AS (PARTITION BY query_id))"
    " SELECT query_id, n.doc_id, round(rel * pow(CASE WHEN coalesce(quality = 1, true) THEN 1.0 ELSE 0.2 END, 0.2) + 0.1 * least(greatest(coalesce(cos, 0), 0), 1), 6) AS policy_score FROM n LEFT JOIN labels l ON l.doc_id = n.doc_id WHERE rel >= 0.05"
)
def ranking_policy(spark, folder):
    label = t(spark, folder, "labels").select("doc_id", "quality")
    hits = _hits(spark, folder).join(label, "doc_id", "left")
    out = search.policy(hits, F.col("quality") == 1, F.lit(0.0), F.coalesce("cos", F.lit(0.0)), {"newness": 0.1}, floor_=0.05)
    return out.select("query_id", "doc_id", F.round("policy_score", 6).alias("policy_score"))


@query(
    f"WITH {_SEM}, b AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN (CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END)::DOUBLE / rank + (1 - (CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END)::DOUBLE) * ((doc_id % 11) / 10.0)::DOUBLE END AS blended FROM h),"
    " s AS (SELECT *, row_number() OVER (PARTITION BY query_id, blended IS NOT NULL ORDER BY rank) AS slot, row_number() OVER (PARTITION BY query_id, blended IS NOT NULL ORDER BY blended DESC, rank) AS nth FROM b)"
    " SELECT a.query_id, a.doc_id, CASE WHEN a.blended IS NULL THEN a.rank ELSE z.rank END AS place FROM s a LEFT JOIN s z ON z.query_id = a.query_id AND z.slot = a.nth AND z.blended IS NOT NULL"
)
def rerank_blend(spark, folder):
    hits = _semantic(spark, folder).withColumn("grade", F.when(F.col("doc_id") % 3 != 0, F.least((F.col("doc_id") % 11) / 10.0, F.lit(1.0))))
    return search.blend(hits, "grade").select("query_id", "doc_id", "place")


@query(r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS match, generate_subscripts(regexp_extract_all(text, '[0-9]{16}'), 1) AS nth FROM documents) SELECT doc_id, nth::INT AS nth, match FROM m WHERE nth <= 50")
def grep_documents(spark, folder):
    return search.grep(t(spark, folder, "documents"), "[0-9]{16}").select("doc_id", "nth", "match")


@query("SELECT doc_id, substr(text, 101, 200) AS part FROM documents")
def doc_slice(spark, folder):
    return t(spark, folder, "documents").select("doc_id", X.slice_text(F.col("text"), 100, 200).alias("part"))


# Text

_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalise_text(spark, folder):
    return t(spark, folder, "documents").select("doc_id", X.normalise(F.col("text")).alias("norm"))


@query()
def phonetic_hash(spark, folder):
    return t(spark, folder, "customer").select("c_custkey", X.phonetic(F.col("c_mktsegment")).alias("segment"), X.phonetic_tokens(F.col("c_name")).alias("name"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_html(spark, folder):
    return t(spark, folder, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("SELECT doc_id, sha1(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS hash FROM documents")
def content_hash(spark, folder):
    return t(spark, folder, "documents").select("doc_id", X.content_hash(F.col("text"), F.col("lang"), F.col("source")).alias("hash"))


# Duplicates: pairs of near vectors, and what is made of them.

_PAIRS = f"p AS (SELECT x.vec_id AS a, y.vec_id AS b, {_COS.format('x.embedding', 'y.embedding')} AS cos FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS.format('x.embedding', 'y.embedding')} >= 0.4)"


def _pairs(spark, folder, *more):
    vectors = t(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), *more)
    return dedup.near_pairs(vectors, 0.4, *more)


@query(f"WITH {_PAIRS} SELECT a, b, round(cos, 6) AS cos FROM p")
def dedup_pairs(spark, folder):
    return _pairs(spark, folder).select("a", "b", F.round("cos", 6).alias("cos"))


@query(f"WITH {_PAIRS}, n AS (SELECT a AS root, a AS node, cos FROM p UNION ALL SELECT a, b, cos FROM p) SELECT root, string_agg(DISTINCT node::VARCHAR, ',' ORDER BY node::VARCHAR) AS members, count(DISTINCT node) AS n, round(min(cos), 6) AS weakest FROM n GROUP BY 1 HAVING count(DISTINCT node) >= 2")
def dedup_pairs_star(spark, folder):
    out = dedup.stars(_pairs(spark, folder))
    return out.select("root", F.array_join(F.sort_array(F.transform("members", lambda x: x.cast("string"))), ",").alias("members"), F.col("n").cast("long").alias("n"), F.round("weakest", 6).alias("weakest"))


_EDGES = f"{_PAIRS}, s AS (SELECT a AS id, b AS candidate, cos FROM p UNION ALL SELECT b, a, cos FROM p), sc AS (SELECT s.id, candidate, CASE WHEN x.label = y.label AND s.id % 2 = candidate % 2 THEN 1.0 ELSE (2 * cos + CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END) / 3 END AS score FROM s JOIN embeddings x ON x.vec_id = s.id JOIN embeddings y ON y.vec_id = candidate)"


def _scored(spark, folder):
    pairs = _pairs(spark, folder, "label")
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("candidate")), F.struct(F.col("b").alias("id"), F.col("a").alias("candidate")))).alias("_e")
    named = pairs.select(ends, "cos", F.col("label_a").alias("x"), F.col("label_b").alias("y")).select("_e.*", "cos", "x", "y")
    same = F.col("x") == F.col("y")
    return named.select("id", "candidate", dedup.weighted(same & (F.col("id") % 2 == F.col("candidate") % 2), (2.0, F.col("cos")), (1.0, F.when(same, 1.0).otherwise(0.0))).alias("score"))


@query(f"WITH {_EDGES} SELECT id, candidate, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS nth FROM sc) WHERE nth = 1")
def dedup_best_edge(spark, folder):
    return dedup.best_edges(_scored(spark, folder)).select("id", "candidate", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, b AS root FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a) SELECT node, least(node, min(root)) AS root FROM r GROUP BY node")
def components(spark, folder):
    return dedup.components(_pairs(spark, folder))


@query(
    f"WITH {_PAIRS}, w AS (SELECT a, b, log2(0.05 / 0.95) + CASE WHEN x.label = y.label THEN log2(0.95 / 0.0002) ELSE log2(0.05 / 0.9998) END + CASE WHEN cos >= 0.95 THEN log2(0.8 / 0.01) WHEN cos >= 0.8 THEN log2(0.55 / 0.06) ELSE log2(0.1 / 0.93) END AS m FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b)"
    " SELECT a, b, round(m, 6) AS weight, round(pow(2, m) / (1 + pow(2, m)), 6) AS probability FROM w"
)
def fellegi_sunter(spark, folder):
    p = _pairs(spark, folder, "label")
    weight, chance = resolve.linkage((F.when(F.col("label_a") == F.col("label_b"), 1.0).otherwise(0.0), resolve.EXACT), (F.col("cos"), resolve.COSINE))
    return p.select("a", "b", F.round(weight, 6).alias("weight"), F.round(chance, 6).alias("probability"))


@query("SELECT p_partkey, p_brand, o.n_offers, o.cheapest FROM part JOIN (SELECT l_partkey, count(*) AS n_offers, min(l_extendedprice / l_quantity) AS cheapest FROM lineitem GROUP BY 1) o ON o.l_partkey = p_partkey")
def offers_attach(spark, folder):
    hits = t(spark, folder, "part").select("p_partkey", "p_brand")
    lines = t(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber")
    out = search.offers(hits, lines, "p_partkey", "price", "l_orderkey", "l_linenumber").where("offers is not null")
    return out.select("p_partkey", "p_brand", F.size("offers").cast("long").alias("n_offers"), F.get("offers", F.lit(0))["price"].alias("cheapest"))


@query("SELECT coalesce(p_brand, '__null__') AS brand, p_name AS item, count(*) AS n, count(DISTINCT p_size) AS p_size_values, count(DISTINCT p_type) AS p_type_values FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def variant_groups(spark, folder):
    return dedup.variants(t(spark, folder, "part"), "p_brand", "p_name", "p_size", "p_type")


# Tables and change events


@query(
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE o_orderpriority END AS h FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey, o_orderpriority AS h FROM orders WHERE o_orderstatus <> 'P')"
    " SELECT coalesce(n.o_orderkey, o.o_orderkey)::VARCHAR AS id, coalesce(n.h, o.h) AS content_hash, CASE WHEN n.h IS NULL OR n.h IS NOT DISTINCT FROM o.h THEN o.h END AS enriched FROM o FULL JOIN n ON n.o_orderkey = o.o_orderkey"
)
def upsert_merge(spark, folder):
    orders = t(spark, folder, "orders")
    key, at = F.col("o_orderkey").cast("string").alias("id"), F.to_timestamp(F.lit(AS_OF))
    seen = F.when(F.col("o_orderstatus") == "F", "f").otherwise(F.col("o_orderpriority"))
    old = orders.where(F.col("o_orderkey") % 4 != 0).select(key, F.lit("s").alias("scope"), seen.alias("data"), seen.alias("content_hash"), seen.alias("enriched"), at.alias("indexed_at"), at.alias("ingested_at"))
    new = orders.where("o_orderstatus <> 'P'").select(key, F.lit("s").alias("scope"), F.col("o_orderpriority").alias("data"), F.col("o_orderpriority").alias("content_hash"))
    return tables.upsert(old, new, at).select("id", "content_hash", "enriched")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def change_events_latest(spark, folder):
    return changes.latest_events(t(spark, folder, "events")).select("user_id", "event_id", "event_type")


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha1(text) END AS h FROM documents WHERE doc_id % 3 <> 0) SELECT d.doc_id AS id FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.h = sha1(d.text) WHERE s.doc_id IS NULL")
def dirty_rows(spark, folder):
    rows = t(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("content_hash"))
    seen = rows.where("id % 3 <> 0").withColumn("content_hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return tables.dirty(rows, seen).select("id")


@query(f"SELECT event_id AS id, (event_id % 7)::INT + 1 AS attempts, CASE WHEN event_id % 7 + 1 >= 5 THEN 'dead' ELSE 'failed' END AS status, CASE WHEN event_id % 7 + 1 < 5 THEN pow(2, event_id % 7 + 1)::BIGINT END AS wait FROM events WHERE event_type = 'error'")
def retry_backoff(spark, folder):
    rows = t(spark, folder, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).cast("int").alias("attempts"))
    now = F.to_timestamp(F.lit(AS_OF))
    return tables.after_failure(rows, now).select("id", "attempts", "status", (F.unix_timestamp("due") - F.unix_timestamp(now)).alias("wait"))


# Evaluation: the lexical leg's hits, graded by the labels of the documents.

_JUDGED = f"{_LEX}, j AS (SELECT l.query_id, l.rank, CASE WHEN b.quality = 1 AND b.toxic = 0 THEN 2 WHEN b.quality = 1 THEN 1 ELSE 0 END AS grade FROM lex l JOIN labels b USING (doc_id))"


def _judged(spark, folder):
    label = t(spark, folder, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0).alias("grade"))
    return _lexical(spark, folder).join(label, "doc_id").select("query_id", "rank", "grade")


@query(
    f"WITH {_JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM j), n AS (SELECT query_id, coalesce(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END), 0), 0) AS ndcg FROM i GROUP BY 1)"
    " SELECT coalesce((query_id % 4)::VARCHAR, 'all') AS type, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM n GROUP BY ROLLUP (query_id % 4)"
)
def ndcg_by_type(spark, folder):
    each = metrics.ndcg(_judged(spark, folder)).withColumn("kind", F.col("query_id") % 4)
    return metrics.by_type(each, "kind", "ndcg").select("type", "n", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_JUDGED} SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (grade >= 2), 0), 6) AS mrr, coalesce((min(rank) FILTER (grade >= 2) <= 10)::INT, 0) AS hit FROM j GROUP BY 1")
def mrr_hit(spark, folder):
    return metrics.reciprocal(_judged(spark, folder), 2).select("query_id", F.round("mrr", 6).alias("mrr"), "hit")


@query(
    "WITH d AS (SELECT least(floor((value % 50 + 50) - 50 + 1e-9), 49) AS reached, event_type IN ('purchase', 'signup') AS yes FROM events WHERE value IS NOT NULL), g AS (SELECT unnest(range(50)) AS step), c AS (SELECT step, count(*) FILTER (yes AND reached >= step) AS tp, count(*) FILTER (NOT yes AND reached >= step) AS fp, count(*) FILTER (yes AND reached < step) AS fn FROM d, g GROUP BY 1)"
    " SELECT (step + 50) / 100.0::DOUBLE AS threshold, tp, fp, fn, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"
)
def calibrate_threshold(spark, folder):
    e = t(spark, folder, "events").where("value is not null")
    rows = e.select((0.5 + (F.col("value") % 50) / 100.0).alias("score"), F.col("event_type").isin("purchase", "signup").alias("accepted"))
    return metrics.calibrate(rows).withColumn("f1", F.round("f1", 6))


@query(
    "WITH r AS (SELECT quality AS x, toxic AS y FROM labels), n AS (SELECT count(*)::DOUBLE AS n, avg((x = y)::INT) AS o FROM r), e AS (SELECT sum(cx * cy) AS c FROM (SELECT x AS k, count(*)::DOUBLE AS cx FROM r GROUP BY 1) JOIN (SELECT y AS k, count(*)::DOUBLE AS cy FROM r GROUP BY 1) USING (k))"
    " SELECT n::BIGINT AS n, round(o, 6) AS observed, round(c / n / n, 6) AS expected, round((o - c / n / n) / (1 - c / n / n), 6) AS kappa FROM n, e"
)
def kappa_prf(spark, folder):
    out = metrics.kappa(t(spark, folder, "labels"), F.col("quality"), F.col("toxic"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query(
    "WITH x AS (SELECT 'name' AS attribute, list_distinct(string_split(p_name, ' ')) AS gold, list_distinct([string_split(p_name, ' ')[1], lower(p_type)]) AS got FROM part UNION ALL SELECT 'brand', [p_brand], CASE WHEN p_size > 10 THEN [p_brand] ELSE [] END FROM part),"
    " c AS (SELECT attribute, sum(len(list_intersect(gold, got)))::BIGINT AS tp, sum(len(got) - len(list_intersect(gold, got)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(gold, got)))::BIGINT AS fn FROM x GROUP BY 1)"
    " SELECT attribute, tp, fp, fn, round(tp / (tp + fp), 6) AS p, round(tp / (tp + fn), 6) AS r, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"
)
def attr_prf(spark, folder):
    name = F.array_distinct(F.split("p_name", " "))
    got = F.array_distinct(F.array(F.get(F.split("p_name", " "), F.lit(0)), F.lower("p_type")))
    brand = F.array("p_brand")
    out = metrics.accuracy(t(spark, folder, "part"), {"name": (name, got), "brand": (brand, F.when(F.col("p_size") > 10, brand).otherwise(F.array().cast("array<string>")))})
    return out.select("attribute", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query("SELECT p_partkey, round(p_retailprice * (1 + 0.15) - p_size / 4, 6) AS price FROM part")
def price_formula(spark, folder):
    return t(spark, folder, "part").select("p_partkey", F.round(pricing.formula("p_retailprice * (1 + .15) - p_size / 4"), 6).alias("price"))


@query("SELECT user_id, count(*) AS sessions, sum(n) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def event_sessions(spark, folder):
    return changes.sessions(t(spark, folder, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


# Shop and review


@query("SELECT p_partkey, round(CASE WHEN p_brand = 'Brand#3' THEN -2.0 ELSE 0 END + CASE WHEN p_brand = 'Brand#2' THEN 1.0 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN -0.35 ELSE 0 END + CASE WHEN p_retailprice BETWEEN 900 AND 1000 THEN 0.3 ELSE -0.3 END + CASE WHEN p_type = 'PROMO' THEN -1.0 ELSE 0 END + CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN 0.4 ELSE 0 END, 6) AS taste FROM part")
def personal_taste(spark, folder):
    score = shop.taste(F.col("p_brand"), F.col("p_retailprice"), F.split("p_name", " "), F.lit(None).cast("string"), F.col("p_type"), F.col("p_partkey") % 5 == 0, blocked=["brand#3"], preferred=["Brand#2"], band=(900, 1000), avoided=["promo"], affinity={"red": 0.4, "blue": -0.2})
    return t(spark, folder, "part").select("p_partkey", F.round(score, 6).alias("taste"))


@query(
    "WITH s AS (SELECT c_custkey, (c_nationkey % 2)::DOUBLE AS phone, least(greatest(c_acctbal / 10000, 0), 1) AS cos FROM customer), x AS (SELECT *, 1 - (1 - phone) * (1 - 0.6 * cos) AS combined FROM s)"
    " SELECT c_custkey, round(combined, 6) AS combined, CASE WHEN greatest(combined - 0.6 * cos, combined - phone) > 0 THEN CASE WHEN combined - phone > combined - 0.6 * cos THEN 'cosine' ELSE 'phone' END END AS decisive FROM x"
)
def match_explain(spark, folder):
    rows = t(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") % 2).cast("double").alias("phone"), F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0)).alias("cos"))
    out = shop.decisive(rows, {"phone": F.col("phone"), "cosine": F.col("cos")}, resolve.noisy_or, {"phone": 1.0, "cosine": 0.6})
    return out.select("c_custkey", F.round("combined", 6).alias("combined"), "decisive")


@query("SELECT event_id AS id, (value / 100)::DOUBLE AS confidence FROM events WHERE value < 60 ORDER BY value / 100, event_id LIMIT 100")
def review_queue(spark, folder):
    rows = t(spark, folder, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct((F.col("value") / 100).alias("confidence"))).alias("enriched"))
    return enrich.review(rows).select("id", "confidence")
