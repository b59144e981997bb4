"""Retrieval legs and what follows them: fusion, floors, cutoffs, diversification, policies, explanations.

A leg is ``query_id, doc_id, rank`` and its own evidence; legs take a batch of queries at once. Every order ends in the
document's id, so that results don't depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import tokens
from tessera.functions.vector import clamp, cosine, recency

#: Documents that a leg passes on for each query, and the constant of reciprocal-rank fusion.
POOL, SMOOTH = 150, 60
#: Queries of up to so many are sent to all executors; more meet the documents in a shuffle.
BATCH = 100_000
#: Queries whose words make a matrix, its cells, and the documents that are multiplied with it at once.
MATRIX_ROWS, MATRIX_CELLS, MATRIX_DOCS = 2000, 1 << 24, 512


def ranked(scored: DataFrame, *order: Column, keep: int | None = None) -> DataFrame:
    """``rank`` from 1 for each query; with ``keep``, tasks drop what can't be among the first ones before any shuffle."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.asc("doc_id"))))
    return out.where(F.col("rank") <= keep) if keep else out


def small(df: DataFrame, rows: int = BATCH, size: int = 64 << 20) -> DataFrame:
    """The frame marked for broadcast if it has few rows and bytes; counting stops beyond ``rows``."""
    if df.limit(rows + 1).count() > rows:
        return df
    bytes_ = df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first().n or 0
    return F.broadcast(df) if bytes_ <= size else df


def _plain_hits(docs: DataFrame, words: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``query_id, doc_id, asked, n, density`` by a join of tokens and an aggregation: for queries of any number."""
    asked = small(words.select("query_id", F.size("tokens").alias("asked"), F.explode("tokens").alias("token")))

    def of(c: str) -> Column:
        weight = F.lit(float(weights[c])).alias("w")
        return F.transform(F.array_distinct(tokens(F.coalesce(F.col(c), F.lit("")))), lambda x: F.struct(x.alias("token"), weight))

    each = docs.select("doc_id", F.explode(F.flatten(F.array(*map(of, weights)))).alias("x")).select("doc_id", "x.*")
    held = each if len(weights) == 1 else each.groupBy("doc_id", "token").agg(F.max("w").alias("w"))
    hits = held.join(asked, "token").groupBy("query_id", "doc_id")
    return hits.agg(F.max("asked").alias("asked"), F.count("*").alias("n"), F.round(F.sum("w"), 9).alias("density"))


def _word_hits(docs: DataFrame, queries: DataFrame, weights: dict[str, float], keep: int, whole_first: bool) -> DataFrame:
    """``query_id, doc_id, asked, n, density`` of the documents that may be among the ``keep`` first of each query: how many
    of its words they have and how heavy those are.

    Every batch of documents is multiplied with the matrix of the queries' words, and a task passes on only what is
    among the first of its own documents, so neither its memory nor the shuffle follows pairs of documents and
    queries. Queries beyond the bounds of that matrix and ids that several documents share take :func:`_plain_hits`.
    """
    words = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    rows = words.where(F.size("tokens") > 0).limit(MATRIX_ROWS + 1).collect()
    place: dict[str, int] = {}
    for r in rows:
        for x in r.tokens:
            place.setdefault(x, len(place))
    same_id = len({r.query_id for r in rows}) < len(rows)
    if not rows or len(rows) > MATRIX_ROWS or len(rows) * len(place) > MATRIX_CELLS or same_id:
        return _plain_hits(docs, words, weights)
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_shared"))
    several = shared.limit(BATCH + 1).count()
    if several > BATCH:
        return _plain_hits(docs, words, weights)
    rest = None
    if several:
        is_shared = docs["doc_id"].eqNullSafe(shared["_shared"])
        rest = _plain_hits(docs.join(F.broadcast(shared), is_shared, "left_semi"), words, weights)
        docs = docs.join(F.broadcast(shared), is_shared, "left_anti")
    matrix = np.zeros((len(place), len(rows)), np.float32)
    for q, r in enumerate(rows):
        matrix[[place[x] for x in r.tokens], q] = 1
    ids = pa.array([r.query_id for r in rows], to_arrow_type(queries.schema["query_id"].dataType))
    asks = np.array([len(r.tokens) for r in rows], np.int32)
    # The heaviest column that has a word decides its weight: it is set last.
    classes = sorted({float(w) for w in weights.values()})
    columns = sorted(weights, key=lambda c: float(weights[c]))
    sent = docs.sparkSession.sparkContext.broadcast((ids, asks, pa.array(list(place), pa.string()), matrix))
    above = 2 * len(place) * max(map(abs, classes)) + 1 if whole_first else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asks, vocabulary, matrix = sent.value
        least = np.full(len(asks), -np.inf)
        best: list[pa.Table] = []

        def trim() -> None:
            whole = pa.concat_tables(best).combine_chunks()
            whole = whole.take(pc.sort_indices(whole, sort_keys=[("q", "ascending"), ("key", "descending"), ("doc_id", "ascending")]))
            q = whole.column("q").to_numpy()
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            last = np.flatnonzero(nth == keep - 1)
            least[q[last]] = whole.column("key").to_numpy()[last]
            best[:] = [whole.filter(pa.array(nth < keep))]

        for b in batches:
            found = []
            for c in columns:
                lists = b.column(f"_{c}")
                at = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(len(b)), lists.value_lengths().fill_null(0).to_numpy())
                found.append((row[at >= 0], at[at >= 0]))
            for start in range(0, len(b), MATRIX_DOCS):
                size = min(MATRIX_DOCS, len(b) - start)
                kind = np.full((size, len(vocabulary)), -1, np.int8)
                for c, (row, at) in zip(columns, found):
                    part = slice(*np.searchsorted(row, [start, start + size]))
                    kind[row[part] - start, at[part]] = classes.index(float(weights[c]))
                n, density = np.zeros((size, len(asks)), np.float32), np.zeros((size, len(asks)))
                for k, w in enumerate(classes):
                    of = kind == k
                    if of.any():
                        count = of.astype(np.float32) @ matrix
                        n += count
                        density += w * count.astype(float)
                density = density.round(9)
                key = density + above * (n == asks) if whole_first else density
                d, q = np.nonzero((n > 0) & (key >= least))
                if len(d):
                    best.append(pa.table({"q": q.astype(np.int32), "doc_id": b.column("doc_id").take(pa.array(d + start)), "n": n[d, q].astype(np.int64), "density": density[d, q], "key": key[d, q]}))
                if sum(map(len, best)) > 1_000_000 + 2 * keep * len(asks):
                    trim()
        if best:
            trim()
            for b in best[0].combine_chunks().to_batches(1 << 16):
                q = b.column("q")
                yield pa.RecordBatch.from_arrays([ids.take(q), b.column("doc_id"), pa.array(asks).take(q), b.column("n"), b.column("density")], ["query_id", "doc_id", "asked", "n", "density"])

    kind = {f: df.schema[f].dataType.simpleString() for df, f in ((queries, "query_id"), (docs, "doc_id"))}
    read = docs.select("doc_id", *[tokens(F.col(c)).alias(f"_{c}") for c in columns])
    hits = read.mapInArrow(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, asked int, n long, density double")
    return hits.unionByName(rest) if rest is not None else hits


def lexical(docs: DataFrame, queries: DataFrame, keep: int = POOL) -> DataFrame:
    """``query_id, doc_id, overlap, share, rank`` by how many of a query's distinct tokens a document has (MD3).

    ``docs`` has ``doc_id, text``, ``queries`` has ``query_id, text``.
    """
    hits = _word_hits(docs, queries, {"text": 1.0}, keep, False).select("query_id", "doc_id", F.col("n").alias("overlap"), "asked")
    return ranked(hits.withColumn("share", F.col("overlap") / F.col("asked")), F.desc("overlap"), keep=keep)


def _nearest(parts: DataFrame, queries: DataFrame, keep: int, pool: int) -> DataFrame:
    """``query_id, doc_id, cos`` of the documents that may be among the ``keep`` nearest, from each task's own best.

    Every batch of vectors is multiplied with the matrix of all queries in numpy, and a task passes on only what is
    among the ``pool`` best of its own documents for a query: what is shuffled grows with tasks and queries, not with
    documents. Queries are collected within the bounds of :func:`small`; beyond them the caller joins instead. Vectors
    of another length than a query's have no cosine with it, zero vectors have 0 with all.
    """
    rows = queries.select("query_id", "vec").where("vec is not null").collect()
    kind = {f: df.schema[f].dataType.simpleString() for df, f in ((queries, "query_id"), (parts, "doc_id"))}
    by_length: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for n in {len(r.vec) for r in rows}:
        mine = [r for r in rows if len(r.vec) == n]
        m = np.array([r.vec for r in mine], float)
        by_length[n] = (pa.array([r.query_id for r in mine], to_arrow_type(queries.schema["query_id"].dataType)), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
    sent = parts.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}

        def trim(n: int) -> None:
            """The ``pool`` best documents of each query, every document with its best vector."""
            ids = pa.concat_arrays([b for b, _ in best[n]])
            cos = np.concatenate([c for _, c in best[n]])
            _, code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            keep_rows = np.zeros(len(ids), bool)
            for q in range(cos.shape[1]):
                order = np.lexsort((code, -cos[:, q]))
                first = np.sort(np.unique(code[order], return_index=True)[1])[:pool]
                keep_rows[order[first]] = True
            at = np.flatnonzero(keep_rows)
            best[n] = [(ids.take(pa.array(at)), cos[at])]

        for b in batches:
            length = b.column("vec").value_lengths().fill_null(0).to_numpy()
            for n in sorted({*length.tolist()} & sent.value.keys()):
                take = np.flatnonzero(length == n)
                x = np.array(b.column("vec").take(pa.array(take)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                best.setdefault(n, []).append((b.column("doc_id").take(pa.array(take)), x @ sent.value[n][1].T))
                if sum(len(i) for i, _ in best[n]) > 20 * pool + 20_000:
                    trim(n)
        for n in best:
            trim(n)
            ids, cos = best[n][0]
            row, q = np.nonzero(~np.isnan(cos))
            yield pa.RecordBatch.from_arrays([sent.value[n][0].take(pa.array(q)), ids.take(pa.array(row)), pa.array(cos[row, q])], ["query_id", "doc_id", "cos"])

    out = parts.select("doc_id", "vec").mapInArrow(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, cos double")
    return out.groupBy("query_id", "doc_id").agg(F.max("cos").alias("cos"))


def vector(docs: DataFrame, queries: DataFrame, keep: int = POOL) -> DataFrame:
    """``query_id, doc_id, cos, rank`` of the nearest vectors of each query, exactly (TK1)."""
    return evidence(docs, queries, keep)


def evidence(parts: DataFrame, queries: DataFrame, keep: int = POOL, parents: DataFrame | None = None) -> DataFrame:
    """As :func:`vector` for documents of several vectors: the best of them counts (AG7, TK3). With ``parents``, only
    vectors of its documents are looked at (JN5)."""
    if parents is not None:
        parts = parts.join(parents.select("doc_id").distinct(), "doc_id", "left_semi")
    if queries.limit(2001).count() <= 2000:
        return ranked(_nearest(parts, queries, keep, keep), F.desc("cos"), keep=keep)
    both = parts.select("doc_id", "vec").crossJoin(small(queries.select("query_id", F.col("vec").alias("wanted"))))  # queries against all rows
    best = both.select("query_id", "doc_id", cosine(F.col("vec"), F.col("wanted")).alias("cos")).groupBy("query_id", "doc_id").agg(F.max("cos").alias("cos"))
    return ranked(best.where("cos is not null"), F.desc("cos"), keep=keep)


def covered(docs: DataFrame, queries: DataFrame, weights: dict[str, float], keep: int = POOL, sound: Callable[[Column], Column] | None = None) -> DataFrame:
    """``query_id, doc_id, whole, density, sounds, rank``: documents with all of a query's words first, then by how heavy the
    words that they have are, then by words of the same sound (MD4, WN1, PRJ7).

    ``weights`` names text columns of ``docs`` and how much a word counts there, of several the most; ``density`` is the
    sum over the query's words. Words are joined, so documents meet only queries that they share one with.
    """
    if not sound:
        hits = _word_hits(docs, queries, weights, keep, True)
        hits = hits.select("query_id", "doc_id", (F.col("n") == F.col("asked")).alias("whole"), "density", F.lit(0).cast("long").alias("sounds"))
        return ranked(hits, F.desc("whole"), F.desc("density"), F.desc("sounds"), keep=keep)
    words = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    asked = small(words.select("query_id", F.size("tokens").alias("asked"), F.explode("tokens").alias("token")))

    def held(read: Callable[[Column], Column]) -> DataFrame:
        def of(c: str) -> Column:
            weight = F.lit(float(weights[c])).alias("w")
            return F.transform(F.array_distinct(read(F.coalesce(F.col(c), F.lit("")))), lambda x: F.struct(x.alias("token"), weight))

        each = F.flatten(F.array(*map(of, weights)))
        return docs.select("doc_id", F.explode(each).alias("x")).groupBy("doc_id", "x.token").agg(F.max("x.w").alias("w"))

    own = held(tokens).join(asked, "token").select("query_id", "doc_id", "asked", "w", F.lit(0).alias("s"))
    heard = asked.select("query_id", "asked", sound(F.col("token")).alias("token")).where("token <> ''").distinct()
    own = own.unionByName(held(lambda c: F.filter(F.transform(tokens(c), sound), lambda x: x != "")).join(heard, "token").select("query_id", "doc_id", "asked", F.lit(0.0).alias("w"), F.lit(1).alias("s")))
    hits = own.groupBy("query_id", "doc_id").agg((F.count_if(F.col("s") == 0) == F.max("asked")).alias("whole"), F.round(F.sum("w"), 9).alias("density"), F.sum("s").alias("sounds"))
    return ranked(hits, F.desc("whole"), F.desc("density"), F.desc("sounds"), keep=keep)


def counts(fused: DataFrame, least: float, queries: DataFrame) -> DataFrame:
    """``query_id, candidates, eligible``: what retrieval found and what the floor lets through, for every query, those
    without any hit too (AG9, JN3)."""
    near = F.col("fts_rank").isNotNull() | F.coalesce(F.col("cos") >= least, F.lit(False))
    n = fused.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(near).alias("eligible"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").na.fill(0, ["candidates", "eligible"])


def attached(hits: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """Hits with the fields of their documents, as a page shows them; a document that went since stays as nulls (JN2, PP22)."""
    return hits.join(docs.select("doc_id", *fields), "doc_id", "left")


def recent(candidates: DataFrame, dates: DataFrame, as_of: Column, half_life_days: float) -> DataFrame:
    """``query_id, doc_id, decay, rank`` of the candidates that have a date (WN4)."""
    dated = candidates.select("query_id", "doc_id").distinct().join(dates.select("doc_id", "at"), "doc_id").where("at is not null")
    return ranked(dated.select("query_id", "doc_id", recency(F.col("at"), as_of, half_life_days).alias("decay")), F.desc("decay"))


def fuse(legs: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``query_id, doc_id, score`` and each leg's rank, by weighted reciprocal ranks (MD1); ``cos`` of legs that have it.

    A union and one aggregation, in place of a chain of full outer joins: one shuffle for any number of legs.
    """
    parts = [
        df.select("query_id", "doc_id", F.lit(name).alias("leg"), "rank", (F.lit(float(w)) / (SMOOTH + F.col("rank"))).alias("part"), (F.col("cos") if "cos" in df.columns else F.lit(None).cast("double")).alias("cos"))
        for name, (df, w) in legs.items()
        if w
    ]
    whole = reduce(DataFrame.unionByName, parts)
    ranks = [F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs]
    # The parts are added in the order of the legs, so that equal inputs give equal sums.
    score = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("leg") == name, F.col("part"))), F.lit(0.0)) for name in legs])
    return whole.groupBy("query_id", "doc_id").agg(score.alias("score"), *ranks, F.max("cos").alias("cos"))


def linear(legs: dict[str, tuple[DataFrame, str, float]]) -> DataFrame:
    """``query_id, doc_id, score``: a weighted sum of the named score column of each leg (MD2)."""
    parts = [df.select("query_id", "doc_id", F.lit(name).alias("leg"), (F.col(c) * float(w)).alias("part")) for name, (df, c, w) in legs.items()]
    score = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("leg") == name, F.col("part"))), F.lit(0.0)) for name in legs])
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(score.alias("score"))


def floor(fused: DataFrame, least: float, lexical_leg: str = "fts") -> DataFrame:
    """Documents that match in words or are near enough in meaning (FLT18)."""
    return fused.where(F.col(f"{lexical_leg}_rank").isNotNull() | (F.col("cos") >= least))


def _anchored(hits: DataFrame, min_anchor: float) -> DataFrame:
    """Hits with ``anchored`` for their query; queries with no word in common and nothing near lose all of them."""
    w = Window.partitionBy("query_id")
    out = hits.withColumn("anchored", F.max("fts").over(w)).withColumn("top", F.max("cos").over(w))
    return out.where(F.col("anchored") | F.col("top").isNull() | (F.col("top") >= min_anchor)).drop("top")


def score_drop(hits: DataFrame, max_drop: float = 0.5, min_anchor: float = 0.3) -> DataFrame:
    """Hits ``query_id, doc_id, rank, fts, cos`` before a cliff of the cosine, and lexical ones behind it (MD11, WN8).

    A semantic hit sets the baseline of the next; lexical ones may raise it, not lower it. Only windows over one
    query's short list.
    """
    by = Window.partitionBy("query_id").orderBy("rank")
    known = _anchored(hits, min_anchor).withColumn("semantic", (~F.col("fts") & F.col("cos").isNotNull()).cast("int"))
    # A segment begins with a semantic hit and holds the lexical ones after it; its greatest cosine is the baseline of the next.
    known = known.withColumn("segment", F.sum("semantic").over(by))
    baseline = F.max("cos").over(Window.partitionBy("query_id", "segment"))
    known = known.withColumn("own", baseline)
    # `own` is equal within a segment: that of the row before a segment's first is the baseline of the segment before it.
    known = known.withColumn("before", F.lag("own").over(by))
    falls = (F.col("semantic") == 1) & (F.col("cos") < F.col("before") * (1 - max_drop))
    cliff = F.min(F.when(falls, F.col("rank"))).over(Window.partitionBy("query_id"))
    return known.withColumn("cliff", cliff).where(F.col("cliff").isNull() | (F.col("rank") < F.col("cliff")) | F.col("fts")).drop("anchored", "semantic", "segment", "own", "before", "cliff")


def coherence(hits: DataFrame, value: str, least: float = 0.5, top: int = 10, min_anchor: float = 0.3) -> DataFrame:
    """Queries without a lexical hit keep theirs only if the first ``top`` mostly share one value (MD11)."""
    known = _anchored(hits, min_anchor)
    head = known.where((F.col("rank") <= top) & F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy("query_id", value).agg(F.count("*").alias("n"))
    share = head.groupBy("query_id").agg((F.max("n") / F.sum("n")).alias("majority"))
    return known.join(share, "query_id", "left").where(F.col("anchored") | F.col("majority").isNull() | (F.col("majority") >= least)).drop("anchored", "majority")


def diversify(hits: DataFrame, group: str, by: str | None = None) -> DataFrame:
    """The best hit of each group of a query, by score or by the least of another column; hits without a group all stay (WN7)."""
    first = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.asc(by) if by else F.desc("score"), F.asc("doc_id")))
    lone = F.col(group).isNull() | (F.col(group).cast("string") == "")
    return hits.withColumn("_nth", first).where(lone | (F.col("_nth") == 1)).drop("_nth")


def policy(hits: DataFrame, available: Column, business: Column, newness: Column, weights: dict[str, float], floor_: float = 0.0, exponent: float = 1.0, bury: float = 0.2, visual: Column | None = None, personal: Column | None = None, hard: tuple[str, ...] = ("availability",), burying: bool = True) -> DataFrame:
    """Hits with ``policy_score``: relevance between the query's least and most, times hard axes, plus soft ones (MD9).

    Availability and business may be hard: factors to the power of their weight. An unavailable hit has the factor
    ``bury``, or 0 if nothing is buried; where availability isn't hard, it is buried by that factor all the same.
    Newness, business, visual likeness and personal taste are soft and add up, all but taste between 0 and 1.
    """
    w = Window.partitionBy("query_id")
    least, most = F.min("score").over(w), F.max("score").over(w)
    out = hits.withColumn("relevance", F.when(most > least, (F.col("score") - least) / (most - least)).otherwise(1.0)).where(F.col("relevance") >= floor_)
    there = F.coalesce(available, F.lit(True))
    product = F.pow("relevance", F.lit(exponent * weights.get("relevance", 1.0)))
    if "availability" in hard:
        product = product * F.pow(F.when(there, 1.0).otherwise(bury if burying else 0.0), F.lit(weights.get("availability", 0.2)))
    elif burying:
        product = product * F.when(there, 1.0).otherwise(bury)
    if "business" in hard and weights.get("business", 0.0) > 0:
        product = product * F.pow(clamp(business), F.lit(weights["business"]))
    soft = {"newness": clamp(newness), "business": clamp(business), "visual": clamp(visual) if visual is not None else None, "personalization": F.coalesce(personal, F.lit(0.0)) if personal is not None else None}
    for axis, value in soft.items():
        if axis not in hard and value is not None and weights.get(axis):
            product = product + value * weights[axis]
    return out.withColumn("policy_score", product)


def blend(hits: DataFrame, rerank: str, head: float = 0.75, mid: float = 0.6, tail: float = 0.4) -> DataFrame:
    """Hits with a reranker's score get new places among themselves; the others keep theirs (MD8 of ranks, WN9).

    The blended score weighs ``1 / rank`` by how far up a hit was. ``place`` is the new rank.
    """
    weight = F.when(F.col("rank") <= 3, head).when(F.col("rank") <= 10, mid).otherwise(tail)
    mixed = hits.withColumn("blended", F.when(F.col(rerank).isNotNull(), weight / F.col("rank") + (1 - weight) * clamp(F.col(rerank))))
    scored = F.col("blended").isNotNull()
    by = Window.partitionBy("query_id", scored)
    known = mixed.withColumn("_slot", F.row_number().over(by.orderBy("rank"))).withColumn("_nth", F.row_number().over(by.orderBy(F.desc("blended"), "rank")))
    slots = known.where(scored).select("query_id", F.col("_slot").alias("_nth"), F.col("rank").alias("_place"))
    return known.join(slots, ["query_id", "_nth"], "left").withColumn("place", F.when(scored, F.col("_place")).otherwise(F.col("rank"))).drop("_slot", "_nth", "_place")


def relax(count, order: list[str], target: int) -> tuple[list[str], int]:
    """Soft fields to drop, one after another, until ``count(dropped)`` reaches the target (SE5); a loop over few jobs."""
    dropped: list[str] = []
    n = count(dropped)
    for name in order:
        if n >= target:
            break
        dropped.append(name)
        n = count(dropped)
    return dropped, n


def grep(docs: DataFrame, pattern: str, around: int = 30, most: int = 50) -> DataFrame:
    """``doc_id, nth, match, context`` of the first ``most`` matches of each text (SC11).

    Contexts come from splitting the text at its matches, so that every match has its own.
    """
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    between = F.split("text", pattern)
    rows = docs.select("doc_id", found.alias("found"), between.alias("between")).select("doc_id", "between", F.posexplode(F.slice("found", 1, most)).alias("at", "match"))
    left = F.coalesce(F.get("between", F.col("at")), F.lit(""))
    right = F.coalesce(F.get("between", F.col("at") + 1), F.lit(""))
    return rows.select("doc_id", (F.col("at") + 1).alias("nth"), "match", F.concat(F.right(left, F.lit(around)), F.col("match"), F.left(right, F.lit(around))).alias("context"))


def offers(hits: DataFrame, members: DataFrame, group: str, *fields: str) -> DataFrame:
    """Hits with the offers of their group, in order of the fields (JN15)."""
    wanted = members.join(hits.select(group).distinct(), group, "left_semi")
    listed = wanted.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("offers"))
    return hits.join(listed, group, "left")


def ground(inputs: DataFrame, vocabulary: DataFrame, similarity, least: float = 0.4) -> DataFrame:
    """``field, input, value, how`` of values that a query names: kept if known, else mapped to the nearest known value
    of the field, else dropped (SE21). ``similarity`` is of two Columns; few inputs meet the field's vocabulary."""
    exact = vocabulary.select("field", F.lower("value").alias("_low"), F.col("value").alias("_same")).groupBy("field", "_low").agg(F.min("_same").alias("_same"))
    known = inputs.join(exact, (inputs["field"] == exact["field"]) & (F.lower(inputs["input"]) == exact["_low"]), "left").select(inputs["field"], inputs["input"], "_same")
    near = small(inputs).join(vocabulary, "field").withColumn("_sim", similarity(F.col("input"), F.col("value")))
    nth = F.row_number().over(Window.partitionBy("field", "input").orderBy(F.desc("_sim"), F.desc("n"), F.asc("value")))
    best = near.withColumn("_nth", nth).where("_nth = 1").select("field", "input", F.col("value").alias("_near"), "_sim")
    both = known.join(best, ["field", "input"], "left")
    how = F.when(F.col("_same").isNotNull(), "kept").when(F.col("_sim") >= least, "mapped").otherwise("dropped")
    return both.select("field", "input", F.when(how == "kept", F.col("_same")).when(how == "mapped", F.col("_near")).alias("value"), how.alias("how"))


def reranked(hits: DataFrame, text: Column, judge: Callable[[str, list[str]], list[float | None]], queries: DataFrame, pool: int = 50) -> DataFrame:
    """Hits with the ``place`` that an injected judge of ``(query, texts)`` gives the first ``pool`` of each query (SE9, MD14,
    TK5, UD4); its grades are from 0 to 1, and null for what it can't judge.

    Whatever it raises leaves that query in its first order. The pool bounds what one call sees.
    """
    head = hits.where(F.col("rank") <= pool).withColumn("_text", text).join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    listed = head.groupBy("query_id", "_query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "_text"))).alias("list"))
    kind = {f: hits.schema[f].dataType.simpleString() for f in ("query_id", "doc_id")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, asked, rows in zip(f["query_id"], f["_query"], f["list"]):
                try:
                    grades = judge(asked, [r["_text"] for r in rows])
                    if len(grades) != len(rows):
                        raise ValueError("a grade for each text")
                except Exception:  # noqa: BLE001 - the first order stands
                    grades = [None] * len(rows)
                out += [(q, r["doc_id"], None if g is None else float(g)) for r, g in zip(rows, grades)]
            yield pd.DataFrame(out, columns=["query_id", "doc_id", "_grade"])

    graded = listed.mapInPandas(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, _grade double")
    return blend(hits.join(graded, ["query_id", "doc_id"], "left"), "_grade").drop("_grade")


def bag_search(docs: DataFrame, queries: DataFrame, keep: Column | None = None, k: int = 10) -> DataFrame:
    """``query_id, doc_id, overlap, rank`` of the ``k`` documents that share most words, filtered first: the plain search
    that evaluations compare with (SE22)."""
    return lexical(docs if keep is None else docs.where(keep), queries, k).select("query_id", "doc_id", "overlap", "rank")


def one_each(hits: DataFrame, *identity: str) -> DataFrame:
    """The best hit of each product by its identity, title and brand for one, case and blanks aside (SE23)."""
    key = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in identity])
    blank = F.regexp_replace(key, r"[|\s]", "") == ""
    return diversify(hits.withColumn("_key", F.when(~blank, key)), "_key").drop("_key")
