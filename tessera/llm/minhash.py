"""Near-duplicate documents by bottom-k sketches from one hash function.

Steps, none of them quadratic in a group's size:

1. Texts with the same set of shingles are one: a shuffle on a 128-bit fingerprint of the set.
2. Each distinct set keeps its ``SKETCH`` smallest hashes, which go to inverted lists;
   values that one document alone has drop out, and so do documents with fewer shared values than a partner would
   need. Partners share ``NEEDED`` values, so the rarest that they share is never among the ``NEEDED - 1`` most
   frequent of either: those are left out of the lists (prefix filtering), and with them the long lists of what many
   unlike documents have in common.
3. In each list a leader is compared with the others by the sketch of the union (:func:`list_links`). Those near it
   are linked to it alone; the rest have a leader of their own.
4. Links are verified by the exact Jaccard coefficient of the whole shingle sets: the best one of each document
   first, then those whose ends the verified ones haven't joined yet.
5. Where a list's documents are in several components by then, all those of different ones are compared with each
   other, and what may be near is verified: a link between two components is found whatever leaders they had.
6. Connected components of the verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import Written, cut, documents, release
from tessera.llm.tokens import U64, Words, longs, mix, ngrams, ragged, slices

#: Words in a shingle.
SHINGLE = 5
#: The least Jaccard coefficient of near copies: with shingles of 5 words, about one word in 15 differs.
NEAR = 0.4
#: Values that a sketch retains; a coefficient of 0.4 is estimated with a standard error of 0.06.
SKETCH = 64
#: Retained values that partners share. Of pairs at NEAR that are worst off, a set and a part of it, all but 0.003 % do:
#: of the larger one's values the smaller one has each with a chance of 0.4.
NEEDED = 10
#: Estimates this much below NEAR still count as near a leader: 2.5 standard errors.
SLACK = 0.15
#: The least estimate that is verified, in lists of two and between components: partners share NEEDED values.
FAINT = NEEDED / SKETCH
_TOP = np.iinfo(np.uint32).max


def shingles(w: Words, i: int) -> np.ndarray:
    """The sorted distinct shingle hashes of row ``i``; a text shorter than a shingle is one shingle."""
    word = w.hash[w.first[i] : w.first[i + 1]]
    if not len(word):
        return np.zeros(0, U64)
    return np.unique(ngrams(word, min(SHINGLE, len(word))))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = Words(b.column("text"))
        rows = b.num_rows
        sets = [shingles(w, i) for i in range(rows)]
        size = np.array([len(s) for s in sets])
        a = np.array([s.sum(dtype=U64) for s in sets], U64)
        c = np.array([np.bitwise_xor.reduce(mix(s + U64(size_))) if size_ else 0 for s, size_ in zip(sets, size)], U64)
        least = [s[:SKETCH] for s in sets]
        sketch = [np.unique((s[:SKETCH] >> U64(32)).astype(np.uint32)) for s in sets]  # half of the bits do for estimates
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array(longs(a)),
                pa.array(longs(c)),
                pa.array(size, pa.int32()),
                ragged(longs(np.concatenate(least)), np.array([len(s) for s in least]), pa.int64()),
                ragged(np.concatenate(sketch).view(np.int32), np.array([len(s) for s in sketch]), pa.int32()),
            ],
            ["doc_id", "f1", "f2", "size", "least", "sketch"],
        )


def union_estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch, or of as many, against many, from the bottom-k sketch of each union.

    Sketches are sorted and filled up with the largest number. Those that hold a whole set give the exact value.
    """
    both = np.sort(np.concatenate([np.broadcast_to(one, many.shape), many], axis=1), axis=1)
    real = both != _TOP
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new & real, axis=1)
    shared = (~new & real & (rank <= SKETCH)).sum(axis=1)
    return shared / np.maximum(1, np.minimum(rank[:, -1], SKETCH))


def list_links(sketch: np.ndarray, root: np.ndarray | None = None, least: float = NEAR - SLACK) -> list[tuple[int, int, float]]:
    """Links ``(i, j, estimate)`` among the documents of one list, by their positions in it.

    The leader is the document whose sketch has most in common with all others of the list. Those near it are linked
    to it alone; the others go on among themselves with a leader of their own, which is also compared with those
    linked so far unless the triangle inequality of the Jaccard distance rules a link out. With ``root``, the component
    of each document, all those of different components are compared instead.
    """
    n = len(sketch)
    links: list[tuple[int, int, float]] = []

    def compare(one: int, many: np.ndarray) -> np.ndarray:
        estimate = union_estimate(sketch[one], sketch[many]) if len(many) else np.zeros(0)
        links.extend((one, j, e) for j, e in zip(many[estimate >= least].tolist(), estimate[estimate >= least].tolist()))
        return estimate

    if root is not None:
        _, of, size = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((of, size[of]))  # the largest component comes last: its own documents have nothing to compare
        ends = np.cumsum(np.diff(np.flatnonzero(np.append(True, np.append(np.diff(of[order]) != 0, True)))))
        for end, first in zip(ends.tolist(), [0, *ends[:-1].tolist()]):
            for i in order[first:end].tolist() if end < n else ():
                compare(i, order[end:])
        return links
    _, of, times = np.unique(sketch, return_inverse=True, return_counts=True)
    common = (times[of].reshape(sketch.shape) * (sketch != _TOP)).sum(axis=1)
    rest, linked = np.argsort(-common, kind="stable"), np.zeros(0, np.int64)
    bound = np.zeros((0, n))  # distances to the first leaders, where they are known
    while len(rest) and (len(rest) > 1 or len(linked)):
        lead, rest = rest[0], rest[1:]
        if len(linked):
            compare(lead, linked[np.all(~(np.abs(bound[:, linked] - bound[:, [lead]]) > 1 - least), axis=0)])
        estimate = compare(lead, rest)
        if len(bound) < 8:
            row = np.full((1, n), np.nan)
            row[0, rest], row[0, lead] = 1 - estimate, 0
            bound = np.concatenate([bound, row])
        linked = np.concatenate([linked, [lead], rest[estimate >= least]])
        rest = rest[estimate < least]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by value: links of each list, once for each pair in a block of lists; by ``root`` where there is one."""

    def out(value, ids, sketch, root, rooted):
        edges = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        start, size = np.array(edges[:-1]), np.diff(edges)
        found = []
        two = start[size == 2]
        if len(two):  # most lists
            estimate = union_estimate(sketch[two], sketch[two + 1])
            hit = estimate >= FAINT
            found.append(np.rec.fromarrays([ids[two[hit]], ids[two[hit] + 1], estimate[hit]], names="a,b,e"))
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            part = slice(s, s + m)
            links = list_links(sketch[part], root[part], FAINT) if rooted[s] else list_links(sketch[part])
            if links:
                i, j, e = (np.array(x) for x in zip(*links))
                found.append(np.rec.fromarrays([ids[s + i], ids[s + j], e], names="a,b,e"))
        if not found:
            return None
        a, b, e = (np.concatenate([f[c] for f in found]) for c in "abe")
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((-e, b, a))
        a, b, e = a[order], b[order], e[order]
        new = (a != b) & np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(e[new])], ["a", "b", "estimate"])

    held: list[tuple] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column("value").to_numpy()
        length = batch.column("sketch").value_lengths().to_numpy()
        sketch = np.full((batch.num_rows, SKETCH), _TOP, np.uint32)
        sketch[np.arange(SKETCH) < length[:, None]] = batch.column("sketch").flatten().to_numpy().view(np.uint32)
        root = batch.column("root")
        held.append((value, batch.column("doc_id").to_numpy(), sketch, pc.fill_null(root, 0).to_numpy(), root.is_valid().to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count >= 20_000:
            columns = [np.concatenate(x) for x in zip(*held)]
            other = np.flatnonzero(columns[0] != columns[0][-1])
            if len(other):
                end = int(other[-1]) + 1
                if (r := out(*(c[:end] for c in columns))) is not None:
                    yield r
                columns = [c[end:] for c in columns]
            held, count = [tuple(columns)], len(columns[0])
    if held:
        if (r := out(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield r


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "one"), "two"):
        one, two = Words(batch.column("one")), Words(batch.column("two"))
        exact, text, last = [], None, None
        for i, first in enumerate(batch.column("a").to_pylist()):
            if first != text:
                text, last = first, shingles(one, i)
            other = shingles(two, i)
            both = np.sort(np.concatenate([last, other]))
            shared = int((both[1:] == both[:-1]).sum())
            exact.append(shared / max(1, len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(exact, pa.float64())], ["a", "b", "jaccard"])


def verified(texts: DataFrame, links: DataFrame) -> DataFrame:
    """The links whose exact Jaccard coefficient is NEAR or more; ``texts`` has one text for each id."""
    both = links.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a")
    return both.select("a", "b", "one", "two").mapInArrow(_verify, "a long, b long, jaccard double").where(F.col("jaccard") >= NEAR).select("a", "b")


def _sketched(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_sketches, "doc_id long, f1 long, f2 long, size int, least array<long>, sketch array<int>")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, group_id, group_size`` for every document that has a copy or near copy.

    The group's id is its smallest document id. Documents without any word (null, empty, signs only) are in no
    group. Rows with a null id are left out; rows that repeat an id count once, with the text that sorts first.
    Texts are read whole, whatever their length. Other columns don't matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = Written(_sketched(documents(docs, "doc_id", "text")))
    seen = table.df
    prints = F.struct("f1", "f2", "size")
    # Ids with texts that differ are few, if there are any: only their texts are shuffled.
    unlike = cut(seen.groupBy("doc_id").agg(F.min(prints).alias("low"), F.max(prints).alias("high")).where("low <> high").select("doc_id"))
    if not unlike.isEmpty():
        first = documents(docs, "doc_id", "text").join(unlike, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        again = Written(seen.join(unlike, "doc_id", "left_anti").unionByName(_sketched(first)))
        table.drop()
        table, seen = again, again.df
    seen = seen.where("size > 0")
    same = seen.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"))
    member = cut(seen.select("doc_id", "f1", "f2", "size").join(same, ["f1", "f2", "size"]).groupBy("doc_id").agg(F.min("rep").alias("rep")))
    distinct = Written(seen.select("doc_id", "size", "least", "sketch").join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    reps = distinct.df
    table.drop()
    release(spark)
    listed = reps.select("doc_id", "size", F.explode("least").alias("value"))
    common = listed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    shared = listed.join(common, "value")
    need = F.least(F.lit(NEEDED), F.ceil(F.lit(NEAR) * F.col("size")))
    rarest = F.sort_array(F.collect_list(F.struct("n", "value")))
    lists = shared.groupBy("doc_id", "size").agg(rarest.alias("values")).where(F.size("values") >= need).select("doc_id", F.explode(F.slice("values", F.lit(1), (F.size("values") - need + 1).cast("int"))).alias("of")).select("doc_id", "of.value")
    lists = cut(lists)
    release(spark)

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.join(reps.select("doc_id", "sketch"), "doc_id").repartition("value").sortWithinPartitions("value", "doc_id")
        return cut(rows.select("value", "doc_id", "sketch", "root").mapInArrow(_links, "a long, b long, estimate double").groupBy("a", "b").agg(F.max("estimate").alias("estimate")))

    def best(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "estimate")
        return ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", -F.col("a"), -F.col("b"))).alias("of")).select("of.a", "of.b").distinct()

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        end = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        return pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "estimate")

    def joined(pairs: DataFrame, sure: DataFrame | None = None, label: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Verified links and their components: the best link of each document first, then those still apart."""
        for choose in (best, lambda left: left.select("a", "b")):
            left = apart(pairs, label) if label else pairs
            more = verified(texts.df, cut(choose(left)))
            sure = cut(sure.unionByName(more) if sure else more)
            label = components(sure)
            release(spark)
        return sure, label

    pairs = linked(lists.withColumn("root", F.lit(None).cast("long")))
    release(spark)
    ends = lists.select("doc_id").distinct()
    texts = Written(documents(docs, "doc_id", "text").join(ends, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    release(spark)
    sure, label = joined(pairs)
    rooted = lists.join(label.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # Of two documents, the link has been verified.
    apart_in = rooted.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high").select("value")
    more = cut(linked(rooted.join(apart_in, "value", "left_semi")).join(pairs, ["a", "b"], "left_anti"))
    release(spark)
    if not more.isEmpty():
        sure, label = joined(more, sure, label)
    texts.drop()
    distinct.drop()
    found = member.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    sizes = found.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return found.join(sizes, "group_id").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """All documents but those of a group that isn't its smallest id; columns stay as they are.

    Rows with a null id go. Rows that repeat an id are one document: the row with the text that sorts first stays, of
    equal texts the one whose other columns do. Null and empty texts are in no group and stay, as do columns of any
    name and nulls in them. An empty table gives an empty one.
    """
    gone = near_groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias("_gone"))
    rows = docs.where(docs["doc_id"].isNotNull())
    left = rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti")
    twice = cut(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")))
    if twice.isEmpty():
        return left
    once = left.join(twice, left["doc_id"] == twice["_twice"], "left_anti")
    again = left.join(twice, left["doc_id"] == twice["_twice"], "left_semi")
    row = F.struct("*").alias("row")
    order = F.struct(F.col("row.text").isNull(), F.col("row.text"), F.to_json("row"))
    first = again.select(row).groupBy(F.col("row.doc_id").alias("_id")).agg(F.min_by("row", order).alias("row"))
    return once.unionByName(first.select("row.*"))
