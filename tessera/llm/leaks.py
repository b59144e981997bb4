"""Benchmark passages in the corpus, paraphrases included, by latent semantic retrieval.

1. Texts are parted into blocks of ``BLOCK`` words; two blocks in a row are a passage, so that passages overlap by
   half. Terms are hashed to ``TERMS`` columns and weighted by tf-idf; document frequencies count all passages.
2. A randomised SVD of the matrix of all passages is distributed: with a random matrix O, each task sums
   A'(A O) over its own passages; from the sum Y over all tasks, the Nystroem form Y (O'Y)^-1 Y' of A'A gives the
   singular vectors (Halko, Martinsson and Tropp). What is summed has a size set by TERMS and RANK, not by the corpus.
3. Every benchmark item is a query: all passages whose cosine to it in the latent space is ``NEAR`` or more, in any of
   the item's own windows, are candidates. A short item's words are drowned by those around it in a passage, so places
   are searched by words as well: what step 4 accepts holds some of the item's rarest words close together, whatever
   the item's length, so that no place which it accepts is missed.
4. Candidates are verified on the words: the longest common subsequence of the item and the text around the passage
   must cover ``COVERED`` of the item, or ``LOOSE`` if the item's answer, its rarest words, is there as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import documents
from tessera.llm.tokens import U64, Words, slices

BLOCK = 16
TERMS, RANK, EXTRA = 1 << 14, 64, 8
#: The least cosine of a candidate.
NEAR = 0.5
#: Shares of an item's words that a common subsequence must cover: without, and with the answer.
COVERED, LOOSE = 0.7, 0.5
#: The answer: the share of an item's words, its rarest, and how much of them a text must hold.
ANSWER, ANSWERED = 0.3, 0.8
#: The share of an item's words that a place must hold among its rarest ones to be looked at: more are read, fewer places remain.
SEEN = 0.2
#: Terms in more than this share of passages, of which ``UNSEEN`` more are thought to be there, weigh nothing in the latent
#: space. Items of such words alone are found by words, as all items are (step 3).
COMMON, UNSEEN = 0.01, 2000
#: Splits of the table that one task of the decomposition reads: what is shuffled is a sum of fixed size from each.
SPLITS = 8
#: Rows of a piece of a sum (:func:`_products`).
PIECE = 8
#: Parts in which the tasks' sums are added up first.
PARTS = 32


def _terms(word: np.ndarray) -> np.ndarray:
    return (word >> U64(64 - 14)).astype(np.int64)


def _blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each word, counted over all rows; the row of each block; the first word of each block."""
    count = np.diff(w.first)
    blocks = -(-count // BLOCK)
    base = np.cumsum(blocks) - blocks
    nth = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    row = np.repeat(np.arange(len(count)), blocks)
    first = w.first[row] + (np.arange(len(row)) - base[row]) * BLOCK
    return np.repeat(base, count) + nth // BLOCK, row, first


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``group``, which is sorted."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(group):
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[head]] = np.add.reduceat(values, head, axis=0)
    return out


def _products(table: np.ndarray, at: np.ndarray, value: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Rows ``at`` of ``table``, each times its ``value``, summed by ``group``, which is sorted.

    Groups are filled up to whole pieces of ``PIECE`` rows, so that a piece is one small matrix product.
    """
    count = np.bincount(group, minlength=n)
    pieces = -(-count // PIECE)
    base, total = np.cumsum(pieces) - pieces, int(pieces.sum())
    slot = np.arange(len(group)) + np.repeat(base * PIECE - (np.cumsum(count) - count), count)
    index, weight = np.zeros(total * PIECE, np.int64), np.zeros(total * PIECE, np.float32)
    index[slot], weight[slot] = at, value
    index, weight = index.reshape(-1, PIECE), weight.reshape(-1, 1, PIECE)
    sums = np.empty((total, table.shape[1]), np.float32)
    for lot in range(0, total, 256):  # what is gathered stays in the cache
        sums[lot : lot + 256] = np.matmul(weight[lot : lot + 256], table[index[lot : lot + 256]])[:, 0]
    out = np.zeros((n, table.shape[1]), np.float32)
    some = np.flatnonzero(pieces)
    out[some] = sums[base[some]]
    more = np.ones(total, bool)
    more[base[some]] = False
    return out + _sums(sums[more], np.repeat(np.arange(n), pieces)[more], n) if more.any() else out


def _block_sums(table: np.ndarray, w: Words, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The table's rows of each block's words, summed; the table's last row is zero."""
    at = first[:, None] + np.arange(BLOCK)
    term = np.append(_terms(w.hash), TERMS)
    index = np.where(at < w.first[row + 1][:, None], term[np.minimum(at, len(term) - 1)], TERMS)
    out = np.empty((len(first), table.shape[1]), np.float32)
    for lot in range(0, len(first), 512):  # what is gathered stays in the cache
        np.add.reduce(table[index[lot : lot + 512]], axis=1, out=out[lot : lot + 512])
    return out


def _weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([table * idf[:, None], np.zeros((1, table.shape[1]), np.float32)]).astype(np.float32)


def _pairs(w: Words) -> tuple[np.ndarray, int]:
    """Distinct (non-overlapping passage, term) as one sorted number each, and the number of passages."""
    block, row, _ = _blocks(w)
    if not len(block):
        return np.zeros(0, np.int64), 0
    passage_of_block = _passages(row, len(w.first) - 1)
    return np.sort((passage_of_block[block] << 14) | _terms(w.hash)), int(passage_of_block[-1]) + 1


def _passages(row: np.ndarray, rows: int) -> np.ndarray:
    """The non-overlapping passage of each block: two blocks of a row in turn."""
    first_of_row = np.searchsorted(row, np.arange(rows))
    return np.cumsum(np.append(0, (np.diff(row) != 0) | ((np.arange(1, len(row)) - first_of_row[row[1:]]) % 2 == 0)))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of the whole corpus each term is, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for b in slices(batches, "text"):
            pairs, passages = _pairs(Words(b.column("text")))
            new = np.append(True, pairs[1:] != pairs[:-1]) if len(pairs) else np.zeros(0, bool)
            df += np.bincount(pairs[new] & (TERMS - 1), minlength=TERMS)
            n += passages
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        np.add.at(out, r.column("term").to_numpy(), r.column("n").to_numpy())
    return out[:TERMS], int(out[TERMS])


def weights(df: np.ndarray, passages: int) -> np.ndarray:
    """Inverse document frequencies; 0 for terms of too many passages."""
    idf = np.log((1 + passages) / (1 + df)).astype(np.float32)
    idf[df > COMMON * (passages + UNSEEN)] = 0
    return idf


def directions(texts: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 0) -> np.ndarray:
    """``TERMS x rank``: the leading right singular vectors of the passages' tf-idf matrix over their singular values.

    Over the singular values, as a query is folded into a latent space: else the few directions that all passages
    share would make any two of them alike.
    """
    omega = np.random.default_rng(seed).normal(size=(TERMS, rank + EXTRA)).astype(np.float32)
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((idf, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = sent.value
        y = np.zeros(omega.shape, np.float32)
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            pairs, n = _pairs(w)
            if not len(pairs):
                continue
            new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            times = np.diff(np.append(new, len(pairs)))
            passage, term = pairs[new] >> 14, pairs[new] & (TERMS - 1)
            value = idf[term] * times
            live = value > 0
            passage, term, value = passage[live], term[live], value[live]
            norm = np.sqrt(np.bincount(passage, value * value, n))
            norm = np.maximum(norm, 1e-9)
            value = (value / norm[passage]).astype(np.float32)
            z = _products(omega, term, value, passage, n)
            order = np.argsort(term.astype(np.uint16), kind="stable")
            y += _products(z, passage[order], value[order], term[order], TERMS)
        task, part = TaskContext.get().partitionId() % PARTS, 1 << 10
        for i in range(0, TERMS, part):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([task]), pa.array([y[i : i + part].tobytes()], pa.binary())], ["at", "part", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, y in zip(b.column("at").to_pylist(), b.column("y").to_pylist()):
                y = np.frombuffer(y, np.float32)
                total[at] = total[at] + y if at in total else y.copy()
        for at, y in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([y.tobytes()], pa.binary())], ["at", "y"])

    # A task reads a bounded number of splits, so that its time doesn't follow the table's size; the sums, of a fixed
    # size each, are all that is shuffled, and are added up in two steps.
    few = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // SPLITS))
    y = np.zeros(omega.shape, np.float64)
    sums = few.mapInArrow(sketch, "at long, part long, y binary").repartition("at", "part").select("at", "y").mapInArrow(add, "at long, y binary")
    for r in sums.repartition("at").mapInArrow(add, "at long, y binary").collect():
        part = np.frombuffer(r.y, np.float32).reshape(-1, omega.shape[1])
        y[r.at : r.at + len(part)] += part
    core = omega.astype(float).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-6
    if not good.any():
        return np.zeros((TERMS, rank), np.float32)
    u, sigma, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    k = min(rank, int((sigma > sigma[0] * 1e-3).sum()))
    out = np.zeros((TERMS, rank), np.float32)
    out[:, :k] = u[:, :k] / (sigma[:k] / sigma[0])
    return out


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each of ``a``'s words (Hyyroe)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        if m := at.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & whole
    return len(a) - row.bit_count()


class Items:
    """Benchmark items as latent queries, with what verification needs."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, v: np.ndarray, df: np.ndarray):
        self.ids = [i for i, _ in rows]
        w = Words(pa.array([t for _, t in rows], pa.string()))
        self.words = [w.hash[a:b].tolist() for a, b in zip(w.first, w.first[1:])]
        self.counts = [Counter(words) for words in self.words]
        self.answers = []
        for words in self.words:
            rare = sorted(set(words), key=lambda h: (-idf[h >> 50], h))
            self.answers.append(set(rare[: max(1, round(ANSWER * len(rare)))]) if rare else set())
        # Items longer than a passage are queried by windows of a passage's length at every half.
        vectors, owner = [], []
        for k, words in enumerate(self.words):
            for s in range(0, max(1, len(words) - BLOCK), BLOCK):
                part = np.array(words[s : s + 2 * BLOCK], U64)
                if len(part):
                    term = _terms(part)
                    vectors.append((v[term] * idf[term, None]).sum(axis=0))
                    owner.append(k)
        self.owner = np.array(owner, np.int64)
        q = np.array(vectors, np.float32).reshape(len(owner), v.shape[1])
        self.query = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        self.longest = max(map(len, self.words), default=0)
        # Of an item's rarest words, so many that a text which covers COVERED of the item, and so lacks at most the rest,
        # holds `need` of them; the answer is among them, and LOOSE asks for ANSWERED of it.
        keys, owner, self.need = [], [], np.ones(len(self.words), np.int64)
        self.span = np.array([int(1.5 * len(words)) + 1 for words in self.words], np.int64)
        for k, words in enumerate(self.words):
            n, held = len(words), 0
            need = max(1, int(SEEN * n))
            lacking = n - int(np.ceil(COVERED * n - 1e-9))
            for h in sorted(self.answers[k], key=lambda h: (df[h >> 50], h)) + sorted(self.counts[k].keys() - self.answers[k], key=lambda h: (df[h >> 50], h)):
                if held >= lacking + need and h not in self.answers[k]:
                    break
                keys.append(h)
                owner.append(k)
                held += self.counts[k][h]
            self.need[k] = max(1, min(need, int(np.ceil(ANSWERED * len(self.answers[k]) - 1e-9))))
        keys, owner = np.array(keys, U64), np.array(owner, np.int64)
        order = np.argsort(keys, kind="stable")
        self.key, first = np.unique(keys[order], return_index=True)
        self.key_first, self.key_owner = np.append(first, len(keys)), owner[order]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.key >> U64(48)).astype(np.int64)] = True


def _places(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, item, first word, last word)`` of each place with enough of an item's rarest words in its span."""
    at = np.flatnonzero(items.likely[(w.hash >> U64(48)).astype(np.int64)])
    key = np.minimum(np.searchsorted(items.key, w.hash[at]), len(items.key) - 1)
    same = items.key[key] == w.hash[at]
    at, key = at[same], key[same]
    times = items.key_first[key + 1] - items.key_first[key]
    ends = np.cumsum(times)
    item = items.key_owner[np.repeat(items.key_first[key] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)]
    order = np.argsort(item.astype(np.uint16) if len(items.words) < 1 << 16 else item, kind="stable")
    at, item = np.repeat(at, times)[order], item[order]
    here = np.arange(len(at))
    there = here + items.need[item] - 1
    last = np.minimum(there, len(at) - 1)
    row = w.row[at]
    good = np.flatnonzero((there < len(at)) & (item[last] == item) & (row[last] == row) & (at[last] - at < items.span[item]))
    at, to, item, row = at[good], at[last[good]], item[good], row[good]
    # Those that begin within the same span of words are one place.
    part = at // items.span[item]
    new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(at) else at
    return row[new], item[new], at[new], np.maximum.reduceat(to, new) if len(at) else to


def _found(w: Words, items: Items, table: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """``(row, item, covered, first word, end word)`` of verified candidates, the best one of each row and item."""
    _, row, first = _blocks(w)
    if not len(row) or not len(items.owner):
        return []
    latent = _block_sums(table, w, row, first)
    two = latent.copy()
    same = row[1:] == row[:-1]
    two[:-1][same] += latent[1:][same]
    # The last block of a text stands alone only if it is the only one.
    use = np.append(same, False) | (np.append(True, ~same))
    at = np.flatnonzero(use)
    two = two[at] / np.maximum(np.linalg.norm(two[at], axis=1, keepdims=True), 1e-9)
    best: dict[tuple[int, int], tuple] = {}

    def verify(r: int, k: int, lo: int, hi: int) -> None:
        words = items.words[k]
        n = len(words)
        text = w.hash[lo:hi].tolist()
        mine = items.counts[k]
        # No common subsequence is longer than the item's words that are here at all.
        if sum(mine[x] for x in mine.keys() & set(text)) < LOOSE * n:
            return
        hits = [i for i, x in enumerate(text) if x in mine]
        # All stretches of 1.5 times the item's length that begin with one of its words and hold enough of them.
        ends = np.searchsorted(hits, np.array(hits) + int(items.span[k])).tolist()
        held: Counter = Counter()
        shared = end = 0
        for i, stop in enumerate(ends):
            for j in range(end, stop):
                x = text[hits[j]]
                held[x] += 1
                shared += held[x] <= mine[x]
            # A stretch that ends where the one before does is part of it.
            if shared >= LOOSE * n and stop > end:
                part = text[hits[i] : hits[stop - 1] + 1]
                covered = common_subsequence(words, part) / n
                answered = len(items.answers[k] & set(part)) >= ANSWERED * len(items.answers[k])
                if (covered >= COVERED or (covered >= LOOSE and answered)) and covered > best.get((r, k), (0, 0, 0.0))[2]:
                    best[(r, k)] = (r, k, covered, lo + hits[i], lo + hits[stop - 1] + 1)
            end = stop
            x = text[hits[i]]
            shared -= held[x] <= mine[x]
            held[x] -= 1

    seen: set[tuple[int, int]] = set()
    for lot in range(0, len(at), 4096):
        p, q = np.divmod(np.flatnonzero(two[lot : lot + 4096] @ items.query.T >= NEAR), len(items.query))
        for b, k in zip(at[lot + p].tolist(), items.owner[q].tolist()):
            if (b, k) in seen:
                continue
            seen.add((b, k))
            r, n = int(row[b]), len(items.words[k])
            verify(r, k, max(int(w.first[r]), int(first[b]) - n), min(int(w.first[r + 1]), int(first[b]) + 2 * BLOCK + n))
    for r, k, a, z in zip(*(x.tolist() for x in _places(w, items))):
        span = int(items.span[k])
        verify(r, k, max(int(w.first[r]), a - span), min(int(w.first[r + 1]), z + span))
    return sorted(best.values())


def _model(docs: DataFrame, benchmark: DataFrame):
    texts = documents(docs, "doc_id", "text").select("text")
    df, n = frequencies(texts)
    idf = weights(df, n)
    v = directions(texts, idf)
    rows = [(r.item_id, r.text) for r in benchmark.where("item_id is not null and text <> ''").select("item_id", "text").distinct().orderBy("item_id", "text").collect()]
    items = Items(rows, idf, v, df)
    return docs.sparkSession.sparkContext.broadcast((items, _weighted(v, idf)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, covered, start, end`` of each benchmark item in each text; positions are characters.

    Every item is searched in all passages of whole texts, whatever their length. Null and empty texts and items match
    nothing; rows with a null id are left out; repeated rows give repeated results, items that repeat count once. Of
    places of one item in a text that cover equally much, the first one found is given. Other columns don't matter;
    an empty table on either side gives an empty result. The benchmark is held by every worker: it is a test set, and
    doesn't grow with the corpus.
    """
    sent = _model(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = sent.value
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            hits = _found(w, items, table)
            if not hits:
                continue
            letters = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
            place = lambda byte, r: int(letters[byte] - letters[w.offsets[r]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([h[0] for h in hits])), pa.array([items.ids[h[1]] for h in hits], pa.int64()), pa.array([round(h[2], 6) for h in hits]), pa.array([place(w.start[h[3]], h[0]) for h in hits], pa.int32()), pa.array([place(w.end[h[4] - 1], h[0]) for h in hits], pa.int32())],
                ["doc_id", "item_id", "covered", "start", "end"],
            )

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, covered double, start int, end int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, with all their columns; in one pass, without a join.

    Rows with a null id go; null and empty texts hold no item and stay, as do repeated rows, columns of any name and
    nulls in them. An empty table gives an empty one; without items all rows with an id stay.
    """
    docs = docs.where(docs["doc_id"].isNotNull())
    sent = _model(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = sent.value
        for b in slices(batches, "text"):
            keep = np.ones(b.num_rows, bool)
            keep[[h[0] for h in _found(Words(b.column("text")), items, table)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
