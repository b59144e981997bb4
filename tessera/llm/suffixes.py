"""Passages that the corpus repeats, found by sorting suffixes.

Only suffixes that could begin a repeated passage are sorted, and nothing that begins one is left out:

1. Every window of ``PASSAGE`` words has a seed, the smallest hash of its ``GRAM``-word grams. Equal windows have
   equal seeds, so a seed that one place alone has can't belong to a repeated passage. Neighbouring windows mostly
   share their seed; such a run of windows is one row. Seeds with one place drop out.
2. The words of the remaining runs go to the partition of their seed. There the suffixes of all runs of a seed are
   put in order by deep-shallow sorting (Manzini and Ferragina): multikey quicksort to ``SHALLOW`` words, then a
   blind trie for each group whose common prefix is longer. Neighbours with ``PASSAGE`` common words are repeats.
3. Windows that repeat are joined to spans of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import documents
from tessera.llm.tokens import _BASE, _INVERSE, U64, Words, _powers, longs, mix, ngrams, slices

#: Words of the shortest passage that counts.
PASSAGE = 50
#: Words whose hash can be a seed.
GRAM = 8
#: Words to which multikey quicksort goes.
SHALLOW = 4


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each length in turn."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` entries in turn."""
    n, step, out = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while step * 2 <= width:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step : width - step + n])


def runs(w: Words, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, row, first window, number of windows and whether it holds its seed twice, of each run of windows."""
    gram = ngrams(w.hash, GRAM)
    width = passage - GRAM + 1
    least = sliding_least(gram, width)
    row = w.row
    at = np.flatnonzero(row[: len(least)] == row[passage - 1 :]) if len(least) else np.zeros(0, np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none, np.zeros(0, bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    span = count + width - 1
    seen = (gram[_spread(first, span)] == np.repeat(least[first], span)).astype(np.int64)
    twice = np.add.reduceat(seen, np.cumsum(span) - span) > 1
    return least[first], row[first], first, count, twice


def _refine(active: np.ndarray, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the groups of equal rank by key, write the new ranks, and give the members of groups of two or more."""
    order = np.lexsort((key, rank[active]))
    a, k = active[order], key[order]
    r, i = rank[a], np.arange(len(a))
    old = np.ones(len(a), bool)
    old[1:] = r[1:] != r[:-1]
    new = old.copy()
    new[1:] |= k[1:] != k[:-1]
    at = np.maximum.accumulate(np.where(new, i, 0))
    rank[a] = r + at - np.maximum.accumulate(np.where(old, i, 0))
    size = np.diff(np.append(np.flatnonzero(new), len(a)))
    return a[np.repeat(size, size) > 1]


def deep_shallow(word: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int = PASSAGE, shallow: int = SHALLOW) -> np.ndarray:
    """The rank of each suffix ``word[start:start + depth]`` among all, groups first; equal suffixes have one rank.

    Multikey quicksort looks at one word after another, only in groups that are still equal, up to ``shallow``.
    A blind trie is then grown for each remaining group, one level of all tries at a time: a node skips the words
    that its suffixes share, found by bisection over prefix hashes, and branches on the next.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.searchsorted(sorted_, sorted_)
    active = np.arange(n)
    for d in range(min(shallow, depth)):
        if not len(active):
            return rank
        active = _refine(active, rank, word[start[active] + d])
    power, inverse = _powers(_BASE, len(word) + 1), _powers(_INVERSE, len(word) + 1)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * power[:-1], out=total[1:])

    def prefix(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (total[at + length] - total[at]) * inverse[at]

    while len(active):
        active = active[np.argsort(rank[active], kind="stable")]
        r = rank[active]
        head = np.ones(len(r), bool)
        head[1:] = r[1:] != r[:-1]
        node = np.flatnonzero(head)
        at = start[active]
        pivot = np.repeat(at[node], np.diff(np.append(node, len(r))))
        low, high = np.full(len(at), min(shallow, depth)), np.full(len(at), depth)
        while np.any(low < high):
            middle = (low + high + 1) // 2
            same = prefix(at, middle) == prefix(pivot, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        skip = np.repeat(np.minimum.reduceat(low, node), np.diff(np.append(node, len(r))))
        open_ = skip < depth
        active, at, skip = active[open_], at[open_], skip[open_]
        if len(active):
            active = _refine(active, rank, word[at + skip])
    return rank


def repeated_windows(texts: pa.Array, seed: np.ndarray, passage: int = PASSAGE) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of runs, the first word of each window of each run, and whether an equal window is elsewhere."""
    w = Words(texts)
    count = np.maximum(0, np.diff(w.first) - passage + 1)
    start = _spread(w.first[:-1], count)
    run = np.repeat(np.arange(len(count)), count)
    power, inverse = _powers(_BASE, len(w.hash) + 1), _powers(_INVERSE, len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * power[:-1], out=total[1:])
    whole = mix((total[w.first[1:]] - total[w.first[:-1]]) * inverse[w.first[:-1]] + seed + count.astype(U64))
    _, one, of, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    single = np.zeros(len(count), bool)
    single[one] = True  # equal runs are sorted once
    chosen = single[run]
    rank = deep_shallow(w.hash, start[chosen], seed[run[chosen]], passage)
    _, back, ties = np.unique(rank, return_inverse=True, return_counts=True)
    found = np.zeros(len(start), bool)
    found[chosen] = ties[back] > 1
    begin = np.cumsum(count) - count
    from_ = begin[one[of]]
    found = found[_spread(from_, count)] | np.repeat(copies[of] > 1, count)
    return w, start, found


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = Words(b.column("text"))
        seed, row, first, _, twice = runs(w)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(longs(seed)), b.column("doc_id").take(take), b.column("version").take(take), pa.array(first - w.first[row], pa.int32()), pa.array(twice)], ["seed", "doc_id", "version", "first", "twice"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by seed, those whose seed has two places."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch | None:
        col = [rows.column(c).to_numpy() for c in ("seed", "doc_id", "version", "first")]
        differs = np.ones(len(rows), bool)
        differs[1:] = np.any([c[1:] != c[:-1] for c in col], axis=0)  # a row that is there twice counts once
        head = np.flatnonzero(np.append(True, col[0][1:] != col[0][:-1]))
        places = np.add.reduceat(differs.astype(np.int64) + rows.column("twice").to_numpy(zero_copy_only=False), head)
        keep = differs & (np.repeat(places, np.diff(np.append(head, len(rows)))) > 1)
        return rows.filter(pa.array(keep)).select(["doc_id", "version", "first"]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        seed = batch.column("seed").to_numpy()
        last = np.flatnonzero(seed != seed[-1])
        end = int(last[-1]) + 1 if len(last) else 0
        if end or not held:
            if end:
                yield from out(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
            held.append(batch.slice(end))
        else:
            first = held[0].column("seed")[0].as_py()
            if first != seed[0]:
                yield from out(pa.Table.from_batches(held))
                held = []
            held.append(batch)
    if held:
        yield from out(pa.Table.from_batches(held))


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = Words(b.column("text"))
        seed, row, first, count, _ = runs(w)
        wanted = b.column("firsts")
        owner = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy())
        hit = np.isin(row * (1 << 40) + first - w.first[row], owner * (1 << 40) + wanted.flatten().to_numpy())
        seed, row, first, count = seed[hit], row[hit], first[hit], count[hit]
        a, z = w.start[first], w.end[first + count + PASSAGE - 2]
        letters = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=letters[1:])
        raw = w.data.tobytes()
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(longs(seed)), b.column("doc_id").take(take), b.column("version").take(take), pa.array(letters[a] - letters[w.offsets[row]], pa.int32()), pa.array([raw[i:j] for i, j in zip(a.tolist(), z.tolist())], pa.binary()).cast(pa.string())],
            ["seed", "doc_id", "version", "at", "words"],
        )


def _repeats(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """From runs sorted by seed, the spans of repeated windows; a block holds all runs of its seeds."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        col = [rows.column(c).to_numpy() for c in ("seed", "doc_id", "version", "at")]
        differs = np.ones(len(rows), bool)
        differs[1:] = np.any([c[1:] != c[:-1] for c in col], axis=0)  # a row that is there twice counts once
        rows = rows.filter(pa.array(differs)).combine_chunks()
        text = rows.column("words")
        w, start, found = repeated_windows(text, rows.column("seed").to_numpy().view(U64))
        start = start[found]
        run = w.row[start] if len(start) else np.zeros(0, np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (run[1:] != run[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
        run, a, z = run[new], w.start[start[new]], w.end[start[last] + PASSAGE - 1]
        letters = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=letters[1:])
        shift = rows.column("at").to_numpy().astype(np.int64)[run] - letters[w.offsets[run]]
        take = pa.array(run)
        one = lambda c: rows.column(c).combine_chunks().take(take) if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c).take(take)
        return pa.RecordBatch.from_arrays([one("doc_id"), one("version"), pa.array(letters[a] + shift, pa.int32()), pa.array(letters[z] + shift, pa.int32())], ["doc_id", "version", "start", "end"])

    held, size = [], 0
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            part = batch.slice(s, 2000)
            seed = part.column("seed").to_numpy()
            if held and size > most:
                last = held[-1].column("seed")[-1].as_py()
                other = np.flatnonzero(seed != last)
                if len(other):
                    if other[0]:
                        held.append(part.slice(0, int(other[0])))
                    yield out(pa.Table.from_batches(held))
                    held, size, part = [], 0, part.slice(int(other[0]))
            held.append(part)
            size += part.nbytes
    if held:
        yield out(pa.Table.from_batches(held))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, covered = [], []
        for row in b.column("spans").to_pylist():
            merged: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in row):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            spans.append([{"start": s, "end": e} for s, e in merged])
            covered.append(sum(e - s for s, e in merged))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(covered, pa.int32()), pa.array(spans, kind)], ["doc_id", "repeated_chars", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, repeated_chars, spans`` for every text that has a passage found elsewhere, itself included.

    A passage is ``PASSAGE`` words or more, compared without case and signs; ``spans`` are the character positions
    of the words that such passages cover, merged and in order. Shorter, empty and null texts have none. Rows
    with a null id are left out; rows that repeat id and text count once; other texts of the same id count on their
    own and give a row each. Other columns don't matter.
    """
    texts = documents(docs, "doc_id", "text").withColumn("version", F.xxhash64("text"))
    places = texts.mapInArrow(_seeds, "seed long, doc_id long, version long, first int, twice boolean")
    shared = places.repartition("seed").sortWithinPartitions("seed", "doc_id", "version", "first").mapInArrow(_shared, "doc_id long, version long, first int")
    wanted = shared.groupBy("doc_id", "version").agg(F.collect_list("first").alias("firsts"))
    found = texts.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "firsts")
    cut = found.mapInArrow(_cut_runs, "seed long, doc_id long, version long, at int, words string")
    spans = cut.repartition("seed").sortWithinPartitions("seed", "doc_id", "version", "at").mapInArrow(_repeats, "doc_id long, version long, start int, end int")
    each = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return each.select("doc_id", "spans").mapInArrow(_spans, "doc_id long, repeated_chars int, spans array<struct<start:int,end:int>>")
