"""Quality rules by repetition: the share of a text's characters inside repeated n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.shared import documents
from tessera.llm.tokens import _BASE, _INVERSE, U64, Words, _powers, flat, mix, ngrams, slices

#: The largest share of characters that repeated n-grams may cover, by n.
MOST = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The largest share of characters that repeated lines may cover.
MOST_LINES = 0.30
#: A single repeat of less than this share is no fault: one line said twice would else condemn a short text.
ONCE = 0.5
_SCHEMA = "doc_id long, n_words int, line_share double, " + ", ".join(f"gram{n}_share double" for n in MOST) + ", keep boolean"


def _again(key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    return out


def line_shares(column: pa.Array) -> np.ndarray:
    """Bytes in lines that equal an earlier line of the row, as a share of the bytes of all its lines.

    Lines end at a line feed; blank ones (spaces only) don't count.
    """
    return _lines(column)[0]


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shares of :func:`line_shares`, and which rows have one line again, once, and no other."""
    data, offsets = flat(column)
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(rows), np.zeros(rows, bool)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:] |= data == 10
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    end = end - (data[end - 1] == 10)
    ink = np.zeros(n + 1, np.int64)
    np.cumsum((data != 32) & (data != 9) & (data != 13) & (data != 10), out=ink[1:])
    full = ink[end] > ink[start]
    start, end = start[full], end[full]
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=total[1:])
    row = np.searchsorted(offsets, start, side="right") - 1
    key = mix(mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start]) + row.astype(U64))
    size = (end - start).astype(float)
    again = _again(key)
    return np.bincount(row, size * again, rows) / np.maximum(np.bincount(row, size, rows), 1), np.bincount(row, again, rows) == 1


def gram_shares(column: pa.Array, lengths: tuple[int, ...] = tuple(MOST)) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each row, and for each n the share of its words' bytes inside n-grams that an earlier n-gram equals.

    Each byte counts once, however many repeated n-grams cover it. A longer n-gram repeats only where both
    n-grams one word shorter do, so each length looks only at what the length before left.
    """
    return _grams(column, lengths)[:2]


def _grams(column: pa.Array, lengths: tuple[int, ...] = tuple(MOST)) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """What :func:`gram_shares` gives, and for each n which rows have one run of words again, once, and no other."""
    w = Words(column)
    rows, row, size = len(w.offsets) - 1, w.row, (w.end - w.start).astype(float)
    whole = np.maximum(np.bincount(row, size, rows), 1)
    out, single, live = {}, {}, None
    for n in sorted(lengths):
        gram = ngrams(w.hash, n)
        at = np.arange(len(gram)) if live is None else live[live < len(gram)]
        at = at[row[at] == row[at + n - 1]] if len(at) else at
        key = mix(gram[at] + row[at].astype(U64) * U64(_BASE))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later = at[order[1:][same]]
        either = np.zeros(len(key), bool)
        either[order[1:][same]] = either[order[:-1][same]] = True
        live = at[either]
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, later, 1)
        np.add.at(step, later + n, -1)
        inside = np.cumsum(step[:-1]) > 0
        out[n] = np.bincount(row, size * inside, rows) / whole
        # One run has one beginning; what is said a third time has n-grams that equal two earlier ones.
        later = np.sort(later)
        begins = np.append(True, (np.diff(later) > 1) | (row[later[1:]] != row[later[:-1]])) if len(later) else np.zeros(0, bool)
        third = np.append(False, same[1:] & same[:-1])[same] if len(same) else np.zeros(0, bool)
        thrice = row[at[order[1:][same]][third]]
        single[n] = (np.bincount(row[later], begins, rows) == 1) & (np.bincount(thrice, minlength=rows) == 0)
    return np.diff(w.first), out, single


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        n_words, grams, single = _grams(b.column("text"))
        lines, once = _lines(b.column("text"))
        fine = [(share <= most) | (one & (share < ONCE)) for share, most, one in ((lines, MOST_LINES, once), *((grams[n], MOST[n], single[n]) for n in MOST))]
        keep = np.all(fine, axis=0) & (n_words > 0)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int32()), pa.array(lines), *(pa.array(grams[n]) for n in MOST), pa.array(keep)],
            ["doc_id", "n_words", "line_share", *(f"gram{n}_share" for n in MOST), "keep"],
        )


def repetition(docs: DataFrame) -> DataFrame:
    """One row for each document, with its shares and whether all of them are within bounds.

    A share above its bound is forgiven if it is of a single repeat, one line or one run of words said twice, and below
    ``ONCE``: a text that is nothing but something said twice has 0.5. The rule is the same for texts of all lengths.

    A null or empty text, or one without a word, has no share and isn't kept. Rows with a null id are left out;
    repeated rows give repeated results; other columns don't matter; an empty table gives an empty result. A share that
    equals its bound is within it. Texts are read whole, whatever their length. Nothing is shuffled.
    """
    return documents(docs, "doc_id", "text").mapInArrow(_measure, _SCHEMA)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        keep = pa.concat_arrays([m.column("keep") for m in _measure(iter([b.select(["doc_id", "text"])]))])
        yield b.filter(pc.fill_null(keep, False))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that :func:`repetition` keeps, with all their columns, in one pass and without a join.

    Rows with a null id go, as do null and empty texts; repeated rows are judged each for itself; nulls in other columns
    stay, and so do columns of any name. An empty table gives an empty one.
    """
    documents(docs, "doc_id")  # sets the size of batches
    return docs.where(docs["doc_id"].isNotNull()).mapInArrow(_kept, docs.schema)
