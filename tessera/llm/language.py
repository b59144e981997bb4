"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

As in fastText (Joulin et al., 2016): each word gives itself and its character n-grams, each hashed to a row of an
embedding table; a text is the average of its rows, and a linear layer with softmax gives the languages. Training
is stochastic gradient descent in numpy on a bounded sample of labelled rows. A held-out part of the sample sets the
temperature of the softmax and the confidence below which a text is rejected as ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import documents
from tessera.llm.shared import sample as labelled
from tessera.llm.tokens import _BASE, _INVERSE, U64, _powers, flat, folded, mix, slices

#: Labelled rows that a model is fitted on, of each language those whose ids have the smallest hashes; one in five is held out.
SAMPLE = 1500
#: Bytes of the subwords, rows of the embedding table, and its width.
GRAMS = (1, 2, 3, 4)
BUCKETS, WIDTH = 1 << 15, 16
EPOCHS, RATE, BATCH = 5, 1.0, 32
#: Steps of training on small samples, for which epochs are added.
STEPS = 600
#: Bytes of a training example; texts of the sample are split into pieces of this size, all of which are used.
PIECE = 400
#: The highest confidence that can be asked for.
LEAST_MOST = 0.6
#: The share of right held-out answers that rejection may lose.
LOSS = 0.002


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, rows of the embedding table in the texts' order, and where each text begins.

    Subwords are n-grams of bytes within words; a word is a run of letters: ASCII ones and all other characters
    outside ASCII, with a space before it. Digits, signs and spaces part words. Case is folded.
    """
    data, offsets = flat(column)
    low = folded(data)
    n = len(low)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    apart = np.zeros(n + 1, bool)
    apart[offsets] = True
    crossed = np.cumsum(apart)
    code = np.where(letter, low, 32).astype(U64) + U64(1)
    total = np.zeros(n + 1, U64)
    np.cumsum(code * _powers(_BASE, n), out=total[1:])
    inverse = _powers(_INVERSE, n + 1)
    inside = np.ones(n, bool)  # all but the first byte are letters
    for g in GRAMS:
        m = n - g + 1
        if m <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        inside = letter.copy() if g == 1 else (letter[1:] if g == 2 else inside[:m] & letter[g - 1 :])
        at = np.flatnonzero(inside & (crossed[:m] == crossed[g - 1 : g - 1 + m]))
        h = mix((total[at + g] - total[at]) * inverse[at] + U64(g))
        yield (h & U64(BUCKETS - 1)).astype(np.int32), np.searchsorted(at, offsets)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the embedding table for each text, and where each text begins."""
    parts = list(_grams(column))
    row = np.concatenate([np.repeat(np.arange(len(first) - 1), np.diff(first)) for _, first in parts])
    return np.concatenate([ids for ids, _ in parts])[np.argsort(row, kind="stable")], np.append(0, np.cumsum(sum(np.diff(first) for _, first in parts)))


def _sums(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows for each text."""
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(table[ids], first[full], axis=0)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """``weight`` is the embedding table times the linear layer: one column for each language."""

    languages: list[str]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and how many subwords each text has."""
        total, size = 0, 0
        for ids, first in _grams(column):
            total, size = total + _sums(self.weight, ids, first), size + np.diff(first)
        return total / np.maximum(1, size)[:, None] + self.bias, size

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and confidence; ``und`` for a text without subwords or below the least confidence."""
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        z, size = self.logits(column)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        sure = p[np.arange(len(p)), best]
        named = [self.languages[k] if n and s >= self.least else "und" for k, s, n in zip(best, sure, size)]
        return named, np.where(size > 0, sure, 0.0)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """All of the text in pieces of about ``size`` characters, parted at spaces."""
    out, at = [], 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def train(rows: list[tuple[str, str]], seed: int = 0) -> Model:
    """A model from ``(text, language)``; every fifth row is held out for calibration."""
    languages = sorted({y for _, y in rows})
    index = {y: i for i, y in enumerate(languages)}
    parts = {held: [(p, index[y]) for i, (t, y) in enumerate(rows) if (i % 5 == 4) == held for p in pieces(t)] for held in (False, True)}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    lin, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    if len(languages) > 1 and parts[False]:
        ids, first = features(pa.array([p for p, _ in parts[False]]))
        gold = np.array([y for _, y in parts[False]])
        epochs = max(EPOCHS, -(-STEPS // -(-len(gold) // BATCH)))
        steps = epochs * -(-len(gold) // BATCH)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(gold))
            for s in range(0, len(order), BATCH):
                rate = RATE * (1 - step / steps)
                step += 1
                pick = order[s : s + BATCH]
                size = np.diff(first)[pick]
                cut = np.append(0, np.cumsum(size))
                own = ids[np.repeat(first[pick] - cut[:-1], size) + np.arange(cut[-1])]
                scale = (1 / np.maximum(1, size))[:, None].astype(np.float32)
                mean = _sums(emb, own, cut) * scale
                p = softmax(mean @ lin + bias)
                p[np.arange(len(pick)), gold[pick]] -= 1
                p /= len(pick)
                back = (p @ lin.T) * scale
                lin -= rate * mean.T @ p
                bias -= rate * p.sum(axis=0)
                order_ = np.argsort(own, kind="stable")
                head = np.flatnonzero(np.append(True, own[order_][1:] != own[order_][:-1])) if len(own) else np.zeros(0, np.int64)
                if len(head):
                    emb[own[order_][head]] -= rate * np.float32(len(pick)) * np.add.reduceat(np.repeat(back, size, axis=0)[order_], head, axis=0)
    model = Model(languages, (emb @ lin).astype(np.float32), bias)
    if parts[True]:
        column, gold = pa.array([p for p, _ in parts[True]]), np.array([y for _, y in parts[True]])
        z, _ = model.logits(column)
        losses = {t: -np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(gold)), gold])).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == gold])
        if len(right):
            model.least = float(min(right[int(LOSS * len(right))], LEAST_MOST))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """:func:`train` on at most ``sample`` rows with text and ``lang``, of each language those whose ids have the smallest hashes."""
    return train([(r.text, r.lang) for r in labelled(docs, sample, "text", "lang", by="lang")])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, language, confidence`` of every text, whole.

    ``und`` where no language is sure enough, and for null and empty texts and those without letters, whose
    confidence is 0. Rows with a null id are left out; repeated rows give repeated results. Other columns don't
    matter. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            language, sure = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(language, pa.string()), pa.array(sure.astype(float).round(6))], ["doc_id", "language", "confidence"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, language string, confidence double")
