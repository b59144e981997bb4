"""License notices in texts: MinHash bands of overlapping windows retrieve templates, containment of shingles verifies.

Each template of ``n`` words is looked for in windows of ``n`` words at every ``stride``-th word, stride at most an
eighth of ``n``. Windows and templates have one MinHash value for each of ``BANDS`` hash functions (bands of one row),
over shingles of ``SHINGLE`` words. A window with Jaccard coefficient J to a template shares a band with a
probability of 1 - (1 - J)^BANDS: 0.999 at J = 0.35 and 0.9999 at J = 0.45. A notice that is there whole, up to a word
in twelve changed, has J of 0.5 or more to the nearest window. Candidates are verified by the exact share of the
template's shingles that the window and its neighbourhood hold.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import documents
from tessera.llm.tokens import U64, Words, mix, ngrams, slices

SHINGLE = 2
BANDS = 16
#: The least share of a template's shingles that a window must hold.
CONTAINED = 0.8

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
#: Notices by SPDX identifier; several for one license. Words only: case and signs don't matter.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "released under the MIT License"),
    ("MIT", "licensed under the MIT License"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("MIT", _WARRANTY),
    ("Apache-2.0", "licensed under the Apache License Version 2.0"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "licensed under the GNU General Public License version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License version 2"),
    ("GPL", "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD", "licensed under the BSD 3 Clause License"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "this source code form is subject to the terms of the Mozilla Public License v 2.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY NC 4.0"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY SA 4.0"),
    ("CC-BY", "this work is licensed under a Creative Commons Attribution International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]
_SCHEMA = "doc_id long, license string, containment double, start int, end int"


class Scanner:
    """Templates with their bands, by length."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        w = Words(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(ngrams(w.hash[a:b], min(SHINGLE, b - a))) for a, b in zip(w.first, w.first[1:])]
        self.seeds = mix(np.arange(1, BANDS + 1).astype(U64))
        self.lengths: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(w.first).tolist()):
            if n < SHINGLE:
                raise ValueError(f"template {i} is shorter than a shingle")
            self.lengths.setdefault(n, []).append(i)
        every = np.unique(np.concatenate(self.sets))
        self.known = every

    def scan(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """``(row, template, containment, first word, end word)`` of each notice."""
        w = Words(column)
        if len(w.hash) < SHINGLE:
            return []
        gram, row = ngrams(w.hash, SHINGLE), w.row
        # A window without a known shingle can't share a band; the others are the only ones looked at.
        at = np.searchsorted(self.known, gram)
        hit = (self.known[np.minimum(at, len(self.known) - 1)] == gram) & (row[: len(gram)] == row[SHINGLE - 1 :])
        spots = np.flatnonzero(hit)
        if not len(spots):
            return []
        found: dict[tuple[int, int, int], tuple] = {}
        for n, members in self.lengths.items():
            stride = max(1, n // 8)
            width = n - SHINGLE + 1
            near = np.unique(np.clip(np.concatenate([spots - d for d in range(width)]), 0, len(w.hash) - 1))
            # Windows lie within a text; a text shorter than the template is one window.
            a = np.maximum(near, w.first[row[near]])
            a = np.minimum(a, np.maximum(w.first[row[near]], w.first[row[near] + 1] - n))
            a = np.unique(a)
            a = a[((a - w.first[row[a]]) % stride == 0) | (a + n >= w.first[row[a] + 1])]
            size = np.minimum(n, w.first[row[a] + 1] - a) - SHINGLE + 1
            a, size = a[size > 0], size[size > 0]
            if not len(a):
                continue
            index = a[:, None] + np.minimum(np.arange(width), size[:, None] - 1)
            cells, back = np.unique(index, return_inverse=True)
            back = back.reshape(index.shape)
            candidates = set()
            for seed in self.seeds:
                value = mix(gram[cells] ^ seed)
                least = value[back].min(axis=1)
                for t in members:
                    band = mix(self.sets[t] ^ seed).min()
                    candidates.update((int(a[i]), t) for i in np.flatnonzero(least == band))
            for start, t in candidates:
                r = int(row[start])
                lo = max(int(w.first[r]), start - stride)
                hi = min(int(w.first[r + 1]), start + n + stride)
                share = float(np.isin(self.sets[t], gram[lo : hi - SHINGLE + 1]).mean())
                if share >= CONTAINED:
                    hits = lo + np.flatnonzero(np.isin(gram[lo : hi - SHINGLE + 1], self.sets[t]))
                    hit_ = (r, t, share, int(hits[0]), int(hits[-1]) + SHINGLE)
                    found[hit_[:2] + hit_[3:4]] = max(hit_, found.get(hit_[:2] + hit_[3:4], hit_), key=lambda x: (x[2], -x[4]))
        out: list[tuple] = []
        for hit_ in sorted(found.values(), key=lambda x: (x[0], x[1], -x[2], x[3])):
            if not any(h[0] == hit_[0] and h[1] == hit_[1] and h[3] < hit_[4] and hit_[3] < h[4] for h in out[-8:]):
                out.append(hit_)
        # Where notices of several templates overlap, those that hold more words stand.
        best: list[tuple] = []
        taken: dict[int, list[tuple[int, int]]] = {}  # those of a row that stand lie apart, so their neighbours in order tell
        for hit_ in sorted(out, key=lambda x: (x[0], x[3] - x[4], -x[2], x[1])):
            apart = taken.setdefault(hit_[0], [])
            i = bisect(apart, hit_[3:5])
            if not (i and apart[i - 1][1] > hit_[3]) and not (i < len(apart) and apart[i][0] < hit_[4]):
                apart.insert(i, hit_[3:5])
                best.append(hit_)
        return [(r, t, s, int(w.start[a]), int(w.end[b - 1])) for r, t, s, a, b in sorted(best)]


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, containment, start, end`` of each notice in each whole text; positions are characters.

    Overlapping notices give the one with the most words. Null and empty texts have none; rows with a null id are left
    out; repeated rows give repeated results. Other columns don't matter. Nothing is shuffled.
    """
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hits = scanner.scan(b.column("text"))
            if not hits:
                continue
            texts = b.column("text")
            ids = b.column("doc_id").take(pa.array([h[0] for h in hits]))
            where = []
            offsets = np.append(0, np.cumsum([len(t.as_py().encode()) if t.is_valid else 0 for t in texts]))
            for r, _, _, s, e in hits:
                raw = texts[r].as_py().encode()
                before = len(raw[: s - offsets[r]].decode())
                where.append((before, before + len(raw[s - offsets[r] : e - offsets[r]].decode())))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([scanner.names[h[1]] for h in hits]), pa.array([round(h[2], 6) for h in hits]), pa.array([s for s, _ in where], pa.int32()), pa.array([e for _, e in where], pa.int32())],
                ["doc_id", "license", "containment", "start", "end"],
            )

    return documents(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)
