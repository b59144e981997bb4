import random

import numpy as np
import pyarrow as pa

from tessera.llm.licenses import CONTAINED, SHINGLE, TEMPLATES, Scanner, licenses
from tessera.llm.tokens import Words, ngrams


def brute_force(text):
    """Templates of which some stretch of the text, half as long again as the template, holds enough shingles."""
    w, out = Words(pa.array([text], pa.string())), set()
    gram = ngrams(w.hash, SHINGLE)
    for name, template in TEMPLATES:
        t = Words(pa.array([template]))
        own, n = np.unique(ngrams(t.hash, SHINGLE)), len(t.hash)
        for a in range(max(1, len(gram) - n + 1)):
            if np.isin(own, gram[a : a + n]).mean() >= CONTAINED:
                out.add(name)
    return out


def sample():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioustn") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for name, template in TEMPLATES:
        rows.append((name, f"{prose(40)}.\n{template.upper()}.\n{prose(30)}"))
        words = template.split()
        if len(words) >= 12:
            words[len(words) // 2] = word()
            rows.append((name, f"{prose(300)} {' '.join(words)}"))
        rows.append((name, template))
    rows += [(None, prose(500)), (None, "the MIT building and its license plates"), (None, "all rights of way are reserved"), (None, ""), (None, None)]
    return rows


def test_finds_each_notice_and_nothing_else(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(rows)] + [(None, TEMPLATES[0][1], "x")], "doc_id long, text string, license string")
    got: dict[int, list] = {}
    for r in licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (name, text) in enumerate(rows):
        assert [r.license for r in got.get(i, [])] == ([name] if name else []), text
        for r in got.get(i, []):
            assert r.license in brute_force(text) and text[r.start : r.end].lower().split()[0] in " ".join(t.lower() for n, t in TEMPLATES if n == name)
    assert all(brute_force(t) == set() for n, t in rows if n is None)


def test_several_notices_and_positions():
    text = "é Released under the MIT License. Ünd so. Licensed under CC BY-NC 4.0. Released under the MIT License."
    assert sorted(Scanner().names[t] for _, t, *_ in Scanner().scan(pa.array([text]))) == ["CC-BY-NC-4.0", "MIT", "MIT"]


def test_empty_table(spark):
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
