import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.suffixes import PASSAGE, deep_shallow, repeated_passages, runs, sliding_least
from tessera.llm.tokens import U64, Words, mix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=120), st.integers(1, 12), st.integers(0, 4))
def test_order_is_that_of_sorted_suffixes(values, depth, shallow):
    word = mix(np.array(values, U64) + U64(1))
    start = np.arange(len(values) - depth + 1)
    group = np.array([i % 2 for i in start])
    rank = deep_shallow(word, start, group, depth, shallow)
    key = [(int(g), tuple(int(x) for x in word[s : s + depth])) for s, g in zip(start, group)]
    assert rank.tolist() == [sum(k < mine for k in key) for mine in key]


def test_sliding_least():
    a = np.array([5, 3, 8, 1, 9, 2, 7])
    for width in range(1, 8):
        assert sliding_least(a, width).tolist() == [min(a[i : i + width]) for i in range(len(a) - width + 1)]


def test_runs_cover_every_window():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(n)) for n in (10, 50, 51, 300, 0)] + ["same " * 200]
    w = Words(pa.array(texts))
    _, row, first, count, twice = runs(w)
    windows = sorted((r, f - w.first[r] + i) for r, f, c in zip(row, first, count) for i in range(c))
    assert windows == [(r, i) for r in range(len(texts)) for i in range(w.first[r + 1] - w.first[r] - PASSAGE + 1)]
    assert twice[row == 5].tolist() == [True]


def brute_force(rows):
    """Covered characters of each (id, text), from all windows of all texts."""
    seen, places = {}, {}
    for key in {(i, t or "") for i, t in rows if i is not None}:
        words, at, out = [], 0, key[1]
        w = Words(pa.array([out]))
        letters = [len(out.encode()[:x].decode()) for x in w.start], [len(out.encode()[:x].decode()) for x in w.end]
        words = [w.low[s:e].tobytes() for s, e in zip(w.start, w.end)]
        places[key] = (words, letters)
        for at in range(len(words) - PASSAGE + 1):
            seen.setdefault(tuple(words[at : at + PASSAGE]), []).append((key, at))
    covered = {}
    for where in seen.values():
        if len(where) > 1:
            for key, at in where:
                a, z = places[key][1][0][at], places[key][1][1][at + PASSAGE - 1]
                covered.setdefault(key, set()).update(range(a, z))
    return sorted((key[0], len(c)) for key, c in covered.items())


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeéßstn") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, short = text(60), text(49)
    rows = [(i, text(rng.randint(0, 200))) for i in range(30)]
    rows += [(40 + i, f"{text(30)}. {shared.upper() if i % 2 else shared}\n{text(20)}") for i in range(6)]
    rows += [(60 + i, f"{text(9)} {short} {text(9)}") for i in range(3)]
    copy = text(120).split()
    for i in range(5):  # near copies
        mine = copy.copy()
        mine[i * 20] = word()
        rows.append((70 + i, " ".join(mine)))
    rows += [(80, "orre " * 300), (81, "a b c " * 60), (90, None), (91, ""), (None, shared), (92, text(99)), (93, text(99))]
    rows += [(92, rows[-2][1]), (95, text(20000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = sorted((r.doc_id, r.repeated_chars) for r in repeated_passages(df).collect())
    assert got == brute_force(rows)
    assert {i for i, _ in got} >= {40, 45, 70, 74, 80, 81} and not {60, 92, 93, 95} & {i for i, _ in got}


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
