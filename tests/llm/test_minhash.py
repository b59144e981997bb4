import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.minhash import NEAR, SHINGLE, SKETCH, _TOP, keep_one, list_links, near_groups, union_estimate
from tessera.llm.tokens import Words


def sets_of(rows):
    out = {}
    for i, text in rows:
        if i is None:
            continue
        w = Words(pa.array([text]))
        words = [w.low[s:e].tobytes() for s, e in zip(w.start, w.end)]
        n = min(SHINGLE, len(words))
        if n:
            out[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return out


def brute_force(rows):
    sets, root = sets_of(rows), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= NEAR * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: (g, len(m)) for g, m in groups.items() if len(m) > 1 for i in m}


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustn") for _ in range(rng.randint(2, 7)))
    line = " ".join(word() for _ in range(9))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(40, 400))]
        for c in range(rng.choice([1, 2, 3, 30])):
            own = [word() if rng.random() < 0.04 * (c > 1) else w for w in base]
            rows.append(f"{line}. {' '.join(own)}" if g % 2 else " ".join(own).upper() if c == 1 else " ".join(own))
    rows += [f"{line} {' '.join(word() for _ in range(rng.randint(30, 300)))}" for _ in range(80)]  # a line in common is no likeness
    rows += ["", None, "...", "...", "one two", "one two", "One, two!", "one", "one", "a b c d e"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(None, "one two")]


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, group_id string").repartition(3)
    got = {r.doc_id: (r.group_id, r.group_size) for r in near_groups(df).collect()}
    want = brute_force(rows)
    assert got == want
    kept = {r.doc_id for r in keep_one(df).collect()}
    assert kept == {i for i, _ in rows if i is not None} - {i for i, (g, _) in got.items() if i != g}
    assert keep_one(df).columns == df.columns


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_groups(df).collect()) == [(1, 1, 2), (2, 1, 2)]
    assert near_groups(df.limit(0)).collect() == []


def test_ids_with_texts_that_differ(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"Z{i}" for i in range(30))  # b sorts first
    df = spark.createDataFrame([(2, a, "x"), (5, a, "x"), (5, b, "x"), (6, "", "x"), (6, a, "y"), (7, None, "x"), (7, a, "x")], "doc_id long, text string, row string")
    assert sorted(tuple(r) for r in near_groups(df).collect()) == [(2, 2, 2), (7, 2, 2)]
    assert sorted((r.doc_id, r.text) for r in keep_one(df).collect()) == [(2, a), (5, b), (6, "")]


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "a b c d e f g", None), (2, "A b c d e f g", "x"), (3, None, "x"), (3, None, "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, count string")
    assert sorted(map(str, keep_one(df).collect())) == sorted(map(str, df.where("doc_id = 1 and count = 'x' or doc_id = 3").distinct().collect()))
    assert keep_one(df.limit(0)).collect() == []


def test_estimate_is_exact_for_small_sets():
    row = lambda *v: np.array([*v, *[_TOP] * (SKETCH - len(v))], np.uint32)
    got = union_estimate(row(1, 2, 3), np.stack([row(1, 2, 3), row(3, 4), row(7)]))
    assert got.tolist() == [1.0, 0.25, 0.0]


def test_lists_find_every_link_up_to_components():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 31, (6, 200)).astype(np.uint32), axis=1)
    full = [np.sort(rng.choice(base[k % 6], 150, replace=False)) for k in range(60)] + [np.sort(np.concatenate([base[0][:90], base[1][:90]]))]
    sketch = np.stack([s[:SKETCH] for s in full])
    n, root = len(sketch), list(range(61))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(n):
        for j in np.flatnonzero(union_estimate(sketch[i], sketch) >= 0.25):
            root[find(int(j))] = find(i)
    want = [find(i) for i in range(n)]
    root = list(range(61))
    for i, j, _ in list_links(sketch):
        root[find(j)] = find(i)
    got = [find(i) for i in range(n)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 100), (100, 100), (300, None)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 71)} | {100: 100, 200: 100}
    assert components(links.where(F.lit(False))).collect() == []


def test_links_between_those_near_one_leader(spark):
    """``a`` and ``b`` are near; in all lists that they share they follow a leader near neither, and each has a copy of its own."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    common = words("x", 26)
    a, b = common + words("a", 13), words("b", 13) + common
    lead = words("l", 19) + common + words("m", 19)
    texts = [a, b, a[7:], b[:-7]] + [lead + [f"end{k}"] for k in range(12)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_force(rows)
    assert {want[i] for i in (1, 2, 3, 4)} == {(1, 4)}
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.group_id, r.group_size) for r in got.collect()} == want


def test_lists_compare_all_that_are_apart():
    rng = np.random.default_rng(2)
    sketch = np.sort(rng.integers(0, 150, (30, SKETCH)).astype(np.uint32), axis=1)
    sketch = np.stack([np.pad(np.unique(s), (0, SKETCH - len(np.unique(s))), constant_values=_TOP) for s in sketch])
    root = rng.integers(0, 4, 30)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if root[i] != root[j] and union_estimate(sketch[i], sketch[[j]])[0] >= 0.3}
    assert want and {(min(i, j), max(i, j)) for i, j, _ in list_links(sketch, root, 0.3)} == want
