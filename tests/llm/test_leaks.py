import random

import numpy as np
import pyarrow as pa

from tessera.llm.leaks import BLOCK, RANK, TERMS, _block_sums, _blocks, _weighted, common_subsequence, directions, drop_leaks, frequencies, leaks, weights
from tessera.llm.tokens import Words


def test_common_subsequence():
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert common_subsequence(a, b) == slow(a, b)


def world(seed=3):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("aeioustnrl") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(lexicon) for _ in range(n)]
    return rng, lexicon, prose


def test_leaks_and_clean_documents(spark):
    rng, lexicon, prose = world()
    items = [(k, " ".join(prose(rng.randint(15, 60)))) for k in range(25)]
    docs, want = [], set()
    for i in range(150):
        words = prose(rng.randint(1, 400))
        if i % 3 == 0:
            k = rng.randrange(25)
            item = items[k][1].split()
            if i % 2:  # a paraphrase: one word in eight changed, some left out
                item = [rng.choice(lexicon) if rng.random() < 0.12 else w for w in item if rng.random() > 0.03]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if i % 4 == 0 else w for w in item]
            want.add((i, k))
        docs.append((i, " ".join(words), "x", 0.0))
    docs += [(500, None, "x", 0.0), (501, "", "x", 0.0), (502, "...", "x", 0.0), (None, items[0][1], "x", 0.0), (0, docs[0][1], "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, covered double").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items] + [(900, None, 1), (901, "", 1), (None, "a b c", 1), items[3] + (2,)], "item_id long, text string, doc_id int")
    rows = leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & want) >= 0.97 * len(want) and got <= want
    for r in rows:
        part = next(d[1] for d in docs if d[0] == r.doc_id)[r.start : r.end]
        assert len(set(part.lower().split()) & set(items[r.item_id][1].split())) >= 0.4 * len(set(items[r.item_id][1].split()))
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - sum(d[0] in {i for i, _ in got} or d[0] is None for d in docs)
    assert leaks(df.limit(0), bench).collect() == [] and leaks(df, bench.limit(0)).collect() == []
    assert drop_leaks(df.where("doc_id = 1"), bench.limit(0)).count() == 1


def test_directions_against_the_full_decomposition(spark):
    rng, lexicon, prose = world(5)
    topics = [[rng.choice(lexicon) for _ in range(40)] for _ in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) for _ in range(BLOCK * 2)) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    count, n = frequencies(df)
    assert n == 300 and count.sum() == sum(len({h >> 50 for h in Words(pa.array([t])).hash.tolist()}) for t in texts)
    idf = np.log((1 + n) / (1 + count)).astype(np.float32)
    v = directions(df, idf, rank=6)
    a = np.zeros((300, TERMS))
    for i, t in enumerate(texts):
        np.add.at(a[i], (Words(pa.array([t])).hash >> np.uint64(50)).astype(int), 1)
    a *= idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    q = v / np.linalg.norm(v, axis=0)
    assert np.linalg.norm(a @ q) ** 2 >= 0.93 * (s[:6] ** 2).sum() and abs(q.T @ q - np.eye(6)).max() < 1e-3


def test_block_sums():
    w = Words(pa.array(["a b c " * 20, "", "x"]))
    idf, table = np.ones(TERMS, np.float32), np.random.default_rng(0).normal(size=(TERMS, 3)).astype(np.float32)
    block, row, first = _blocks(w)
    got = _block_sums(_weighted(table, idf), w, row, first)
    want = np.zeros_like(got)
    np.add.at(want, block, table[(w.hash >> np.uint64(50)).astype(int)])
    assert np.allclose(got, want, atol=1e-4) and row.tolist() == [0] * 4 + [2]


def test_weights():
    assert weights(np.array([1, 900]), 1000)[1] == 0 and RANK > 0


def test_short_items_in_long_documents(spark):
    rng, lexicon, prose = world(7)
    own = lambda n: next(x for x in iter(lambda: prose(n), None) if 2 * sum(len(w) > 3 for w in x) > n)
    items = [(k, " ".join(own((8, 10, 12, 15)[k % 4]))) for k in range(60)]
    docs, want = [], set()
    for i in range(240):
        item = items[i % 60][1].split()
        part = item if i < 120 else [rng.choice(lexicon) if rng.random() < 0.12 else w for w in item]
        words = prose(rng.randint(60, 400))
        at = rng.randint(0, len(words))
        words[at:at] = part
        docs.append((i, " ".join(words)))
        if common_subsequence(item, part) >= 0.7 * len(item):
            want.add((i, i % 60))
    assert len(want) > 220
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    assert want <= found and len(found - want) <= 2
    assert drop_leaks(df, bench).count() == len(docs) - len({i for i, _ in found})


def test_all_items_against_all_texts(spark):
    """The whole operator against a loop over every item, every text and every place in it."""
    from tessera.llm.leaks import ANSWER, ANSWERED, COVERED, LOOSE

    rng, lexicon, prose = world(11)
    items = [(k, " ".join(prose((6, 9, 14, 20, 45)[k % 5]))) for k in range(20)] + [(50, "the of and to the of to and of the")]  # of common words alone
    docs = []
    for i in range(60):
        words = prose(rng.randint(1, 90))
        if i % 2:
            part = [rng.choice(lexicon) if rng.random() < 0.2 else w for w in items[i % 21][1].split() if rng.random() > 0.1]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    count, n = frequencies(df.select("text"))
    idf = weights(count, n)
    words_of = lambda t: [h for h in Words(pa.array([t])).hash.tolist()]
    want = {}
    for i, text in docs:
        mine = words_of(text)
        for k, item in items:
            words = words_of(item)
            rare = sorted(set(words), key=lambda h: (-idf[h >> 50], h))
            answer = set(rare[: max(1, round(ANSWER * len(rare)))])
            for a in range(len(mine)):
                part = mine[a : a + int(1.5 * len(words)) + 1]
                covered = common_subsequence(words, part) / len(words)
                if covered >= COVERED or (covered >= LOOSE and len(answer & set(part)) >= ANSWERED * len(answer)):
                    want[i, k] = max(want.get((i, k), 0), round(covered, 6))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in leaks(df, bench).collect()}
    assert got == want and any(k == 50 for _, k in got)


def test_products_against_a_loop():
    from tessera.llm.leaks import PIECE, _products

    rng = np.random.default_rng(4)
    table = rng.normal(size=(50, 6)).astype(np.float32)
    for size in (0, 1, PIECE, 400):
        at, value, group = rng.integers(0, 50, size), rng.normal(size=size).astype(np.float32), np.sort(rng.choice([0, 2, 3, 7, 9], size))
        want = np.zeros((11, 6), np.float32)
        for a, v, g in zip(at, value, group):
            want[g] += table[a] * v
        assert np.allclose(_products(table, at, value, group, 11), want, atol=1e-4)
