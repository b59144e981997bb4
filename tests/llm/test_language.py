import random

import numpy as np
import pyarrow as pa

from tessera.llm.language import features, fit, identify, pieces, train
from tessera.llm.shared import sample

SYLLABLES = {"en": "the ing ed th wh sh ou", "de": "ein sch ung der ch keit ß", "fr": "eau ou les é è ment que"}


def rows(n, seed):
    rng = random.Random(seed)
    word = lambda y: "".join(rng.choice(SYLLABLES[y].split()) for _ in range(rng.randint(1, 4)))
    return [(" ".join(word(y) for _ in range(rng.randint(5, 90))), y) for y in (rng.choice(list(SYLLABLES)) for _ in range(n))]


def test_held_out_accuracy_and_rejection(spark):
    model = train(rows(200, 1))
    test = rows(300, 2)
    named, sure = model.predict(pa.array([t for t, _ in test]))
    assert np.mean([a == y for a, (_, y) in zip(named, test)]) > 0.97
    named, sure = model.predict(pa.array(["", None, "12 34 ?!", "x"]))
    assert named[:3] == ["und"] * 3 and sure[:3].tolist() == [0, 0, 0]


def test_operator(spark):
    data = rows(120, 3)
    df = spark.createDataFrame([(i, t, y, "x", 1.0) for i, (t, y) in enumerate(data)] + [(900, None, None, "x", 0.0), (None, "the", "en", "x", 0.0), (0, "", "en", "x", 0.0)], "doc_id long, text string, lang string, language string, confidence double")
    model = fit(df, 100)
    got = identify(df, model).collect()
    assert len(got) == 122 and np.mean([r.language == data[r.doc_id][1] for r in got if r.doc_id < 900 and r.confidence > 0]) > 0.95
    assert [r.language for r in got if r.confidence == 0] == ["und", "und"]
    assert identify(df.limit(0), fit(df.limit(0))).collect() == []
    assert {r.language for r in identify(df, fit(df.limit(0))).collect()} <= {"und"}


def test_whole_texts_count():
    text = "the " * 50 + "é" * 3000
    assert "".join(pieces(text)) == text
    one, two = features(pa.array([text[:100]]))[1][-1], features(pa.array([text]))[1][-1]
    assert two > one + 2900
    a, b = features(pa.array(["ab cd", "ef"])), features(pa.array(["ef"]))
    assert sorted(a[0][a[1][1] :].tolist()) == sorted(b[0].tolist())


def test_sample_of_sparse_and_rare_labels(spark):
    rows = [(i, f"text {i}", None if i % 20 else "rare" if i == 1000 else "en") for i in range(4000)] + [(5000, None, "en"), (5001, "", "de"), (5002, "x", ""), (20, "a repeated id", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in sample(df, 150, "text", "lang", by="lang")]
    assert len(got) == 150 and sum(y == "rare" for _, y in got) == 1 and {y for _, y in got} == {"en", "rare"} and ("text 20", "en") not in got
    assert len(sample(df, 300, "text", "lang", by="lang")) == 200 and len(sample(df, 150, "text", "lang")) == 150


def test_prediction_against_a_loop():
    """Language, confidence and rejection from a loop over the subwords of each text, one exponential at a time."""
    import math

    model = train(rows(120, 4))
    texts = [t for t, _ in rows(40, 5)] + ["", None, "12 ?!", "Über éa x", "THE thing"]
    ids, first = features(pa.array(texts))
    named, sure = model.predict(pa.array(texts))
    for i in range(len(texts)):
        mine = ids[first[i] : first[i + 1]].tolist()
        if not mine:
            assert (named[i], sure[i]) == ("und", 0)
            continue
        z = [sum(float(model.weight[g, k]) for g in mine) / len(mine) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        best = max(range(len(e)), key=lambda k: (e[k], -k))
        p = e[best] / sum(e)
        assert abs(p - sure[i]) < 1e-4 and named[i] == (model.languages[best] if p >= model.least else "und")
