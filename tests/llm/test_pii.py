import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.pii import KINDS, SHARED, WINDOW, find, fit, redact, spans_of, tags_of, train, value

WORDS = "the of ing thand ereat onnd été über qué señ lichung the and".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return train([prose(rng, 30) for _ in range(80)])


def test_held_out_values(model):
    rng = random.Random(99)
    hit = {k: 0 for k in KINDS}
    for k in KINDS:
        for _ in range(60):
            v = value(k, rng)
            text = f"{prose(rng, rng.randint(0, 80))} {v} {prose(rng, rng.randint(0, 80))}".strip()
            at = len(text[: text.index(v)].encode())
            hit[k] += any(s <= at and e >= at + len(v) for s, e, _ in spans_of(model, pa.array([text]))[0])
    assert min(hit.values()) >= 50 and sum(hit.values()) >= 330, hit


def test_forms_that_training_never_draws(model):
    rng = random.Random(7)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    forms = [
        lambda: f"{w()}.{w()}.{w()}@{w()}.{w()}.edu",
        lambda: f"{w().upper()}@{w().upper()}.COM",
        lambda: f"{d(4)}{w()}@mail{d(1)}.example.com",
        lambda: f"{d(3)} {d(3)} {d(4)}",
        lambda: f"({d(2)}) {d(4)} {d(4)}",
        lambda: f"{d(4)} {d(6)} {d(5)}",
        lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}",
        lambda: f"xoxb-{d(12)}-{''.join(rng.choice('abcdefXYZ0123456789') for _ in range(24))}",
        lambda: f"GB{d(2)}{''.join(rng.choice('ABCDEFGH') for _ in range(4))}{d(14)}",
    ]
    hit = []
    for form in forms:
        found = 0
        for _ in range(30):
            v, before = form(), prose(rng, 12)
            found += any(s <= len(before.encode()) + 1 and e >= len(before.encode()) + 1 + len(v) for s, e, _ in spans_of(model, pa.array([f"{before} {v} {prose(rng, 12)}"]))[0])
        hit.append(found / 30)
    assert sum(hit) / len(hit) >= 0.8, hit


def test_clean_texts_stay(model):
    rng = random.Random(5)
    texts = [prose(rng, 200) for _ in range(50)] + ["in 2024 and 1999, version 2.0 of 12:30 at 5 %, no 1,234,567"]
    assert sum(bool(s) for s in spans_of(model, pa.array(texts))) <= 1


def test_windows_agree_with_the_whole(model):
    """A value is found wherever it stands to the windows' edges, and once."""
    rng = random.Random(6)
    for at in range(WINDOW - SHARED - 60, WINDOW + 60, 7):
        text = f"{prose(rng, 300)[:at]} some.one@mail1.example.com {prose(rng, 300)}"
        found = spans_of(model, pa.array([text, "", None, "x"]))
        assert [k for *_, k in found[0]] == ["email"] and found[1:] == [[], [], []]
    tags, data, offsets = tags_of(model, pa.array([text, None]))
    assert len(tags) == len(data) == offsets[-1]


def test_operator_and_redaction(spark, model):
    rng = random.Random(8)
    long = prose(rng, 3000)
    rows = [(1, f"é ü {long} 4465758382889437 4465758382889437", "a"), (2, long, "b"), (3, "", "c"), (4, None, None), (None, "jo.doe@mail1.example.com", "d"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "e"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find(df, model).collect()
    assert sorted(r.doc_id for r in got) == [1, 5, 5]
    first = next(r for r in got if r.doc_id == 1)
    assert " ".join(rows[0][1][s.start : s.end] for s in first.spans) == "4465758382889437 4465758382889437" and {s.kind for s in first.spans} == {"card"}
    out = {(r.doc_id, r.spans): r.text for r in redact(df, model).collect()}
    assert out[(2, "b")] == long and out[(4, None)] is None and out[(5, "e")] == 'token = "<SECRET>"' and "4465" not in out[(1, "a")] and (None, "d") not in out
    assert redact(df, model).schema == df.schema and find(df.limit(0), fit(df.limit(0), steps=1)).collect() == []


def test_training_lowers_the_loss(model):
    assert np.isfinite(model.p["t"]).all()
