"""A text of three million characters, one word of a hundred thousand letters and a page of as much go through whole."""

import random

import pytest

from tessera.llm import pii
from tessera.llm.bpe import encode_and_check
from tessera.llm.language import identify, train
from tessera.llm.leaks import leaks
from tessera.llm.licenses import licenses
from tessera.llm.minhash import near_groups
from tessera.llm.repetition import repetition
from tessera.llm.site import main_text
from tessera.llm.suffixes import repeated_passages


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(480_000))
    end = " Released under the MIT License. write to some.one@mail1.example.com"
    item = " ".join(word() for _ in range(40))
    rows = [(1, f"{long} {item}.{end}"), (2, f"{long} {item}"), (3, "x" * 100_000), (4, "short"), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2), item


def test_long_texts(spark, docs):
    df, item = docs
    assert {r.doc_id: r.group_id for r in near_groups(df).collect()} == {1: 1, 2: 1}
    assert {r.doc_id: r.keep for r in repetition(df).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert {r.doc_id for r in repeated_passages(df).collect()} == {1, 2}
    assert [r.license for r in licenses(df).collect()] == ["MIT"]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks(df, bench).collect()) == [1, 2]
    assert all(r.exact for r in encode_and_check(df).where("doc_id < 5").collect())
    assert {r.doc_id: r.language for r in identify(df, train([("the and of " * 20, "en"), ("der und ß " * 20, "de")] * 10)).collect()}.keys() == {1, 2, 3, 4, 5}


def test_personal_data_at_the_end_of_a_long_text(spark, docs):
    model = pii.train(["the end of a line and so on"] * 20)
    found = pii.find(docs[0].where("doc_id = 1"), model).collect()
    assert found and found[0].spans[-1].kind == "email"


def test_long_page(spark):
    html = "<body><p>" + "word " * 200_000 + "</p>" + "<div>" * 2000 + "deep"
    df = spark.createDataFrame([(1, "https://a.example.com/", html)] * 5, "page_id long, url string, html string")
    assert all(len(r.text) > 900_000 for r in main_text(df).collect())
