import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm.bpe import PATTERN, VOCABULARY, decode, encode, encode_and_check, ranks, word_table

SIGNS = "ab cdeé ßñ’'s't're 12٣½\n\n\t  \u0085\x1c  .,!?%$#日本語🙂 <|endoftext|> ́"


def texts():
    rng = random.Random(3)
    out = ["", None, "a", "  ", "it's  we'll\n\n x", "x\x1cy \x1f z", "<|endoftext|>", "日本語のテキスト 🙂🙂", "a" * 3000, " " * 500, "word " * 5000]
    return out + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("head_bytes, filter_words", [(0, 1), (200, 1 << 21), (1 << 20, 1 << 21)])
def test_as_the_tokenizer_itself(spark, head_bytes, filter_words):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(VOCABULARY), special_tokens={})
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    rows += [(None, "left out", "", 0), rows[4], (4, "another text", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids int").repartition(3)
    got = decode(encode(df, head_bytes=head_bytes, filter_words=filter_words)).collect()
    want = sorted(((i, t) for i, t, *_ in rows if i is not None), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    for r in got:
        assert (r.ids is None and r.text is None) or r.ids == own.encode_ordinary(r.text)


def test_each_word_once_and_exact(spark):
    df = spark.createDataFrame([(1, "to be or not to be"), (2, "be")], "doc_id long, text string")
    assert {(r.word, r.n) for r in word_table(df).collect()} == {("to", 1), (" be", 2), (" or", 1), (" not", 1), (" to", 1), ("be", 1)}
    assert encode_and_check(df).where(~F.col("exact")).count() == 0


def test_empty_table(spark):
    assert encode_and_check(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_beyond_the_head_take_no_shuffle(spark):
    """Long texts of words that the head lacks: their places are neither shuffled nor joined, however many there are."""
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(VOCABULARY), special_tokens={})
    rows = [(i, " ".join(f"w{j * 7919 % 20_011}" for j in range(20_000))) for i in range(2)] + [(2, None), (3, "")]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string"), head_bytes=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.doc_id: r.ids for r in got.collect()} == {i: t if t is None else own.encode_ordinary(t) for i, t in rows}
