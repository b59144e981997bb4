import os

import pytest

import corpus_pipeline
from tessera.llm.bpe import decode

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_against_brute_force(spark, tmp_path):
    from tests.llm.test_minhash import brute_force as groups_of
    from tests.llm.test_repetition import kept as clean
    import re

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))

    want = {i for i, t in rows.items() if clean(t)}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k == 0:
            assert seen[0] == want
            grouped = groups_of([(i, rows[i]) for i in sorted(want)])
            want = {i for i in want if grouped.get(i, (i,))[0] == i}
        elif k == 1:
            assert seen[1] == want
        elif k == 2:
            leaked = {i for i in seen[1] if any(words(b) in words(rows[i]) for b in bench)}
            assert not leaked & seen[2] and len(seen[1] - leaked - seen[2]) <= 1
        elif k == 3:
            text = {r.doc_id: r.text for r in docs.collect()}
            assert not any(re.search(r"@mail\d\.example|\d{16}|\+1 \(\d{3}\)", t) for t in text.values())
    assert seen[2] == seen[3] == seen[4]
    # run() is these stages, each over what the one before kept.
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, docs.collect())) and corpus_pipeline.ORACLE_SQL is None
    assert {r.doc_id: r.text for r in decode(docs).collect()} == text


def test_odd_rows_pass_all_stages(spark, tmp_path, monkeypatch):
    """Null ids go at once, empty texts at the first stage, repeated rows at the second; other columns stay; empty tables pass."""
    fit = corpus_pipeline.pii.fit
    monkeypatch.setattr(corpus_pipeline.pii, "fit", lambda docs: fit(docs, steps=20))  # what is found doesn't matter here
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", None, 1, "a"), (1, text, "en", None, 1, "a"), (2, text.upper(), None, "s", None, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, "b"), (None, text, "en", "s", 1, "c"), (5, "zz " + " ".join(f"é{i}" for i in range(90_000)), "fr", "s", 5, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string"
    spark.createDataFrame([(1, text + " and the end")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some, want in ((rows, {1, 5}), ([], set())):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{len(some)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(some)}-{k}")
        assert {r.doc_id for r in docs.collect()} == want - {1}  # the first one is a benchmark item
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == want - {1}
