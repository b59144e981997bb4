"""Byte-pair encoding of a corpus by its distinct words, and decoding.

Spark splits texts into words by the tokenizer's own pattern and counts the distinct ones; a table gives each word that
occurs more than once its ids. Ids go back to the words' positions in two ways that together cover every word:

* the most frequent words, up to ``HEAD_BYTES`` of table, are looked up where the text is;
* other words are encoded where they stand, each distinct one once in a batch of half a million words or more. To bring
  their ids from the table would take a shuffle of each place where they are, and their share grows with the corpus.

Decoding looks each id up in the table of pieces, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import Written, documents, release

#: The pattern of the byte-level vocabularies; their ids are below 65,536.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of words and ids that are looked up without a shuffle, whatever the corpus' size.
HEAD_BYTES = 16 << 20
#: Words of which the ids are put together at a time; a longer text comes alone and whole.
LOT = 1 << 18


def ranks(vocabulary: str) -> dict[bytes, int]:
    """Pieces and their ids."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _words(docs: DataFrame) -> DataFrame:
    """``doc_id, version, words``; a null text has null words."""
    texts = documents(docs, "doc_id", "text")
    return texts.select("doc_id", F.xxhash64("text").alias("version"), F.regexp_extract_all("text", F.lit(f"(?U){PATTERN}"), F.lit(0)).alias("words"))


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at least so many words, as each batch is looked up in a fresh hash table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x.column("words").flatten()) for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _encoder(table: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _gathered(batches):
        counts = pc.value_counts(b.column("words").flatten())
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def word_table(docs: DataFrame, vocabulary: str = VOCABULARY, least: int = 1) -> DataFrame:
    """``word, n, ids``: each distinct word that occurs ``least`` times or more, how often, and its ids."""
    table = ranks(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = _encoder(table)
        for b in batches:
            ids = [encode_(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    words = _words(docs).select("words").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= least).mapInArrow(encode, "word string, n long, ids array<int>")


def _head(table: DataFrame, most: int) -> Column:
    """Whether a word is as frequent as those whose table fits into ``most`` bytes."""
    step = F.floor(F.log2("n") * 8)
    sizes = table.groupBy(step.alias("step")).agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 8).alias("size")).collect()
    left, least = most, None
    for row in sorted(sizes, key=lambda r: -r["step"]):
        if row["size"] > left:
            break
        left, least = left - row["size"], row["step"]
    return F.lit(False) if least is None else step >= least


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, head_bytes: int = HEAD_BYTES, filter_words: int = 0) -> DataFrame:
    """``doc_id, version, ids``: the ids of each whole text, as the tokenizer itself gives them.

    ``version`` is a hash of the text. An empty text has no ids, a null text null; strings of special tokens are
    ordinary text. Rows with a null id are left out; repeated rows give repeated results. Other columns don't matter.
    ``filter_words`` has no effect any more: no word is joined.
    """
    spark = docs.sparkSession
    pieces = ranks(vocabulary)
    table = Written(word_table(docs, vocabulary, 2))
    release(spark)
    rows = table.df.where(_head(table.df, head_bytes)).select("word", "ids", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns("n").combine_chunks()
    table.drop()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, encode_ = pa.ipc.open_stream(sent.value).read_all().combine_chunks(), _encoder(pieces)
        word, head = (known.column(c).chunk(0) if known.num_rows else pa.array([], known.schema.field(c).type) for c in ("word", "ids"))
        head_length, head_ids = head.value_lengths().to_numpy(), head.flatten().to_numpy()
        for b in _gathered(batches):
            lists = b.column("words")
            flat_ = lists.flatten()
            code = pc.fill_null(pc.index_in(flat_, value_set=word), -1).to_numpy().astype(np.int64)
            other = np.flatnonzero(code < 0)
            distinct = flat_.take(pa.array(other)).dictionary_encode()
            code[other] = distinct.indices.to_numpy() + len(word)
            made = [np.array(encode_(x), np.int32) for x in distinct.dictionary.to_pylist()]
            length = np.concatenate([head_length, np.array([len(x) for x in made], np.int64)]).astype(np.int64)
            ids, start = np.concatenate([head_ids, *made]), np.cumsum(length) - length
            first = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()))
            none = lists.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(first[:-1] // LOT)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = code[first[i] : first[j]]
                size = length[part]
                ends = np.append(0, np.cumsum(size))
                whole = ids[np.repeat(start[part] - ends[:-1], size) + np.arange(ends[-1])]
                offsets = pa.array(ends[first[i : j + 1] - first[i]].astype(np.int32), mask=np.append(none[i:j], False))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("version").slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(whole, pa.int32()))], ["doc_id", "version", "ids"])

    return _words(docs).mapInArrow(place, "doc_id long, version long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with a column ``text`` added: the pieces of ``ids`` in order. Null ids give null.

    An id that the vocabulary lacks is an error. The table of pieces is sent to all executors: its size is that of the
    vocabulary, not of the corpus.
    """
    table = ranks(vocabulary)
    pieces = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        pieces[i] = piece

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pa.array(pieces, pa.large_binary())
        for b in batches:
            ids = b.column("ids")
            size = pc.fill_null(ids.value_lengths(), 0).to_numpy()
            parts = by_id.take(ids.flatten())
            ends = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1)
            data = parts.buffers()[2].to_pybytes() if parts.buffers()[2] is not None else b""
            cuts = ends[np.append(0, np.cumsum(size))].tolist()
            none = ids.is_null().to_pylist()
            text = pa.array([None if x else data[i:j] for i, j, x in zip(cuts, cuts[1:], none)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(join, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))


def encode_and_check(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids, exact``: :func:`encode`, and whether :func:`decode` gives the text back."""
    both = decode(encode(docs, vocabulary), vocabulary)
    return both.select("doc_id", F.size("ids").alias("n_tokens"), "ids", (F.xxhash64("text") == F.col("version")).alias("exact"))
