"""Encoding and counting against the tokenizers' own libraries."""

import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import sentencepiece_fst, token_counts
from ledgerloom.llm.sentencepiece_fst import model_path

ALPHABET = "  aabeinrstthe'ssreveldm.,!?12é̈ñçßΣςİ가각ᆨ中文▁\n\t\r \u0085 ​😀<|>endoftextstart'’ÀA"
SPECIAL = ["", "<|endoftext|>", "<|startoftext|>x", "it's we'll", "I'VE", "''s", "!!'re"]
EDGE = [None, "", " ", "  ", "a", "a ", " a", "a  b", "▁", "\n", "x" * 3000, "'" * 40, "é" * 500,
        "ab " * 30_000, "<|endoftext|>" * 3, "\U0001f600\U0001f600", "\x00", "word​word", "1234567890"]


def junk(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) + rnd.choice(SPECIAL) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(small_docs):
    return [r.text for r in small_docs.collect()] + EDGE + junk(600, 1)


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(4)


def test_encoding_equals_the_library(table, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path(sentencepiece_fst.MODEL))
    got = sentencepiece_fst.encode(table, check="same").select("doc_id", "ids", "same").collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else sp.encode(t)), t
        assert r.same == (None if t is None else sp.decode(sp.encode(t)) == t)


def test_decoding_equals_the_library(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path(sentencepiece_fst.MODEL))
    rows = [(i, None if t is None else sp.encode(t)) for i, t in enumerate(texts)]
    got = (spark.createDataFrame(rows, "i long, ids array<int>")
           .select("i", sentencepiece_fst.decode(F.col("ids")).alias("text")).collect())
    assert all(r.text == (None if rows[r.i][1] is None else sp.decode(rows[r.i][1])) for r in got)


def test_batches_equal_single_texts():
    fst = sentencepiece_fst.PieceTransducer(model_path(sentencepiece_fst.MODEL))
    some = [t for t in EDGE if t is not None] + junk(300, 2)
    ids, _ = fst.encode_batch(pa.array(some))
    assert ids.to_pylist() == [fst.encode(t).tolist() for t in some]


def test_counts_equal_the_library(table, texts):
    lib = Tokenizer.from_file(model_path(token_counts.MODEL))
    got = token_counts.count_tokens(table).select("doc_id", "n_tokens", "ids").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids), texts[r.doc_id]
        assert r.ids == "clash"


@pytest.mark.parametrize("chunk", [5, 40, 1000])
def test_chunked_counts_equal_whole_ones(spark, chunk):
    fst = token_counts.CountingTransducer(model_path(token_counts.MODEL))
    some = [t for t in EDGE if t is not None and len(t) < 5000] + junk(200, 3)
    for t in some:
        parts = fst.cuts(t, chunk)
        assert "".join(parts) == t
        assert fst.compose(fst.state_map(p) for p in parts) == fst.count(t), t
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)] * 2, "doc_id long, text string")
    got = token_counts.count_tokens(rows, chunk=chunk).collect()
    assert len(got) == 2 * len(some) and all(r.n_tokens == fst.count(some[r.doc_id]) for r in got)


def test_empty_tables(table):
    assert sentencepiece_fst.encode(table.limit(0)).collect() == []
    assert token_counts.count_tokens(table.limit(0)).collect() == []
