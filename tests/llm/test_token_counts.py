"""Spliced token counts against the library's counts of whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts
from tidemark.llm.queries import op12_token_counts, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "word", " word", "  ", " ", "\n", "\n\n  ", "'re", "'", "'ll", "don't", "<|endoftext|>", "<|endof", "text|>", "1234", "é", "ß", "漢字", "😀", "...", "!?", " ", "\t", "'s's", "x" * 40, " " * 30, "=" * 25]


def test_splices_equal_whole_encodings_at_every_cut(whole):
    rng, splice, widened = random.Random(5), token_counts.Splicer(PATH), 0
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 60)))
        chunk = rng.randint(1, 60)
        n, chunks, wide = splice.count(text, chunk, rng.randint(1, 12))
        assert n == whole(text), (text, chunk)
        assert chunks <= -(-len(text) // chunk)
        widened += wide
    assert widened > 1000


def test_runs_longer_than_chunks(whole):
    splice = token_counts.Splicer(PATH)
    for text in ("x" * 5000, " " * 5000, "ab " * 10 + "=" * 3000 + " end", "a" * 700 + " b" * 700 + "c" * 700, "<|endoftext|>" * 400, "''" * 900 + "re"):
        for chunk in (64, 1000):
            assert splice.count(text, chunk, 8)[0] == whole(text), text[:40]


def test_proof_is_refused_for_other_vocabularies():
    assert token_counts.Splicer(PATH).exact
    assert not token_counts.Splicer(vocabulary("word_bpe_49k.json")).exact


def test_whole_table_equals_the_library(spark, whole):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, n = texts[r.doc_id], whole(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert any(r.n_chunks > 1 for r in rows)


def test_odd_rows(spark, whole):
    long = " ".join(str(i) for i in range(80_000)) + "y" * 20_000 + " <|endoftext|>" * 3
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, long, "x"), (3, long, "x")], "doc_id long, text string, n_tokens string")
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect())
    n = whole(long)
    assert rows == [("1", 0, 0, False), ("2", 0, 0, False), ("3", len(long), n, True), ("3", len(long), n, True), ("None", 3, 2, False)]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
