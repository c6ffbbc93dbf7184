import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\n ", "\t", "'", "'ll", "'s", "é", "中", "😀", "1", "23", "!", "...", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\u00a0", "İ", " x", "-", "ing", "\r\n"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_every_prefix_matches_the_library(library):
    rng, c = random.Random(1), C.counter(PATH)
    for _ in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        exact = [library(text[:j]) for j in range(len(text) + 1)]
        assert c.prefixes(text) == exact
        assert sum(c.counts(text)) == exact[-1]
        for budget in (0, 1, 4):
            assert c.longest_prefix(text, budget) == max(j for j, n in enumerate(exact) if n <= budget)


def test_whole_texts_match_the_library(spark, library, odd_docs, odd_texts):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in texts], "doc_id long, text string")
    for got, row in zip(sorted(C.count_tokens(df, PATH).collect(), key=lambda r: r.doc_id), texts, strict=True):
        assert (got.n_tokens, got.n_bytes) == (library(row["text"]), len(row["text"].encode()))
        assert got.over_limit == (got.n_tokens > 1024)
        assert library(row["text"][: got.cut_chars]) <= 1024
    odd = C.count_tokens(odd_docs, PATH).collect()
    assert len(odd) == len(odd_texts) + 3
    assert {(r.doc_id, r.n_tokens) for r in odd if r.doc_id is not None} == {(i, library(t)) for i, t in enumerate(odd_texts)}


def test_stored_counts_answer_truncation(spark, library, no_docs):
    df = spark.createDataFrame([(1, "The cat's  whiskers\n\n twitch"), (2, None), (3, "")], "doc_id int, text string")
    stored = C.with_prefix_counts(df, PATH)
    got = {r.doc_id: r for r in stored.select("doc_id", "text", "prefix_tokens", C.truncate_to(F.col("text"), F.col("prefix_tokens"), F.lit(3)).alias("cut"), C.tokens_of_prefix(F.col("prefix_tokens"), F.lit(7)).alias("n7")).collect()}
    text = got[1].text
    assert got[1].prefix_tokens == [library(text[:j]) for j in range(len(text) + 1)]
    assert got[1].cut == text[: max(j for j, n in enumerate(got[1].prefix_tokens) if n <= 3)]
    assert got[1].n7 == library(text[:7])
    assert got[2].prefix_tokens == got[3].prefix_tokens == [0]
    assert C.count_tokens(no_docs, PATH).count() == 0


def test_full_tables_are_emptied(monkeypatch, library):
    monkeypatch.setattr(C, "CACHE_ENTRIES", 10)
    c = C.PrefixCounter(PATH)
    text = " ".join(f"word{i}ish" for i in range(200))
    c.learn([c.cut(text)])
    assert sum(c.counts(text)) == library(text)
