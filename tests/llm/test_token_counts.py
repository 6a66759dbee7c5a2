import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import bpe_vocab, token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in token_counts.op1_token_counts(spark, small).collect():
        assert r.n_tokens == expected(docs[r.doc_id])
        assert r.n_bytes == len((docs[r.doc_id] or "").encode())
        assert r.over_limit == (r.n_tokens > 1024)


def test_edge_cases(spark):
    found = cases.rows(token_counts.with_token_counts(cases.edge(spark)), "doc_id", "n_tokens")
    assert found == sorted(((i, expected(t)) for i, t in cases.EDGE), key=repr)
    assert token_counts.with_token_counts(cases.empty(spark)).collect() == []


def test_a_column_with_the_name_of_the_result_is_replaced(spark):
    made = token_counts.with_token_counts(cases.edge(spark, extra=True))
    assert made.columns.count("n_tokens") == 1 and dict(made.dtypes)["n_tokens"] == "bigint"


@pytest.mark.parametrize("seed", range(5))
def test_random_strings(seed):
    rng = random.Random(seed)
    count = token_counts.Counter(bpe_vocab.parse(bpe_vocab.read(public_tokenizers.path(token_counts.VOCABULARY)))).count
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "中", "😀", "1", "½", "'s", "'S", "<|endoftext|>", "​", "́", "!"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert count(text) == expected(text), repr(text)


def test_forgetting_pieces_changes_nothing():
    counter = token_counts.Counter(bpe_vocab.parse(bpe_vocab.read(public_tokenizers.path(token_counts.VOCABULARY))))
    counter.known.most = 1 << 17
    text = "some words and some more words, again and again " + " ".join(f"w{k}" for k in range(2000))
    assert [counter.count(text) for _ in range(3)] == [expected(text)] * 3
    assert counter.known.held <= counter.known.most
