import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import bpe_codec, bpe_vocab

PATH = public_tokenizers.path(bpe_codec.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe_vocab.parse(bpe_vocab.read(PATH))


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_digests_equal_the_library(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe_codec.op7_bpe_codec(spark, small).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(docs[r.doc_id])


def test_edge_cases(spark):
    found = cases.rows(bpe_codec.with_digests(cases.edge(spark)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(((i, *expected(t)) for i, t in cases.EDGE), key=repr)
    assert bpe_codec.with_digests(cases.empty(spark)).collect() == []
    assert bpe_codec.with_digests(cases.edge(spark, extra=True)).count() == len(cases.EDGE)


def test_chunks_of_a_text_are_cut_where_nothing_depends_on_it(monkeypatch):
    monkeypatch.setattr(bpe_codec.chunked, "__defaults__", (40, 10))
    encoder, rng = bpe_codec.Encoder(VOCABULARY), random.Random(2)
    for kinds in (["word", " ", "\n", "é", "́", "9", "'s", "x" * 50], ["abc", "'s", "'", "don't", "e", "é", "́"], ["--", "=", "'", "...", "a", "7"], ["中文", "字", "a", "́"]):
        for _ in range(60):
            text = "".join(rng.choice(kinds) for _ in range(80))
            assert encoder.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert max(len(c) for c, _ in bpe_codec.chunked("ab" * 5000)) < 60


@pytest.mark.parametrize("stride", [1, 3, 7, 16, 60])
def test_transducer_with_small_strides_equals_the_library(stride):
    lookahead = bpe_codec.sufficient_lookahead(VOCABULARY)
    transducer, rng = bpe_codec.Transducer(VOCABULARY, lookahead, stride), random.Random(stride)
    longest = max(transducer.sizes.values())
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "th", "x", "the of and ing tion".replace(" ", "")):
        piece = "".join(rng.choice(alphabet) for _ in range(700))
        found, most = [], 0
        for k in range(0, len(piece), 90):
            found += transducer.push(piece[k : k + 90].encode())
            most = max(most, len(transducer.held))
        assert most <= max(lookahead.values()) + longest + stride
        assert found, "tokens leave before the piece ends"
        assert found + transducer.finish() == LIBRARY.encode(piece, add_special_tokens=False).ids


def test_decoder_gives_the_librarys_text_however_the_ids_come():
    encoder, rng = bpe_codec.Encoder(VOCABULARY), random.Random(4)
    for text in ("", "hello world", "naïve café 中文字 😀", "a <|endoftext|> b"):
        ids, machine, shown = encoder.ids(text).tolist(), bpe_codec.Decoder(VOCABULARY), ""
        while ids:
            k = rng.randint(0, 2)
            shown += machine.feed(ids[:k])
            ids = ids[k:]
        assert shown + machine.close() == LIBRARY.decode(encoder.ids(text).tolist(), skip_special_tokens=False)


def test_decoder_waits_for_whole_characters():
    encoder = bpe_codec.Encoder(VOCABULARY)
    for text in ("hello world", "naïve café 中文字 😀", "a 😀 b"):
        assert bpe_codec.decode(VOCABULARY, encoder.ids(text), readable=True).split() == text.split()
    with pytest.raises(KeyError):
        bpe_codec.decode(VOCABULARY, [10**6])


def test_ids_and_readable_text(spark):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|> World"), (2, None), (3, "naïve 😀 x" * 3)], cases.DOCS)
    for row in bpe_codec.with_ids(docs).collect():
        assert row.token_ids == LIBRARY.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded.replace(" ", "") == (row.text or "").lower().replace(" ", "")
