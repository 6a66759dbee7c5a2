import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import language_id


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    found = language_id.op3_language_id(spark, data)
    assert found.where("score is null or score < 0 or score > 1").count() == 0
    one = found.first()
    assert one.held_out == (zlib.crc32(str(one.doc_id).encode()) % 4 == 2)
    known = spark.read.parquet(f"{data}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    right = found.where("held_out").join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_edge_cases(spark):
    rows = [(i, t, "xx" if i and i % 2 else "yy" if t and "lorem" in t else None) for i, t in cases.EDGE]
    net = language_id.learn(spark.createDataFrame(rows, cases.DOCS + ", lang string"), held_out=None)
    assert net.languages == ["xx", "yy"] or net.languages == ["xx"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.with_language(cases.edge(spark, extra=True), net).collect()}
    for doc_id in (1, 2, 3, 10):
        assert found[doc_id] == ("und", 0.0)
    assert found[9][0] in net.languages and 0 <= found[9][1] <= 1
    assert language_id.with_language(cases.empty(spark), net).collect() == []
    assert language_id.learn(cases.edge(spark).withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language_id.with_language(cases.edge(spark), None).collect()} == {"und"}


def test_a_single_language_has_score_one(spark):
    docs = spark.createDataFrame([(k, f"text number {k}", "en") for k in range(20)], cases.DOCS + ", lang string")
    found = language_id.with_language(docs, language_id.learn(docs, held_out=None)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("en", 1.0)}


def test_scores_equal_a_naive_convolution():
    rng = np.random.default_rng(1)
    texts = ["plain words in a row " * 30, "kurz", "ünïcödé und noch mehr davon"]
    net = language_id.train(*naive_training(texts, rng))
    found = language_id.predictor(net)(texts)
    for text, lang, score in zip(texts, *found, strict=True):
        raw = text.encode().lower()
        total = np.zeros(len(net.languages))
        for start in range(0, len(raw), language_id.WINDOW):
            own = raw[start : start + language_id.WINDOW]
            embedded = np.vstack([net.embedding[list(own.ljust(language_id.WINDOW, b"\0"))], np.zeros((max(language_id.WIDTHS) - 1, language_id.EMBEDDED))])
            pooled = []
            for k, width in enumerate(language_id.WIDTHS):
                for f in range(language_id.FILTERS):
                    weights = net.filters[: width * language_id.EMBEDDED, k * language_id.FILTERS + f]
                    pooled.append(max(float(embedded[at : at + width].ravel() @ weights) for at in range(language_id.WINDOW)))
            hidden = np.maximum(np.array(pooled) + net.bias, 0)
            logits = hidden @ net.out + net.out_bias
            total += len(own) * np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        expected = total / len(raw)
        assert net.languages[int(expected.argmax())] == lang and abs(expected.max() - score) < 1e-4


def naive_training(texts, rng):
    windows, owner, weights = language_id.training_windows(texts, rng)
    assert np.bincount(owner, weights) == pytest.approx(np.full(len(texts), weights.sum() / len(texts)), rel=1e-4)
    assert sum(len(t.encode()) for t in texts) == sum((w != 0).sum() for w in windows) - sum((windows[owner == k][-1] != 0).sum() for k in range(len(texts)))
    return windows, owner % 2, weights, ["a", "b"], 2
