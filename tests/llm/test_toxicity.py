import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import toxicity


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    found = toxicity.op4_toxicity(spark, data)
    assert found.where("score is null or score < 0 or score > 1").count() == 0
    assert found.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0
    one = found.first()
    assert one.held_out == (zlib.crc32(str(one.doc_id).encode()) % 3 == 1)
    seen = found.where("held_out").join(spark.read.parquet(f"{data}/labels.parquet").where("toxic is not null"), "doc_id").collect()
    caught = np.mean([r.predicted for r in seen if r.toxic == 1])
    wrong = np.mean([r.predicted for r in seen if r.toxic == 0])
    assert caught > 0.7 and wrong < 0.005


def pair_data(rule, share=0.5, n=3000):
    rng = np.random.default_rng(0)
    a, b, noise = toxicity.slot(b"insult"), toxicity.slot(b"group"), [toxicity.slot(f"n{k}".encode()) for k in range(50)]
    rows, labels = [], []
    for _ in range(n):
        x, y = rng.random() < share, rng.random() < share
        own = {int(s) for s in rng.choice(noise, 5)} | ({a} if x else set()) | ({b} if y else set())
        rows.append(np.array(sorted(own), np.int32))
        labels.append(int(rule(x, y)))
    return rows, np.array(labels)


def test_pairs_are_learnt_that_additive_weights_miss():
    model = toxicity.train(*pair_data(lambda x, y: x == y))
    # texts like those that were learnt from: five other words, with none, one or both of the pair
    score, rest = model.scorer(), "n1 n12 n23 n34 n45 "
    assert min(score(rest + "insult group"), score(rest)) > 0.8 and max(score(rest + "insult"), score(rest + "group")) < 0.2
    score = toxicity.train(*pair_data(lambda x, y: x and y, 0.3)).scorer()
    assert score(rest + "insult group") > 0.8 and max(score(rest), score(rest + "insult"), score(rest + "group")) < 0.2


def test_words_without_evidence_stay_out():
    rng = np.random.default_rng(1)
    rows, labels = pair_data(lambda x, y: rng.random() < 0.3)
    assert not len(toxicity.informative(rows, labels.astype(float)))


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    slots = sorted({toxicity.slot(w.encode()) for w in words[:20]})
    model = toxicity.Machine(0.3, np.array(slots), rng.normal(size=len(slots)), rng.normal(size=(len(slots), 4)))
    for size in (0, 1, 2, 7, 30):
        text = " ".join(rng.choice(words, size))
        own = sorted({slots.index(s) for s in map(toxicity.slot, text.encode().split()) if s in slots})
        logit = 0.3 + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for i in own for j in own if i < j)
        assert abs(model.scorer()(text) - 1 / (1 + np.exp(-logit))) < 1e-12


def test_pair_evidence_equals_brute_force(monkeypatch):
    rows, labels = pair_data(lambda x, y: x == y, n=400)
    for gather in (1 << 20, 300, 20):
        monkeypatch.setattr(toxicity, "GATHER", gather)

        def g2(states):
            n = len(labels)
            return 2 * sum(c * np.log(c * n / ((states == s).sum() * (labels == y).sum())) for s in set(states) for y in (0, 1) if (c := ((states == s) & (labels == y)).sum()))

        tested = np.unique(np.concatenate(rows))
        has = np.array([np.isin(tested, r) for r in rows])
        alone = np.array([g2(has[:, k].astype(int)) for k in range(len(tested))])
        bound = toxicity.pair_bound(min(sum(len(r) ** 2 for r in rows), len(tested) ** 2) / 2)
        brute = {(i, j) for i in range(len(tested)) for j in range(i + 1, len(tested)) if (has[:, i] & has[:, j]).any() and g2(2 * has[:, i] + has[:, j]) - alone[i] - alone[j] >= bound}
        have = np.array([has[labels == k].sum(0) for k in (0, 1)], float)
        total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        found = toxicity.pairs_with_evidence(rows, labels, tested, have, total, alone)
        assert {tuple(p) for p in found.tolist()} == brute and len(brute) == 1


def test_pairs_are_judged_in_bounded_memory():
    # a small class and short texts: nearly every pair that occurs could have the evidence, and is judged
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(3000, 120, replace=False)).astype(np.int32) for _ in range(600)]
    labels = (np.arange(600) % 20 == 0).astype(float)
    tracemalloc.start()
    toxicity.informative(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


@pytest.mark.parametrize("filler", [2_000, 5_000, 50_000])
def test_pairs_are_found_in_any_vocabulary(filler):
    # two planted pairs in 8 % of the texts, among words of which most are more frequent
    rng = np.random.default_rng(filler)
    pairs = [[toxicity.slot(w) for w in p] for p in ((b"insult", b"group"), (b"slur", b"folk"))]
    words = np.array([toxicity.slot(f"f{k}".encode()) for k in range(filler)])
    odds = 1 / np.arange(1, filler + 1) ** 0.7
    odds /= odds.sum()
    rows, labels = [], []
    for k in range(3000):
        own, label = set(words[rng.choice(filler, 60, p=odds)].tolist()), 0
        if k % 12 == 0:
            x, y = rng.random(2) < 0.5
            own |= {s for s, there in zip(pairs[k // 12 % 2], (x, y)) if there}
            label = int(x != y)
        rows.append(np.array(sorted(own), np.int32))
        labels.append(label)
    active = set(toxicity.informative(rows, np.array(labels, float)).tolist())
    assert {s for p in pairs for s in p} <= active and len(active) < 40


def test_small_samples_have_models(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.learn(docs, labels)
    assert len(model.active) > 3
    found = toxicity.with_scores(docs, model).join(labels.where("toxic is not null"), "doc_id").collect()
    assert len({r.score for r in found}) > 5 and np.mean([r.predicted for r in found if r.toxic == 0]) < 0.03


def test_edge_cases(spark):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    docs = cases.edge(spark)
    model = toxicity.learn(docs, nothing)
    assert {r.score < 1e-9 for r in toxicity.with_scores(docs, model).collect()} == {True}
    one = spark.createDataFrame([(6, 1), (6, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.with_scores(docs, toxicity.learn(docs, one, held_out=None)).where("predicted = 1").count() == len(cases.EDGE)
    assert toxicity.with_scores(cases.empty(spark), model).collect() == []
    left = toxicity.without_toxic(cases.edge(spark, extra=True), model)
    assert left.columns == cases.edge(spark, extra=True).columns and left.count() == len(cases.EDGE)


def test_same_tables_give_the_same_scores(spark, small):
    first, again = (cases.rows(toxicity.op4_toxicity(spark, small)) for _ in range(2))
    assert first == again
