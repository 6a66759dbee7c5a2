"""The text classifier: what is held out, what is chosen, what a run leaves."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import textcv
from tidemark.sources import staging

WORDS = {"NEGATIVE": ["fall", "loss", "bad"], "NEUTRAL": ["day", "note", "hold"], "POSITIVE": ["rise", "gain", "good"]}
SMALL = {"penalties": (0.01,), "terms": 256, "size": 16}


def rows(spark, n=150, seed=1, noise=0.2):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        label = rng.choice(list(WORDS))
        told = label if rng.random() > noise else rng.choice(list(WORDS))
        text = lambda: " ".join(rng.choice(WORDS[told] + ["the", "of", f"x{k}"]) for _ in range(6))  # noqa: E731, B023
        out.append((k, f"{text()} t{k}", text() if k % 5 else None, label, ("uniform", "enriched", None)[k % 3]))
    return spark.createDataFrame(out, "doc_id long, title string, body string, label string, stratum string")


def test_every_row_is_held_out_once_by_a_model_that_never_saw_it(spark):
    own = rows(spark)
    found = {r.fold: r for r in textcv.cross_validated(own, "title_context", "head", folds=3, **SMALL).collect()}
    assert sorted(found) == [1, 2, 3] and sum(r.holdout_size for r in found.values()) == 150
    for r in found.values():
        assert r.train_size + r.validation_size + r.holdout_size == 150
        assert sum(r[f"c{t}{p}"] for t in range(3) for p in range(3)) == r.holdout_size
        assert r.accuracy == pytest.approx(sum(r[f"c{k}{k}"] for k in range(3)) / r.holdout_size)
        assert 0.6 < r.macro_f1 < 1
    total = textcv.aggregated(spark.createDataFrame(list(found.values()))).first()
    mean = sum(r.macro_f1 for r in found.values()) / 3
    assert total.macro_f1_mean == pytest.approx(mean) and total.macro_f1_std == pytest.approx((sum((r.macro_f1 - mean) ** 2 for r in found.values()) / 2) ** 0.5)
    # labels that say nothing about the text can't be foreseen
    shuffled = own.withColumn("label", F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.hash("doc_id"), F.lit(3)) + 1).cast("int")))
    assert textcv.aggregated(textcv.cross_validated(shuffled, "title", "tail", folds=3, **SMALL)).first().macro_f1_mean < 0.5


def test_features_are_stored_once_whatever_the_number_of_folds(spark, monkeypatch):
    stored, whole = [], textcv.staged
    monkeypatch.setattr(textcv, "staged", lambda df, name: stored.append("features" in df.columns) or whole(df, name))
    carried, ranges = [], stats.staged
    monkeypatch.setattr(stats, "staged", lambda df, name: carried.append("features" in df.columns) or ranges(df, name))
    own = rows(spark, 90)
    twice = own.withColumn("doc_id", F.expr("doc_id div 2"))
    for given in (own, twice):
        found = textcv.cross_validated(given, "title", "head", folds=3, **SMALL).collect()
        assert sum(r.holdout_size for r in found) == 90 and all(r.train_size + r.validation_size + r.holdout_size == 90 for r in found)
    assert sum(stored) == 4 and carried and not any(carried)


def test_a_grid_stores_and_shuffles_an_input_once_and_leaves_nothing(spark, monkeypatch):
    stored, whole = [], textcv.staged
    monkeypatch.setattr(textcv, "staged", lambda df, name: stored.append(any(c.startswith("features") for c in df.columns)) or whole(df, name))
    trained, fit = [], textcv.fit
    monkeypatch.setattr(textcv, "fit", lambda train, penalty: trained.append(train.rdd.getNumPartitions()) or fit(train, penalty))
    before = sorted(os.listdir(staging.shared_dir(spark).removeprefix("file:")))
    grid = {"variants": ("title", "context"), "truncations": ("head", "tail", "head_tail"), "folds": 2, **SMALL}
    own = rows(spark, 90).repartition(4)
    found = {(r.input_variant, r.truncation_strategy): r for r in textcv.ablation(own, **grid).collect()}
    # features and splits of an input, whatever the number of truncations and folds
    assert len(found) == 6 and sum(stored) == 4
    # a gradient is shuffled for each part and iteration: small tables have one part
    assert set(trained) == {1} and len(trained) == 12
    assert sorted(os.listdir(staging.shared_dir(spark).removeprefix("file:"))) == before
    # each cell is what it is by itself
    alone = textcv.aggregated(textcv.cross_validated(own, "context", "tail", folds=2, **SMALL)).first()
    assert alone.data_size == found["context", "tail"].data_size == 90
    assert alone.macro_f1_mean == pytest.approx(found["context", "tail"].macro_f1_mean) and alone.accuracy_std == pytest.approx(found["context", "tail"].accuracy_std)


def test_parts_grow_with_the_rows(monkeypatch):
    monkeypatch.setattr(textcv, "PART_TOKENS", 1000)
    assert [textcv.parts(n, 10) for n in (0, 1, 100, 101, 1000)] == [1, 1, 1, 2, 10]


def test_no_whole_text_is_shuffled(spark, monkeypatch):
    long = rows(spark, 60).withColumn("body", F.repeat(F.concat(F.lit("many words "), F.col("doc_id") % 5), 500))
    shuffled, whole = [], textcv.staged

    def staged(df, name):
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Window":
            plan = plan.children().apply(0)
        shuffled.extend(plan.children().apply(0).output().apply(k).name() for k in range(plan.children().apply(0).output().size()))
        return whole(df, name)

    monkeypatch.setattr(textcv, "staged", staged)
    assert textcv.prepared(long, "context", "head", "doc_id", size=16, terms=256).count() == 5
    assert {"doc_id", "features"} <= set(shuffled) <= {"doc_id", "label_id", "features", "stratum", "_text"}


def test_given_folds_are_used_and_checked(spark):
    own = rows(spark, 90).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    found = textcv.cross_validated(own, "title", "head", folds=3, **SMALL).collect()
    assert [r.holdout_size for r in found] == [30, 30, 30]
    with pytest.raises(ValueError, match="folds must be"):
        textcv.cross_validated(own, "title", "head", folds=2, **SMALL)
    with pytest.raises(ValueError, match="4 folds are wanted"):
        textcv.cross_validated(own, "title", "head", folds=4, **SMALL)


def test_enriched_strata_only_train(spark):
    found = textcv.cross_validated(rows(spark), "title", "head", folds=2, eval_strata=("uniform",), **SMALL).collect()
    assert sum(r.holdout_size for r in found) == 100 and all(r.train_size + r.validation_size + r.holdout_size == 150 for r in found)


def test_a_run_leaves_results_and_models_and_a_failed_one_no_models(spark, tmp_path, monkeypatch):
    own, path = rows(spark, 90), f"{tmp_path}/cv"
    textcv.cross_validated(own, "title", "head", folds=2, path=path, save_models=True, **SMALL)
    assert sorted(x for x in os.listdir(path) if x.startswith("fold")) == ["fold-01", "fold-02"]
    settings = json.loads(spark.read.text(f"{path}/cv_results.json").first()[0])
    assert settings["data_size"] == 90 and settings["truncation_strategy"] == "head" and spark.read.parquet(f"{path}/cv_results").count() == 2

    whole = textcv.run_fold

    def failing(rows, fold, *rest):
        made = whole(rows, fold, *rest)
        if fold == 1:
            raise RuntimeError("an executor is gone for good")
        return made

    monkeypatch.setattr(textcv, "run_fold", failing)
    with pytest.raises(RuntimeError, match="gone for good"):
        textcv.cross_validated(own, "title", "head", folds=2, path=f"{tmp_path}/failed", save_models=True, **SMALL)
    assert [x for x in os.listdir(f"{tmp_path}/failed") if x.startswith("fold")] == []


def test_the_grid_keeps_metrics_and_no_models(spark, tmp_path):
    found = textcv.ablation(rows(spark, 90), f"{tmp_path}/grid", variants=("title", "context"), truncations=("head", "head_tail"), folds=2, **SMALL).collect()
    assert {(r.input_variant, r.truncation_strategy) for r in found} == {(v, h) for v in ("title", "context") for h in ("head", "head_tail")}
    assert [r.macro_f1_mean for r in found] == sorted((r.macro_f1_mean for r in found), reverse=True)
    assert not [d for _, folders, _ in os.walk(tmp_path) for d in folders if d == "model" or d.startswith("fold-")]
    assert spark.read.parquet(f"{tmp_path}/grid/ablation_summary").count() == 4


def test_what_cannot_be_trained_raises(spark):
    own = rows(spark, 60)
    for bad, message in (({"variant": "headline"}, "unknown input"), ({"how": "middle"}, "unknown truncation")):
        with pytest.raises(ValueError, match=message):
            textcv.cross_validated(own, **bad)
    with pytest.raises(ValueError, match="preliminary"):
        textcv.prepared(own.withColumn("annotation_source", F.lit("assistant_prelabel")), "title", "head", "doc_id")
    with pytest.raises(ValueError, match="no rows of"):
        textcv.weighted(spark.createDataFrame([(0,), (1,)], "label_id int"), True)
    weights = {r.label_id: r.weight for r in textcv.weighted(spark.createDataFrame([(0,), (1,), (2,), (2,)], "label_id int"), True).collect()}
    assert weights == {0: pytest.approx(4 / 3), 1: pytest.approx(4 / 3), 2: pytest.approx(2 / 3)}
