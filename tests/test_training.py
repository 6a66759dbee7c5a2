"""The recurrent arms: gradients, what training keeps, and models that tasks train like one would alone."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recurrent
from tidemark.operators import evaluation, training
from tidemark.schemas import CLASSES

RNG = np.random.default_rng(0)


def example(n=40, steps=4, widths=(3, 2)):
    parts = [RNG.standard_normal((n, steps, w)) for w in widths]
    y = (parts[0][:, -1, 0] + parts[-1][:, -2, 1] > 0).astype(int) + (parts[0][:, -2, 1] > 0.5)
    return parts, y


@pytest.mark.parametrize("widths", [(3,), (3, 2)])
@pytest.mark.parametrize("weighted", [False, True])
def test_gradients_equal_finite_differences(widths, weighted):
    parts, y = example(7, 4, widths) if len(widths) > 1 else ([RNG.standard_normal((7, 4, 3))], np.array([0, 1, 2, 0, 1, 2, 2]))
    w, weight = recurrent.initial(list(widths), 5, 3, np.random.default_rng(1)), np.array([1.0, 2.0, 0.5]) if weighted else None
    _, grad = recurrent.gradients(w, parts, y, weight)
    for name, value in w.items():
        for at in [tuple(RNG.integers(0, n) for n in value.shape) for _ in range(6)]:
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                ends.append(recurrent.gradients(moved, parts, y, weight)[0])
            assert grad[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_states_follow_the_recursion_one_row_and_step_at_a_time():
    parts, _ = example(3)
    w = recurrent.initial([3, 2], 4, 3, np.random.default_rng(2))
    got = recurrent.probabilities(w, parts, rows=2)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for row in range(3):
        joined = []
        for k, x in enumerate(parts):
            h, c = np.zeros(4), np.zeros(4)
            for step in x[row]:
                i, f, g, o = np.split(step @ w[f"x{k}"] + h @ w[f"h{k}"] + w[f"b{k}"], 4)
                c = logistic(f) * c + logistic(i) * np.tanh(g)
                h = logistic(o) * np.tanh(c)
            joined += list(h)
        z = np.exp(np.array(joined) @ w["head"] + w["bias"])
        assert got[row] == pytest.approx(z / z.sum())


def test_the_best_epoch_is_kept_and_patience_ends_training():
    parts, y = example(160)
    train, val = [x[:100] for x in parts], [x[100:] for x in parts]
    w, history = recurrent.fit(train, y[:100], val, y[100:], hidden=8, epochs=40, batch=16, rate=0.05, patience=4, seed=3)
    scores, best = history["val_scores"], history["best_epoch"]
    assert scores[best - 1] == max(scores) == history["best_val_macro_f1"] and best == scores.index(max(scores)) + 1
    assert len(scores) == best + 4 < 40
    assert recurrent.macro_f1(y[100:], recurrent.probabilities(w, val).argmax(1), 3) == max(scores)
    # the last epoch's weights are others
    again, _ = recurrent.fit(train, y[:100], val[:0], y[:0], hidden=8, epochs=len(scores), batch=16, rate=0.05, seed=3)
    assert any(not np.array_equal(again[k], w[k]) for k in w)


def test_without_validation_the_last_epoch_is_kept_and_learns():
    parts, y = example(200)
    w, history = recurrent.fit(parts, y, [x[:0] for x in parts], y[:0], hidden=8, epochs=30, batch=20, rate=0.02, seed=1)
    assert history["best_epoch"] == 30 and history["best_val_macro_f1"] is None and history["losses"][-1] < 0.6 * history["losses"][0]
    assert recurrent.macro_f1(y, recurrent.probabilities(w, parts).argmax(1), 3) > 0.8
    same, _ = recurrent.fit(parts, y, [x[:0] for x in parts], y[:0], hidden=8, epochs=30, batch=20, rate=0.02, seed=1)
    assert all(np.array_equal(same[k], w[k]) for k in w)


@pytest.mark.parametrize("bad", [{"epochs": 0}, {"batch": 0}, {"patience": 0}])
def test_settings_that_make_no_sense_raise(bad):
    parts, y = example(5)
    with pytest.raises(ValueError, match="at least 1"):
        recurrent.fit(parts, y, parts, y, **bad)
    with pytest.raises(ValueError, match="no rows"):
        recurrent.fit([x[:0] for x in parts], y[:0], parts, y)


def test_macro_f1_equals_that_of_the_evaluation(spark):
    y, p = RNG.integers(0, 3, 80), RNG.integers(0, 2, 80)
    rows = spark.createDataFrame([(CLASSES[a], CLASSES[b]) for a, b in zip(y, p)], "y_true string, y_pred string")
    assert evaluation.scores(rows).first()["macro_f1"] == pytest.approx(recurrent.macro_f1(y, p, 3))


ARMS = {"one": [["a", "b"]], "two": [["a", "b"], ["c"]]}
NETWORK = {"hidden": 6, "epochs": 5, "batch": 16, "rate": 0.02, "patience": 3}


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for window in (0, 1):
        for k in range(150):
            seq = RNG.standard_normal((3, 3)).tolist()
            label = CLASSES[int(seq[2][0] > 0) + int(seq[1][2] > 0.3)]
            split = "train" if k < 90 else "val" if k < 120 else "test"
            out.append((window, split, f"T{k % 3}", f"2024-{k // 28 + 1:02}-{k % 28 + 1:02}", "2025-01-01", k % 2, label, seq))
    return spark.createDataFrame(out, "window int, split string, ticker string, observation_date string, target_date string, has_news int, target_label string, sequence array<array<double>>").cache()


def test_each_model_is_what_training_it_alone_gives(spark, rows):
    dealt = training.model_rows(rows, ["a", "b", "c"], ARMS, (42, 43))
    models = training.trained(dealt.repartition(7), ARMS, 3, NETWORK).cache()
    found = {(r.window, r.arm, r.seed): r for r in models.collect()}
    assert len(found) == 2 * 2 * 2 and {r.member for r in found.values()} == {0}
    own = sorted((r for r in rows.collect() if r.window == 1), key=lambda r: (r.ticker, r.observation_date))
    cut = lambda split: [r for r in own if r.split == split]
    of = lambda part: ([np.array([[s[:2] for s in r.sequence] for r in part]), np.array([[s[2:] for s in r.sequence] for r in part])], np.array([CLASSES.index(r.target_label) for r in part]))
    (x, y), (vx, vy), (tx, _) = of(cut("train")), of(cut("val")), of(cut("test"))
    w, history = recurrent.fit(x, y, vx, vy, 3, seed=43, **NETWORK)
    row = found[1, "two", 43]
    assert row.best_epoch == history["best_epoch"] and row.val_scores == pytest.approx(history["val_scores"]) and row.n_train == 90
    assert all(np.allclose(pickle.loads(row.weights)[k], w[k]) for k in w)

    scored = training.predicted(dealt, models, ARMS, 3, slice_rows=7)
    proba = dict(zip(((r.ticker, r.observation_date) for r in cut("test")), recurrent.probabilities(w, tx), strict=True))
    got = scored.where("window = 1 and arm = 'two' and seed = 43").collect()
    assert len(got) == 30 and scored.count() == 30 * 8
    for r in got:
        p = proba[r.ticker, r.observation_date]
        assert [r.prob_down, r.prob_flat, r.prob_up] == pytest.approx(p.tolist()) and r.y_pred == CLASSES[int(p.argmax())]


def test_members_share_the_rows_and_average_their_probabilities(spark, rows):
    dealt = training.model_rows(rows.where("window = 0"), ["a", "b", "c"], {"one": ARMS["one"]}, (42,), member_rows=40)
    assert {r[0]: r[1] for r in dealt.where("split = 'train'").groupBy("member").count().collect()}.keys() == {0, 1, 2}
    models = training.trained(dealt, ARMS, 3, NETWORK).cache()
    assert models.agg(F.sum("n_train")).first()[0] == 90 and models.count() == 3
    scored = training.predicted(dealt, models, ARMS, 3).orderBy("ticker", "observation_date").collect()
    own = sorted((r for r in rows.where("window = 0 and split = 'test'").collect()), key=lambda r: (r.ticker, r.observation_date))
    x = [np.array([[s[:2] for s in r.sequence] for r in own])]
    mean = np.mean([recurrent.probabilities(pickle.loads(m.weights), x) for m in models.collect()], 0)
    assert np.array([[r.prob_down, r.prob_flat, r.prob_up] for r in scored]) == pytest.approx(mean)


def test_balanced_classes_must_all_occur(spark, rows):
    dealt = training.model_rows(rows.where("target_label <> 'UP' OR split = 'test'"), ["a", "b", "c"], {"one": ARMS["one"]}, (42,))
    with pytest.raises(Exception, match="no training rows"):
        training.trained(dealt, ARMS, 3, NETWORK, balanced=True).collect()


def test_a_run_is_assembled_from_all_arms(spark, tmp_path):
    from tidemark.operators import runs

    panel = []
    for t in range(2):
        for k in range(70):
            a, b = RNG.standard_normal(2)
            panel.append((f"T{t}", f"2024-{k // 28 + 1:02}-{k % 28 + 1:02}", f"2024-{(k + 1) // 28 + 1:02}-{(k + 1) % 28 + 1:02}", float(a), float(b), k % 2, float(a / 10 + RNG.standard_normal() / 30)))
    panel = spark.createDataFrame(panel, "ticker string, observation_date string, target_date string, a double, c double, has_news int, target_return double").withColumns({c: F.to_date(c) for c in ("observation_date", "target_date")})
    found, models = training.experiment(panel, ["a"], ["c"], n_windows=2, test_size=8, val_size=8, seeds=(1, 2), length=2, network=NETWORK)
    per_arm = {r.arm: (r.n, r.keys) for r in found.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("window", "ticker", "target_date").alias("keys")).collect()}
    assert per_arm == {a: (64, 32) for a in ("majority", "random", "logreg_price", "logreg_price_sentiment", "lstm_price", "lstm_price_sentiment")}
    summary = training.experiment_summary(found, samples=50)
    rows = {r.arm: r for r in summary.collect()}
    delta = rows["DELTA lstm_price_sentiment__minus__lstm_price"]
    assert delta.macro_f1_mean == pytest.approx(rows["lstm_price_sentiment"].macro_f1_mean - rows["lstm_price"].macro_f1_mean)
    assert delta.window_low <= delta.macro_f1_mean <= delta.window_high and delta.date_low <= delta.date_high
    training.write_experiment(f"{tmp_path}/run", found, models, summary, NETWORK)
    assert {r.name for r in runs.list_runs(spark, str(tmp_path)).collect()} == {"run"}
    assert runs.run_table(spark, str(tmp_path), "run", "networks").count() == 8 and runs.run_table(spark, str(tmp_path), "run", "stratified").count() > 0
    with pytest.raises(ValueError, match="empty"):
        training.experiment(panel.where("false"), ["a"], ["c"])
