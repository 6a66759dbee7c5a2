"""Reports that are put together from parts: the book of one arm, and what news are worth."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import backtest, evaluation, panel, runs
from tidemark.schemas import CLASSES


@pytest.fixture(scope="module")
def made(spark):
    """Predictions of two arms, two seeds and three windows, and returns of four names."""
    rows, returns = [], []
    for day in range(30):
        date = f"2024-01-{day + 1:02}"
        for k, name in enumerate("ABCD"):
            true = CLASSES[(day * 7 + k * 3) % 3]
            returns.append((name, date, ((day * 13 + k * 29) % 21 - 10) / 500))
            for arm, shift in (("price", 0), ("both", 1)):
                for seed in (1, 2):
                    rows.append((day // 10, arm, seed, name, date, k % 2, true, CLASSES[(day * 5 + k * (seed + shift) + shift) % 3]))
    predictions = spark.createDataFrame(rows, "window int, arm string, seed int, ticker string, target_date string, has_news int, y_true string, y_pred string")
    return predictions.withColumn("target_date", F.to_date("target_date")).cache(), spark.createDataFrame(returns, "ticker string, target_date string, realized_return double").withColumn("target_date", F.to_date("target_date")).cache()


def test_the_book_of_an_arm_in_full(spark, made):
    predictions, returns = made
    report = {(r.section, r.statistic): r.value for r in backtest.backtest_report(predictions, returns, "both", 20.0, 200, 7, 50).collect()}
    own = predictions.where("arm = 'both'")
    book = backtest.seed_average(backtest.daily_book(own, returns, 20.0)).cache()
    for section, column in (("net", "net_return"), ("gross", "gross_return")):
        for name, value in stats.series_stats(book, column, "target_date").first().asDict().items():
            assert report[section, name] == pytest.approx(value)
    for r in evaluation.series_bootstrap(book, "net_return", "target_date", 200, 7).collect():
        assert report["net_bootstrap", f"{r.statistic}_low"] == pytest.approx(r.low) and report["net_bootstrap", f"{r.statistic}_high"] == pytest.approx(r.high)
    assert report["book", "break_even_bps"] == pytest.approx(backtest.break_even_bps(book).first()["break_even_bps"])
    null = [r.sharpe for r in backtest.permutation_null(own, returns, 50, 7).collect()]
    assert report["permutation_null_gross_sharpe", "mean"] == pytest.approx(sum(null) / 50) and report["permutation_null_gross_sharpe", "draws"] == 50
    assert {s for s, _ in report} == {"net", "gross", "equal_weight_rebalanced", "buy_and_hold", "book", "gross_vs_market", "net_bootstrap", "gross_bootstrap", "permutation_null_gross_sharpe"}
    assert report["equal_weight_rebalanced", "sessions"] == 30


def test_unknown_arms_and_classes_are_refused(spark, made):
    predictions, returns = made
    with pytest.raises(ValueError, match="no predictions"):
        backtest.backtest_report(predictions, returns, "none")
    for bad in ("SIDEWAYS", None):
        odd = predictions.withColumn("y_pred", F.when(F.col("ticker") == "A", F.lit(bad)).otherwise(F.col("y_pred")))
        with pytest.raises(ValueError, match="unknown class"):
            backtest.backtest_report(odd, returns, "both")


def test_shuffles_keep_a_session_s_labels(spark, made):
    predictions, returns = made
    own, short = predictions.where("arm = 'both' and seed = 1"), returns.where("not (ticker = 'D' and day(target_date) = 3)")
    g = {(r.draw, r.target_date): r.g for r in backtest.permuted_returns(own, short, 40, 7).collect()}
    assert len(g) == 40 * 30
    r = {x.ticker: x.realized_return for x in short.collect() if x.target_date.day == 3}
    labels = sorted(x.y_pred for x in own.collect() if x.target_date.day == 3)
    from itertools import permutations

    def book(laid):
        held = [(y, r[n]) for n, y in zip("ABCD", laid) if n in r]
        sides = [[v for y, v in held if y == c] for c in ("UP", "DOWN")]
        mean = [sum(x) / len(x) if x else 0.0 for x in sides]
        return (1.0 if all(sides) else 0.5) * (mean[0] - mean[1])

    possible = {round(book(p), 12) for p in permutations(labels)}
    drawn = {round(v, 12) for (_, day), v in g.items() if day.day == 3}
    assert drawn <= possible and len(drawn) > len(possible) / 3


def test_what_news_are_worth_in_full(spark, made):
    predictions, _ = made
    control = predictions.withColumn("y_pred", F.when((F.col("arm") == "both") & (F.col("ticker") == "B"), "FLAT").otherwise(F.col("y_pred")))
    rows = runs.gain_report(predictions, control, "price", "both", 100, 7).collect()
    assert len(rows) == 3 * 3 * (3 + 1)
    whole = {(r.metric, r.effect): r for r in rows if r.window is None}
    each = {(r.metric, r.effect, r.window): r.value for r in rows if r.window is not None}
    for metric, effect in whole:
        row = whole[metric, effect]
        assert row.value == pytest.approx(sum(each[metric, effect, w] for w in range(3)) / 3) and row.window_low <= row.value + 1e-12 and row.value <= row.window_high + 1e-12 and row.date_low <= row.date_high
    for metric in evaluation.METRICS:
        assert whole[metric, "naive"].value == pytest.approx(whole[metric, "architecture"].value + whole[metric, "information_gain"].value)
        for w in range(3):
            assert each[metric, "naive", w] == pytest.approx(each[metric, "architecture", w] + each[metric, "information_gain", w])
    with pytest.raises(ValueError):
        runs.gain_report(predictions, control.where("window < 2"), "price", "both", 10, 7)


def test_thresholds_need_a_training_return(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "target_return double")
    with pytest.raises(Exception, match="no finite training return"):
        panel.fit_thresholds(rows).collect()
