import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import backtest, evaluation, ic

D = [dt.date(2024, 1, d) for d in (2, 3, 4)]
BARS = "ticker string, session_date date, close double"
PREDICTIONS = "ticker string, target_date date, seed int, arm string, y_true string, y_pred string"


@pytest.fixture(scope="module")
def returns(spark):
    rows = [("AAA", d, c) for d, c in zip(D, (100.0, 110.0, 99.0))] + [("BBB", d, c) for d, c in zip(D, (100.0, 90.0, 99.0))]
    return backtest.realized_returns(spark.createDataFrame(rows, BARS))


def calls(spark, *labels):
    rows = [(t, d, 42, "lstm_price", y, y) for d, day in zip(D[1:], labels) for t, y in zip(("AAA", "BBB"), day)]
    return spark.createDataFrame(rows, PREDICTIONS)


def test_book_by_hand(spark, returns):
    book = backtest.daily_book(calls(spark, ("UP", "DOWN"), ("DOWN", "UP")), returns, 0.0).orderBy("target_date").collect()
    assert [r.gross_return for r in book] == [pytest.approx(0.2)] * 2 and book[0].gross_exposure == 2.0
    assert book[0].turnover == pytest.approx(2.0) and book[1].turnover == pytest.approx(23 / 12 + 7 / 4)
    dear = backtest.daily_book(calls(spark, ("UP", "DOWN"), ("DOWN", "UP")), returns, 100.0).orderBy("target_date").first()
    assert dear.cost == pytest.approx(0.02) and dear.net_return == pytest.approx(0.18)
    kept = backtest.daily_book(calls(spark, ("UP", "DOWN"), ("UP", "DOWN")), returns, 0.0).orderBy("target_date").collect()
    assert kept[1].turnover == pytest.approx(1 / 3)
    one = backtest.daily_book(calls(spark, ("UP", "FLAT"), ("UP", "UP")), returns, 0.0).orderBy("target_date").first()
    assert (one.gross_exposure, one.net_exposure, one.one_sided) == (0.5, 0.5, 1.0)
    with pytest.raises(ValueError):
        backtest.daily_book(calls(spark, ("UP", "DOWN"), ("UP", "DOWN")), returns, -1.0)


@pytest.mark.parametrize("series, worst", [([-0.1], -0.1), ([-0.1, 0.05], -0.1), ([0.1, -0.2], -0.2), ([0.1, 0.1], 0.0)])
def test_drawdown(spark, series, worst):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1 + k), x) for k, x in enumerate(series)], "d date, x double")
    assert stats.series_stats(rows, "x", "d").first().max_drawdown == pytest.approx(worst)


def test_benchmarks(spark):
    rows = [(t, d, r) for t, s in (("A", 1), ("B", -1)) for d, r in zip(D[:2], (0.2 * s, 0.2 * s))]
    table = spark.createDataFrame(rows, "ticker string, target_date date, realized_return double")
    found = backtest.benchmarks(table, table.select("target_date")).orderBy("target_date").collect()
    assert [r.equal_weight_rebalanced for r in found] == [pytest.approx(0), pytest.approx(0)]
    assert [r.buy_and_hold for r in found] == [pytest.approx(0), pytest.approx(0.04)]


def test_metrics_by_hand(spark):
    pairs = [("DOWN", "DOWN"), ("DOWN", "FLAT"), ("FLAT", "FLAT"), ("FLAT", "FLAT")]
    found = evaluation.scores(spark.createDataFrame(pairs, "y_true string, y_pred string")).first()
    assert found.accuracy == 0.75 and found.balanced_accuracy == 0.75 and found.macro_f1 == pytest.approx((2 / 3 + 0.8 + 0) / 3)


def planted(spark, same=False):
    truth, rows = ["DOWN", "FLAT", "UP", "DOWN", "FLAT"], []
    for k in range(40):
        for t, y in enumerate(truth):
            other = truth[(t - 1) % 5]
            rows += [(f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(k), 42, "treated", y, y, k // 20), (f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(k), 42, "control", y, y if same else other, k // 20)]
    return spark.createDataFrame(rows, PREDICTIONS + ", window int")


def test_block_bootstrap_finds_a_planted_effect_and_none_where_there_is_none(spark):
    found = {r.metric: r for r in evaluation.date_block_bootstrap(planted(spark), "treated", "control", 50, 7).collect()}["macro_f1"]
    assert found.n_blocks == 40 and found.n_window_strata == 2 and found["mean"] > 0.3 and found.low > 0 and found.p_le_zero == 0
    none = {r.metric: r for r in evaluation.date_block_bootstrap(planted(spark, True), "treated", "control", 20, 7).collect()}["macro_f1"]
    assert none["mean"] == 0 and none.low == none.high == 0


def test_decomposition_adds_up(spark):
    rows = [(a, w, 0.1 * k + w, 0.2 * k, 0.3 * k) for k, a in enumerate(("p", "n", "r")) for w in (0, 1)]
    metrics = spark.createDataFrame(rows, "arm string, window int, macro_f1 double, balanced_accuracy double, accuracy double")
    for r in evaluation.information_gain(metrics, "p", "n", "r").collect():
        assert r.naive == pytest.approx(r.architecture + r.gain)


def test_average_ranks_and_spearman(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (2.0, 1.0), (4.0, 0.0)], "x double, y double")
    assert sorted(r.k for r in rows.withColumn("k", stats.average_rank("x")).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert stats.spearman(rows, "x", "y").first().ic == pytest.approx(-math.sqrt(0.9), abs=1e-9)
    flat = spark.createDataFrame([(1.0, k) for k in (1.0, 2.0, 3.0)], "x double, y double")
    assert stats.spearman(flat, "x", "y").first().ic is None


def test_auc_equals_counting_pairs(spark):
    rows = [("DOWN", 0.6, 0.3, 0.1), ("FLAT", 0.6, 0.2, 0.2), ("UP", 0.1, 0.2, 0.7), ("DOWN", 0.2, 0.5, 0.3), ("UP", 0.3, 0.3, 0.4)]
    found = evaluation.one_vs_rest_auc(spark.createDataFrame(rows, "y_true string, a double, b double, c double"), ["a", "b", "c"]).first().macro_auc
    areas = []
    for k, c in enumerate(("DOWN", "FLAT", "UP")):
        pos, neg = [r[k + 1] for r in rows if r[0] == c], [r[k + 1] for r in rows if r[0] != c]
        areas.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    assert found == pytest.approx(sum(areas) / 3)


def test_ic_targets(spark):
    rows = [("AAA", dt.date(2024, 1, 2 + k), c) for k, c in enumerate((100.0, 110.0, 99.0, 99.0))] + [("BBB", dt.date(2024, 1, 2 + k), c) for k, c in enumerate((100.0, 90.0, 99.0, 99.0))]
    found = {(r.ticker, r.observation_date.day): r for r in ic.ic_targets(spark.createDataFrame(rows, BARS)).collect()}
    assert found["AAA", 3].same_session_return == pytest.approx(0.1) and found["AAA", 2].next_session_excess_return == pytest.approx(0.1) and found["BBB", 5].next_session_return is None


def test_resampling_draws_as_many_blocks_as_there_are(spark):
    blocks = spark.createDataFrame([(k,) for k in range(9)], "b int")
    sums = evaluation.resampled(blocks, "b", 30, 1).groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert len(sums) == 30 and {r.n for r in sums} == {9}


def test_guard_of_paired_runs(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    evaluation.require_same_keys(a, a, ["k"])
    with pytest.raises(ValueError):
        evaluation.require_same_keys(a, a.where("k = 1"), ["k"])
