"""Queries over predictions: metrics, resampling, the book and information coefficients.

Predictions are derived: an arm repeats the true label with a chance of its own, drawn by key.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.draws import draw, sql_hash, sql_uniform, uniform
from tidemark.functions.metrics import per_class
from tidemark.operators import backtest, evaluation, ic, ladder, quality, runs, serving, splits, training
from tidemark.plans.catalog import Catalog
from tidemark.plans.panel import FEATURES, TO_LABELS, WORLD, full_panel, labelled
from tidemark.schemas import CLASSES
from tidemark.sources.derived import BARS, bars, inputs
from tidemark.sources.staging import once, shared_dir

CATALOG = Catalog()
query = CATALOG.query

ARMS = {"price": 35, "price_sentiment": 45, "neutral": 38}
SEEDS = (42, 43)
#: The study's layout: test windows and their dates, validation dates, bootstrap draws and shuffles.
WINDOWS, TEST, VAL = 5, 60, 60
DRAWS, SHUFFLES = 2000, 200
KEYS = ("arm", "seed", "ticker", "CAST(target_date AS VARCHAR)")
PREDICTIONS = f"""tests AS (
    SELECT CAST(w AS INTEGER) AS window, date FROM dates, (SELECT unnest(range({WINDOWS})) AS w) WHERE rank > n - {TEST} * ({WINDOWS} - w) AND rank <= n - {TEST} * ({WINDOWS} - 1 - w)),
predictions0 AS (
    SELECT t.window, a.arm, s.seed, ticker, observation_date, target_date, target_label AS y_true, has_news, a.acc, q_low, q_high
    FROM labelled JOIN tests t ON target_date = t.date, (VALUES {', '.join(f"('{a}', {p})" for a, p in ARMS.items())}) AS a(arm, acc), (VALUES (42), (43)) AS s(seed)),
predictions AS (
    SELECT window, arm, seed, ticker, observation_date, target_date, y_true, has_news, q_low, q_high,
           CASE WHEN {sql_hash("'hit'", *KEYS)} % 100 < acc THEN y_true ELSE ['DOWN', 'FLAT', 'UP'][1 + {sql_hash("'other'", *KEYS)} % 3] END AS y_pred,
           {', '.join(f"{sql_uniform(repr(c), *KEYS)} / ({' + '.join(sql_uniform(repr(x), *KEYS) for x in CLASSES)}) AS prob_{c.lower()}" for c in CLASSES)}
    FROM predictions0)"""
TO_PREDICTIONS = (*TO_LABELS, PREDICTIONS)


def predictions(spark, d):
    """As many rows as test sessions, arms and seeds: made once for the tables they come from."""
    return once(spark, "predictions", inputs(d, *WORLD), lambda: made_predictions(spark, d))


def made_predictions(spark, d):
    rows = labelled(spark, d)
    windows = splits.walk_forward(rows, WINDOWS, TEST, VAL).where("split = 'test'")
    rows = splits.assign(rows, windows).where("target_label is not null").withColumnRenamed("target_label", "y_true")
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(p).alias("acc")) for a, p in ARMS.items()])
    rows = rows.select("*", F.inline(arms)).select("*", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    keys = ["arm", F.col("seed").cast("string"), "ticker", F.col("target_date").cast("string")]
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    other = F.element_at(F.array(*map(F.lit, CLASSES)), (draw(3, "other", *keys) + 1).cast("int"))
    u = {c: uniform(c, *keys) for c in CLASSES}
    total = reduce(lambda a, b: a + b, u.values())
    return rows.select(
        "window", "arm", "seed", "ticker", "observation_date", "target_date", "y_true", "has_news",
        F.when(draw(100, "hit", *keys) < F.col("acc"), F.col("y_true")).otherwise(other).alias("y_pred"),
        *[(x / total).alias(f"prob_{c.lower()}") for c, x in u.items()],
    )


def cells(weight: str | None = None) -> str:
    one = lambda t, p: f"count_if(y_true = '{t}' AND y_pred = '{p}')"
    return ", ".join(f"{one(t, p)} AS c{i}{j}" for i, t in enumerate(CLASSES) for j, p in enumerate(CLASSES))


def metric_sql() -> dict[str, str]:
    true = [f"(c{k}0 + c{k}1 + c{k}2)" for k in range(3)]
    guessed = [f"(c0{k} + c1{k} + c2{k})" for k in range(3)]
    recall = [f"coalesce(c{k}{k} / nullif({true[k]}, 0)::DOUBLE, 0)" for k in range(3)]
    f1 = [f"coalesce(2 * c{k}{k} / nullif({true[k]} + {guessed[k]}, 0)::DOUBLE, 0)" for k in range(3)]
    present = " + ".join(f"(CASE WHEN {t} > 0 THEN 1 ELSE 0 END)" for t in true)
    return {
        "macro_f1": f"({' + '.join(f1)}) / 3",
        "balanced_accuracy": f"coalesce(({' + '.join(recall)}) / nullif({present}, 0), 0)",
        "accuracy": f"coalesce((c00 + c11 + c22) / nullif({' + '.join(true)}, 0)::DOUBLE, 0)",
    }


METRIC_COLUMNS = ", ".join(f"{v} AS {k}" for k, v in metric_sql().items())
TOTAL = " + ".join(f"c{i}{j}" for i in range(3) for j in range(3))
SCORES = f"""conf AS (SELECT window, arm, seed, {cells()} FROM predictions GROUP BY ALL),
scores AS (SELECT window, arm, seed, {TOTAL} AS n, {METRIC_COLUMNS} FROM conf)"""
METRICS = "macro_f1 balanced_accuracy accuracy"


@query("SELECT window, arm, seed, ticker, target_date, y_true, y_pred FROM predictions", TO_PREDICTIONS)
def derived_predictions(spark, d):
    return predictions(spark, d).select("window", "arm", "seed", "ticker", "target_date", "y_true", "y_pred")


@query(
    f"""SELECT t.window, arg_min(target_label, {{'a': -k, 'b': list_position(['DOWN', 'FLAT', 'UP'], target_label)}}) AS y_pred FROM
       (SELECT w AS window, target_label, count(*) AS k FROM labelled, (SELECT CAST(unnest(range({WINDOWS})) AS INTEGER) AS w), dates
        WHERE target_date = date AND rank <= n - {TEST} * ({WINDOWS} - w) - {VAL} AND target_label IS NOT NULL GROUP BY ALL) t GROUP BY t.window""",
    TO_LABELS,
)
def majority_baseline(spark, d):
    rows = labelled(spark, d)
    return evaluation.majority_class(splits.assign(rows, splits.walk_forward(rows, WINDOWS, TEST, VAL)).where("split = 'train'"), "target_label", "window")


@query(
    f"""SELECT ticker, target_date, CASE WHEN u < a THEN 'DOWN' WHEN u < b THEN 'FLAT' ELSE 'UP' END AS y_pred FROM
        (SELECT ticker, target_date, {sql_uniform("'7'", "ticker", "CAST(target_date AS VARCHAR)")} AS u,
                (SELECT count_if(target_label = 'DOWN') / count(target_label) FROM labelled JOIN dates ON target_date = date WHERE rank <= n - 60) AS a,
                (SELECT count_if(target_label IN ('DOWN', 'FLAT')) / count(target_label) FROM labelled JOIN dates ON target_date = date WHERE rank <= n - 60) AS b
         FROM labelled JOIN dates ON target_date = date WHERE rank > n - 60 AND target_label IS NOT NULL)""",
    TO_LABELS,
)
def random_baseline(spark, d):
    rows = labelled(spark, d).where("target_label is not null")
    split = splits.assign(rows, splits.final_split(rows, 60))
    found = evaluation.random_class(split.where("split = 'train'"), split.where("split = 'val'"), "target_label", ["ticker", "target_date"], 7)
    return found.select("ticker", "target_date", "y_pred")


@query(f"SELECT target_date, arm, seed, {cells()} FROM predictions GROUP BY ALL", TO_PREDICTIONS)
def confusion(spark, d):
    return evaluation.confusion(predictions(spark, d), "target_date", "arm", "seed")


@query("SELECT * FROM scores", (*TO_PREDICTIONS, SCORES), METRICS)
def window_scores(spark, d):
    return evaluation.scores(predictions(spark, d), "window", "arm", "seed")


@query(
    f"""SELECT arm, stratum, {TOTAL} AS n, {METRIC_COLUMNS} FROM (SELECT arm, stratum, {cells()} FROM
        (SELECT *, unnest(['all', CASE WHEN has_news = 1 THEN 'has_news' ELSE 'no_news' END]) AS stratum FROM predictions) GROUP BY ALL)""",
    TO_PREDICTIONS,
    METRICS,
)
def stratified_scores(spark, d):
    return evaluation.stratified_scores(predictions(spark, d), "arm")


@query(
    " UNION ALL ".join(
        f"""SELECT arm, '{c}' AS label, coalesce(c{k}{k} / nullif(c0{k} + c1{k} + c2{k}, 0)::DOUBLE, 0) AS precision, coalesce(c{k}{k} / nullif(c{k}0 + c{k}1 + c{k}2, 0)::DOUBLE, 0) AS recall,
            coalesce(2 * c{k}{k} / nullif(c0{k} + c1{k} + c2{k} + c{k}0 + c{k}1 + c{k}2, 0)::DOUBLE, 0) AS f1, c{k}0 + c{k}1 + c{k}2 AS support FROM armconf"""
        for k, c in enumerate(CLASSES)
    ),
    (*TO_PREDICTIONS, f"armconf AS (SELECT arm, {cells()} FROM predictions GROUP BY arm)"),
    "precision recall f1",
)
def classification_report(spark, d):
    return per_class(evaluation.confusion(predictions(spark, d), "arm"))


@query(
    """SELECT avg(CASE WHEN n1 > 0 THEN (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) END) AS macro_auc FROM (
           SELECT k, sum(CASE WHEN hit THEN r END) AS s, count_if(hit) AS n1, count_if(NOT hit) AS n0 FROM (
               SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS r FROM (
                   SELECT 0 AS k, prob_down AS p, y_true = 'DOWN' AS hit FROM predictions UNION ALL SELECT 1, prob_flat, y_true = 'FLAT' FROM predictions
                   UNION ALL SELECT 2, prob_up, y_true = 'UP' FROM predictions)) GROUP BY k)""",
    TO_PREDICTIONS,
    "macro_auc",
)
def ovr_auc(spark, d):
    return evaluation.one_vs_rest_auc(predictions(spark, d), ["prob_down", "prob_flat", "prob_up"])


@query(
    f"SELECT arm, {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std' for m in METRICS.split())}, count(*) AS n_runs FROM scores GROUP BY arm",
    (*TO_PREDICTIONS, SCORES),
    " ".join(f"{m}_mean {m}_std" for m in METRICS.split()),
)
def ladder_summary(spark, d):
    return evaluation.summary(evaluation.scores(predictions(spark, d), "window", "arm", "seed"), "arm")


DELTAS = """deltas AS (SELECT window, avg(CASE WHEN arm = 'price_sentiment' THEN macro_f1 END) - avg(CASE WHEN arm = 'price' THEN macro_f1 END) AS delta FROM scores GROUP BY window)"""


@query("SELECT * FROM deltas", (*TO_PREDICTIONS, SCORES, DELTAS), "delta")
def ablation_delta(spark, d):
    return evaluation.paired_delta(evaluation.scores(predictions(spark, d), "window", "arm", "seed"), "price_sentiment", "price", "macro_f1")


def sql_weights(blocks: str, order: str, seed: int, by: str = "") -> str:
    """CTEs own and weights over a table of blocks, as ``evaluation.resampled`` draws them."""
    part = f"PARTITION BY {by} " if by else ""
    keys = [f"'{seed}'", *([f"CAST({by} AS VARCHAR)"] if by else []), "CAST(draw AS VARCHAR)", "CAST(slot AS VARCHAR)"]
    lead = f"{by}, " if by else ""
    return f"""own AS (SELECT {lead}{order}, row_number() OVER ({part}ORDER BY {order}) - 1 AS slot, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {lead}{order} FROM {blocks})),
picked AS (SELECT {lead}draw, {sql_hash(*keys)} % n AS slot FROM own, (SELECT unnest(range({DRAWS})) AS draw)),
weights AS (SELECT {lead}draw, {order}, weight FROM (SELECT {lead}draw, slot, count(*) AS weight FROM picked GROUP BY ALL) JOIN own USING ({lead}slot))"""


@query(
    """SELECT quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, avg(CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END) AS p_le_zero, (SELECT avg(delta) FROM deltas) AS mean
       FROM (SELECT draw, sum(delta * weight) / sum(weight) AS value FROM weights JOIN deltas USING (window) GROUP BY draw)""",
    (*TO_PREDICTIONS, SCORES, DELTAS, sql_weights("deltas", "window", 7)),
    "low high p_le_zero mean",
)
def window_bootstrap(spark, d):
    scored = evaluation.scores(predictions(spark, d), "window", "arm", "seed")
    return evaluation.window_bootstrap(evaluation.paired_delta(scored, "price_sentiment", "price", "macro_f1"), DRAWS, 7)


def drawn_sql(treated: str, control: str) -> str:
    """CTEs up to long: each draw's metric deltas of two arms, -1 for the sample itself."""
    return f"""confdaily AS (SELECT window, target_date, arm, seed, {cells()} FROM predictions WHERE arm IN ('{treated}', '{control}') GROUP BY ALL),
{sql_weights("confdaily", "target_date", 7, "window")},
summed AS (
    SELECT draw, window, arm, seed, {', '.join(f'sum(c{i}{j} * weight) AS c{i}{j}' for i in range(3) for j in range(3))} FROM weights JOIN confdaily USING (window, target_date) GROUP BY ALL
    UNION ALL SELECT -1, window, arm, seed, {', '.join(f'sum(c{i}{j})' for i in range(3) for j in range(3))} FROM confdaily GROUP BY ALL),
armed AS (SELECT draw, window, arm, {', '.join(f'avg({v}) AS {k}' for k, v in metric_sql().items())} FROM summed GROUP BY ALL),
drawn AS (SELECT draw, {', '.join(f'avg({m}) AS {m}' for m in METRICS.split())} FROM
    (SELECT draw, window, {', '.join(f"sum(CASE WHEN arm = '{treated}' THEN {m} ELSE -{m} END) AS {m}" for m in METRICS.split())} FROM armed GROUP BY ALL) GROUP BY draw),
long AS ({' UNION ALL '.join(f"SELECT draw, '{m}' AS metric, {m} AS value FROM drawn" for m in METRICS.split())})"""


DRAWN = drawn_sql("price_sentiment", "price")


@query(
    """SELECT metric, quantile_cont(CASE WHEN draw >= 0 THEN value END, 0.025) AS low, quantile_cont(CASE WHEN draw >= 0 THEN value END, 0.975) AS high,
              avg(CASE WHEN draw >= 0 THEN CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END END) AS p_le_zero, max(CASE WHEN draw = -1 THEN value END) AS mean,
              (SELECT count(*) FROM (SELECT DISTINCT window, target_date FROM confdaily)) AS n_blocks, (SELECT count(DISTINCT window) FROM confdaily) AS n_window_strata
       FROM long GROUP BY metric""",
    (*TO_PREDICTIONS, DRAWN),
    "low high p_le_zero mean",
)
def date_block_bootstrap(spark, d):
    return evaluation.date_block_bootstrap(predictions(spark, d), "price_sentiment", "price", DRAWS, 7)


@query(
    """SELECT window, metric, n - p AS architecture, r - n AS gain, r - p AS naive FROM (
           SELECT window, metric, avg(CASE WHEN arm = 'price' THEN value END) AS p, avg(CASE WHEN arm = 'neutral' THEN value END) AS n, avg(CASE WHEN arm = 'price_sentiment' THEN value END) AS r FROM (
               SELECT window, arm, 'macro_f1' AS metric, macro_f1 AS value FROM scores UNION ALL SELECT window, arm, 'balanced_accuracy', balanced_accuracy FROM scores
               UNION ALL SELECT window, arm, 'accuracy', accuracy FROM scores) GROUP BY window, metric)""",
    (*TO_PREDICTIONS, SCORES),
    "architecture gain naive",
)
def info_gain(spark, d):
    return evaluation.information_gain(evaluation.scores(predictions(spark, d), "window", "arm", "seed"), "price", "neutral", "price_sentiment")


@query("SELECT target_label AS label, count(*) AS n_rows, sum(count(*)) OVER () / (3 * count(*)) AS weight FROM labelled WHERE target_label IS NOT NULL GROUP BY target_label", TO_LABELS, "weight")
def class_weights(spark, d):
    return evaluation.class_weights(labelled(spark, d), "target_label", CLASSES)


@query(
    """SELECT place, window, arm, seed, ticker, target_date, y_true, y_pred FROM (
           SELECT *, row_number() OVER (ORDER BY c DESC, ticker, target_date) AS place FROM (SELECT *, round(greatest(prob_down, prob_flat, prob_up), 8) AS c FROM predictions WHERE arm = 'price' AND seed = 42 AND y_true <> y_pred))""",
    TO_PREDICTIONS,
)
def misclassified(spark, d):
    rows = predictions(spark, d).where("arm = 'price' and seed = 42").withColumn("c", F.round(F.greatest("prob_down", "prob_flat", "prob_up"), 8))
    return quality.misclassified(rows, "c").select("place", "window", "arm", "seed", "ticker", "target_date", "y_true", "y_pred")


@query(
    """SELECT target_date, max(CASE WHEN arm = 'neutral' THEN a END) AS neutral, max(CASE WHEN arm = 'price' THEN a END) AS price, max(CASE WHEN arm = 'price_sentiment' THEN a END) AS price_sentiment
       FROM (SELECT target_date, arm, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS a FROM predictions GROUP BY ALL) GROUP BY target_date""",
    TO_PREDICTIONS,
    "neutral price price_sentiment",
)
def accuracy_pivot(spark, d):
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a")
    return predictions(spark, d).groupBy("target_date", "arm").agg(right).groupBy("target_date").pivot("arm", sorted(ARMS)).agg(F.first("a"))


# --- the whole experiment ---------------------------------------------------

PRICE = ["ret_1d", "log_ret_1d", "roll_vol_5", "ma_ratio_5", "vol_change_1d"]
SENTIMENT = [
    "news_count", "has_news", "sent_prob_negative_mean", "sent_prob_neutral_mean", "sent_prob_positive_mean", "sent_pos_ratio", "sent_neg_ratio",
    "sent_pos_minus_neg", "sent_dispersion", "sent_pos_minus_neg_roll", "sent_pos_minus_neg_ewm", "news_count_roll_sum", "has_news_roll_mean",
]


def whole_experiment(spark, d):
    """Folder of a run of the whole ladder with recurrent arms and three seeds; made once for the tables."""

    def run():
        predictions, models = training.experiment(full_panel(spark, d), PRICE, SENTIMENT, WINDOWS, TEST, VAL)
        path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}/ladder"
        training.write_experiment(path, predictions, models, training.experiment_summary(predictions, DRAWS), training.NETWORK)
        return spark.createDataFrame([(path,)], "path string")

    root, name = once(spark, "experiment", inputs(d, *WORLD), run).first()["path"].rsplit("/", 1)
    return lambda table: runs.run_table(spark, root, name, table)


@query()
def experiment_summary(spark, d):
    """Arms and differences of a run with majority, random, logistic and recurrent arms."""
    return whole_experiment(spark, d)("summary")


@query()
def experiment_networks(spark, d):
    """What the training of each network did: losses and validation scores by epoch, and the epoch that was kept."""
    return whole_experiment(spark, d)("networks")


@query()
def experiment_predictions(spark, d):
    return whole_experiment(spark, d)("predictions")


# --- the book ---------------------------------------------------------------

RETURNS = "realized AS (SELECT ticker, observation_date AS target_date, ret_1d AS realized_return FROM features WHERE ret_1d IS NOT NULL)"
WEIGHTED = """weighted AS (
    SELECT arm, seed, target_date, ticker, realized_return AS r, (CASE WHEN nl > 0 AND ns > 0 THEN 1.0 ELSE 0.5 END) * (CASE y_pred WHEN 'UP' THEN 1.0 / nl WHEN 'DOWN' THEN -1.0 / ns ELSE 0.0 END)::DOUBLE AS w FROM (
        SELECT p.*, realized_return, count_if(y_pred = 'UP') OVER x AS nl, count_if(y_pred = 'DOWN') OVER x AS ns FROM predictions p JOIN realized USING (ticker, target_date) WINDOW x AS (PARTITION BY arm, seed, target_date)))"""
#: The derived closes jump by multiples, which no book survives: the book's returns are damped.
DAMPED = RETURNS.replace("ret_1d AS", "ret_1d * 0.005 AS")
TO_BOOK = (*TO_PREDICTIONS, DAMPED, WEIGHTED)
BOOK = "gross_return cost net_return turnover gross_exposure net_exposure n_positions one_sided"


def book_sql(cost: float) -> str:
    return f"""names AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT ticker FROM weighted)),
days AS (
    SELECT arm, seed, target_date, row_number() OVER (PARTITION BY arm, seed ORDER BY target_date) AS i, w, r, g, ge, ne, np, os FROM (
        SELECT x.arm, x.seed, x.target_date, list(coalesce(y.w, 0.0) ORDER BY k) AS w, list(coalesce(y.r, 0.0) ORDER BY k) AS r, sum(coalesce(y.w * y.r, 0.0)) AS g, sum(abs(coalesce(y.w, 0.0))) AS ge,
               sum(coalesce(y.w, 0.0)) AS ne, CAST(count_if(y.w <> 0) AS DOUBLE) AS np, CASE WHEN bool_or(y.w > 0) AND bool_or(y.w < 0) THEN 0.0 ELSE 1.0 END AS os
        FROM (SELECT DISTINCT arm, seed, target_date FROM weighted) x CROSS JOIN names LEFT JOIN weighted y ON x.arm = y.arm AND x.seed = y.seed AND x.target_date = y.target_date AND y.ticker = names.ticker GROUP BY ALL)),
rolled AS (
    SELECT arm, seed, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS target_date, 0.0::DOUBLE AS turnover, list_transform(any_value(w), lambda x: 0.0::DOUBLE) AS held FROM days GROUP BY arm, seed
    UNION ALL
    SELECT d.arm, d.seed, d.i, d.target_date, t.v AS turnover, list_transform(range(1, len(d.w) + 1), lambda k: d.w[k] * (1 + d.r[k]) / (1 + d.g - t.v * {cost} / 10000.0)) AS held
    FROM rolled b JOIN days d ON b.arm = d.arm AND b.seed = d.seed AND d.i = b.i + 1, LATERAL (SELECT list_sum(list_transform(range(1, len(d.w) + 1), lambda k: abs(d.w[k] - b.held[k]))) AS v) t),
book AS (
    SELECT arm, target_date, avg(g) AS gross_return, avg(turnover * {cost} / 10000.0) AS cost, avg(g - turnover * {cost} / 10000.0) AS net_return, avg(turnover) AS turnover, avg(ge) AS gross_exposure, avg(ne) AS net_exposure,
           avg(np) AS n_positions, avg(os) AS one_sided
    FROM rolled JOIN days USING (arm, seed, i, target_date) GROUP BY arm, target_date)"""


def damped(spark, d):
    return backtest.realized_returns(bars(spark, d)).withColumn("realized_return", F.col("realized_return") * 0.005)


def book(spark, d, cost):
    return backtest.seed_average(backtest.daily_book(predictions(spark, d), damped(spark, d), cost, "arm"), "arm")


@query("SELECT ticker, target_date, realized_return FROM realized", (BARS, FEATURES, RETURNS), "realized_return")
def realized_returns(spark, d):
    return backtest.realized_returns(bars(spark, d))


@query("SELECT arm, seed, target_date, ticker, w AS weight FROM weighted", TO_BOOK, "weight")
def positions(spark, d):
    matched = predictions(spark, d).join(damped(spark, d), ["ticker", "target_date"])
    return backtest.positions(matched, "arm", "seed", "target_date").select("arm", "seed", "target_date", "ticker", "weight")


@query("SELECT * FROM book", (*TO_BOOK, book_sql(0.0)), BOOK, recursive=True)
def book_cost0(spark, d):
    return book(spark, d, 0.0)


@query("SELECT * FROM book", (*TO_BOOK, book_sql(20.0)), BOOK, recursive=True)
def book_cost20(spark, d):
    return book(spark, d, 20.0)


STATS = "mean_daily_return daily_volatility annualized_return annualized_sharpe cumulative_return hit_rate max_drawdown"


@query(
    """SELECT arm, count(*) AS sessions, avg(x) AS mean_daily_return, stddev_samp(x) AS daily_volatility, pow(1 + avg(x), 252) - 1 AS annualized_return, avg(x) / stddev_samp(x) * sqrt(252) AS annualized_sharpe,
              max_by(e, target_date) - 1 AS cumulative_return, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, least(0, min(e / p - 1)) AS max_drawdown
       FROM (SELECT *, greatest(1, max(e) OVER (PARTITION BY arm ORDER BY target_date)) AS p FROM (
           SELECT arm, target_date, net_return AS x, product(1 + net_return) OVER (PARTITION BY arm ORDER BY target_date) AS e FROM book)) GROUP BY arm""",
    (*TO_BOOK, book_sql(20.0)),
    STATS,
    recursive=True,
    places=6,
)
def book_stats(spark, d):
    return stats.series_stats(book(spark, d, 20.0), "net_return", "target_date", "arm")


@query("SELECT avg(gross_return) / avg(turnover) * 10000 AS break_even_bps, avg(turnover) AS mean_turnover, avg(one_sided) AS one_sided_fraction FROM book WHERE arm = 'price_sentiment'", (*TO_BOOK, book_sql(20.0)), "break_even_bps mean_turnover one_sided_fraction", recursive=True, places=6)
def break_even(spark, d):
    return backtest.break_even_bps(book(spark, d, 20.0).where("arm = 'price_sentiment'"))


BENCHMARKS = """benchmarks AS (
    SELECT target_date, avg(r) AS equal_weight_rebalanced, sum(v * coalesce(r, 0)) / sum(v) AS buy_and_hold FROM (
        SELECT target_date, ticker, realized_return AS r, coalesce(product(1 + coalesce(realized_return, 0)) OVER (PARTITION BY ticker ORDER BY target_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS v
        FROM (SELECT DISTINCT target_date FROM weighted) CROSS JOIN (SELECT DISTINCT ticker FROM weighted) LEFT JOIN realized USING (target_date, ticker)) GROUP BY target_date)"""


@query("SELECT * FROM benchmarks", (*TO_BOOK, BENCHMARKS), "equal_weight_rebalanced buy_and_hold")
def benchmarks(spark, d):
    return backtest.benchmarks(damped(spark, d), predictions(spark, d).select("target_date"))


@query(
    """SELECT alpha, beta, alpha / sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)) AS alpha_t, alpha / sqrt(rss / (n - 1)) * sqrt(252) AS residual_sharpe, n FROM (
           SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss, regr_sxx(y, x) AS sxx, regr_avgx(y, x) AS mx, CAST(regr_count(y, x) AS BIGINT) AS n
           FROM (SELECT net_return AS y, equal_weight_rebalanced AS x FROM book JOIN benchmarks USING (target_date) WHERE arm = 'price_sentiment'))""",
    (*TO_BOOK, book_sql(20.0), BENCHMARKS),
    "alpha beta alpha_t residual_sharpe",
    recursive=True,
    places=6,
)
def market_regression(spark, d):
    own = book(spark, d, 20.0).where("arm = 'price_sentiment'")
    market = backtest.benchmarks(damped(spark, d), own.select("target_date"))
    return backtest.market_regression(own.join(market, "target_date"), "net_return", "equal_weight_rebalanced")


@query(
    """SELECT statistic, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, avg(CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END) AS p_le_zero FROM (
           SELECT unnest(['mean_daily_return', 'annualized_sharpe']) AS statistic, unnest([s / k, CASE WHEN sd > 1e-12 THEN s / k * sqrt(252) / sd ELSE 0 END]) AS value FROM (
               SELECT *, sqrt(greatest(0, (q - s * s / k) / (k - 1))) AS sd FROM (
                   SELECT draw, sum(weight) AS k, sum(gross_return * weight) AS s, sum(gross_return * gross_return * weight) AS q FROM weights JOIN (SELECT * FROM book WHERE arm = 'price') USING (target_date) GROUP BY draw))) GROUP BY statistic""",
    (*TO_BOOK, book_sql(0.0), "priced AS (SELECT target_date FROM book WHERE arm = 'price')", sql_weights("priced", "target_date", 7)),
    "low high p_le_zero",
    recursive=True,
    places=6,
)
def session_bootstrap(spark, d):
    return evaluation.series_bootstrap(book(spark, d, 0.0).where("arm = 'price'"), "gross_return", "target_date", DRAWS, 7)


PERMUTED = f"""every AS (SELECT p.*, draw FROM (SELECT * FROM predictions WHERE arm = 'price_sentiment') p, (SELECT unnest(range({SHUFFLES})) AS draw)),
mixed AS (
    SELECT a.seed, a.target_date, a.draw, a.ticker, b.y_pred FROM (SELECT *, row_number() OVER (PARTITION BY seed, target_date, draw ORDER BY ticker) AS k FROM every) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY seed, target_date, draw ORDER BY {sql_hash("'7'", "CAST(seed AS VARCHAR)", "CAST(target_date AS VARCHAR)", "CAST(draw AS VARCHAR)", "ticker")}, ticker) AS k FROM every) b USING (seed, target_date, draw, k)),
shuffled AS (
    SELECT draw, seed, target_date, sum(realized_return * (CASE WHEN nl > 0 AND ns > 0 THEN 1.0 ELSE 0.5 END) * (CASE y_pred WHEN 'UP' THEN 1.0 / nl WHEN 'DOWN' THEN -1.0 / ns ELSE 0.0 END)) AS g FROM (
        SELECT m.*, realized_return, count_if(y_pred = 'UP') OVER x AS nl, count_if(y_pred = 'DOWN') OVER x AS ns FROM mixed m JOIN realized USING (ticker, target_date) WINDOW x AS (PARTITION BY draw, seed, target_date)) GROUP BY ALL)"""


@query("SELECT draw, avg(g) / stddev_samp(g) * sqrt(252) AS sharpe FROM (SELECT draw, target_date, avg(g) AS g FROM shuffled GROUP BY ALL) GROUP BY draw", (*TO_BOOK, PERMUTED), "sharpe", places=6)
def permutation_null(spark, d):
    own = predictions(spark, d).where("arm = 'price_sentiment'")
    return backtest.permutation_null(own, damped(spark, d), SHUFFLES, 7)


@query()
def backtest_report(spark, d):
    """All that is told about one arm's book, as rows of sections and statistics."""
    return backtest.backtest_report(predictions(spark, d), damped(spark, d), "price_sentiment", 20.0, DRAWS, 7, SHUFFLES)


# --- information coefficients -----------------------------------------------

TARGETS = """ictargets AS (
    SELECT *, same_session_return - avg(same_session_return) OVER (PARTITION BY observation_date) AS same_session_excess_return, next_session_return - avg(next_session_return) OVER (PARTITION BY observation_date) AS next_session_excess_return
    FROM (SELECT ticker, observation_date, ret_1d AS same_session_return, target_return AS next_session_return FROM features))"""
SIGNAL = """icrows AS (
    SELECT ticker, observation_date, round(sent_pos_minus_neg, 9) AS x, round(next_session_excess_return, 9) AS y FROM panel JOIN ictargets USING (ticker, observation_date)
    WHERE has_news = 1 AND sent_pos_minus_neg IS NOT NULL AND next_session_excess_return IS NOT NULL)"""
TO_IC = (*TO_LABELS, TARGETS, SIGNAL)
RANKED = "SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM {rows}"


def signal(spark, d):
    rows = ic.signal_rows(full_panel(spark, d), ic.ic_targets(bars(spark, d)), "sent_pos_minus_neg", "next_session_excess_return")
    # sums of doubles differ in their last bits; ties must not depend on that
    return rows.withColumns({c: F.round(c, 9) for c in ("x", "y")})


@query("SELECT * FROM ictargets", (BARS, FEATURES, TARGETS), "same_session_return next_session_return same_session_excess_return next_session_excess_return")
def ic_targets(spark, d):
    return ic.ic_targets(bars(spark, d))


@query(f"SELECT count(*) AS n, corr(rx, ry) AS ic FROM ({RANKED.format(by='1', rows='icrows')})", TO_IC, "ic")
def ic_pooled(spark, d):
    return ic.pooled_ic(signal(spark, d))


@query(
    f"""SELECT count(*) AS sessions, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(*)) AS standard_error, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_statistic FROM (
        SELECT observation_date, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM ({RANKED.format(by='observation_date', rows='icrows')})
        GROUP BY observation_date HAVING count(*) >= 4 AND count(DISTINCT x) >= 3) WHERE ic IS NOT NULL""",
    TO_IC,
    "mean_ic standard_error t_statistic",
)
def ic_cross_sectional(spark, d):
    return ic.cross_sectional_ic(signal(spark, d))


@query(
    f"""SELECT quantile_cont(ic, 0.025) AS low, quantile_cont(ic, 0.975) AS high, avg(CASE WHEN ic <= 0 THEN 1.0 ELSE 0.0 END) AS p_le_zero FROM (
        SELECT draw, corr(rx, ry) AS ic FROM ({RANKED.format(by='draw', rows='drawn')}) GROUP BY draw)""",
    (
        *TO_IC,
        f"""own AS (SELECT observation_date, row_number() OVER (ORDER BY observation_date) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT observation_date FROM icrows)),
    drawn AS (SELECT draw, x, y FROM (SELECT draw, {sql_hash("'7'", "CAST(draw AS VARCHAR)", "CAST(slot AS VARCHAR)")} % n AS slot FROM own, (SELECT unnest(range({DRAWS})) AS draw)) JOIN own USING (slot) JOIN icrows USING (observation_date))""",
    ),
    "low high p_le_zero",
)
def ic_bootstrap(spark, d):
    return ic.bootstrap_ic(signal(spark, d), DRAWS, 7)


# --- fitted arms (no SQL twin) ----------------------------------------------


@query()
def logreg_metrics(spark, d):
    """Multinomial logistic regression by window, price features with and without sentiment."""
    price = ["ret_1d", "roll_vol_5", "ma_ratio_5"]
    found = ladder.run_ladder(full_panel(spark, d), {"price": price, "price_sentiment": [*price, "sent_pos_minus_neg", "news_count"]}, ("logreg",), WINDOWS, TEST, VAL)
    return evaluation.scores(found, "window", "arm", "seed")


@query(
    """SELECT ticker, target_date, ['DOWN', 'FLAT', 'UP'][list_position([d, f, u], greatest(d, f, u))] AS y_pred, greatest(d, f, u) AS confidence FROM
       (SELECT ticker, target_date, avg(prob_down) AS d, avg(prob_flat) AS f, avg(prob_up) AS u FROM predictions WHERE arm = 'price' GROUP BY ALL)""",
    TO_PREDICTIONS,
    "confidence",
)
def ensemble_predict(spark, d):
    return serving.ensemble(predictions(spark, d).where("arm = 'price'"), "ticker", "target_date").select("ticker", "target_date", "y_pred", "confidence")
