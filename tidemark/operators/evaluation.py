"""Baselines, metrics by window and seed, and resampling by whole dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw, uniform
from tidemark.functions.metrics import CELLS, confusion_counts, from_confusion
from tidemark.functions.stats import SESSIONS_A_YEAR, ranked_apart
from tidemark.schemas import CLASSES

METRICS = ("macro_f1", "balanced_accuracy", "accuracy")


def class_id(label: str, classes: tuple[str, ...] = CLASSES) -> Column:
    """Position in the fixed order of classes; null for anything else."""
    return F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1


def label_counts(rows: DataFrame, label: str, *by: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Rows of each class in the fixed order, zeros included."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(label) == c).alias(f"n_{c.lower()}") for c in classes])


def majority_class(train: DataFrame, label: str, *by: str) -> DataFrame:
    """The most frequent class, the first in order of those that tie."""
    counted = train.where(F.col(label).isNotNull()).groupBy(*by, label).count()
    return counted.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("count"), class_id(label))).alias("y_pred"))


def random_class(train: DataFrame, test: DataFrame, label: str, keys: list[str], seed: int, *by: str) -> DataFrame:
    """Test rows with a class drawn from the training shares."""
    shares = label_counts(train, label, *by)
    total = sum((F.col(f"n_{c.lower()}") for c in CLASSES[1:]), F.col(f"n_{CLASSES[0].lower()}"))
    cuts = shares.select(*by, (F.col("n_down") / total).alias("_a"), ((F.col("n_down") + F.col("n_flat")) / total).alias("_b"))
    joined = test.join(cuts, list(by)) if by else test.join(F.broadcast(cuts), F.lit(True))
    u = uniform(seed, *[F.col(k).cast("string") for k in keys])
    return joined.withColumn("y_pred", F.when(u < F.col("_a"), "DOWN").when(u < F.col("_b"), "FLAT").otherwise("UP")).drop("_a", "_b")


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Nine counts c00..c22 (true, predicted) for each group; two-phase, so groups may be large."""
    return predictions.groupBy(*by).agg(*confusion_counts())


def scores(predictions: DataFrame, *by: str) -> DataFrame:
    counted = confusion(predictions, *by).withColumn("n", sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0])))
    return counted.select(*by, "n", *[v.alias(k) for k, v in from_confusion().items()])


def stratified_scores(predictions: DataFrame, *by: str) -> DataFrame:
    """Scores overall and by whether the session had news."""
    strata = predictions.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("has_news") == 1, "has_news").otherwise("no_news"))).alias("stratum"))
    return scores(strata, *by, "stratum")


def one_vs_rest_auc(rows: DataFrame, probabilities: list[str], label: str = "y_true") -> DataFrame:
    """Mean over classes of the Mann-Whitney area; null unless every class occurs."""
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.col(p).alias("p")) for k, (c, p) in enumerate(zip(CLASSES, probabilities, strict=True))])
    long = rows.select(F.col(label).alias("_y"), F.inline(names))
    ranked = ranked_apart(long, "p", "_r", "k")
    hit = F.col("_y") == F.col("c")
    sums = ranked.groupBy("k").agg(F.sum(F.when(hit, F.col("_r"))).alias("s"), F.count_if(hit).alias("n1"), F.count_if(~hit).alias("n0"))
    area = F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
    return sums.agg(F.when(F.min("n1") > 0, F.avg(area)).alias("macro_auc"))


def class_weights(rows: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    """n / (K * count): rarer classes weigh more; a class without rows raises."""
    counted = rows.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    if missing := sorted(set(classes) - {r[0] for r in counted.select(label).collect()}):
        raise ValueError(f"no rows of {missing}")
    total = F.sum("n_rows").over(Window.partitionBy())
    return counted.select(F.col(label).alias("label"), "n_rows", (total / (len(classes) * F.col("n_rows"))).alias("weight"))


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation over windows and seeds of each metric."""
    return metrics.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in METRICS for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.count(F.lit(1)).alias("n_runs"))


def window_means(metrics: DataFrame, metric: str) -> DataFrame:
    """The metric of each (arm, window), averaged over seeds."""
    return metrics.groupBy("arm", "window").agg(F.avg(metric).alias("value"))


def paired_delta(metrics: DataFrame, treated: str, control: str, metric: str) -> DataFrame:
    """(window, delta) of two arms on the same windows."""
    means = window_means(metrics, metric)
    left, right = (means.where(F.col("arm") == a).select("window", F.col("value").alias(n)) for a, n in ((treated, "x"), (control, "y")))
    return left.join(right, "window").select("window", (F.col("x") - F.col("y")).alias("delta"))


def interval(draws: DataFrame, column: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of draws and the share that isn't positive."""
    return draws.groupBy(*by).agg(
        F.percentile(column, alpha / 2).alias("low"),
        F.percentile(column, 1 - alpha / 2).alias("high"),
        F.avg((F.col(column) <= 0).cast("double")).alias("p_le_zero"),
    )


def numbered(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """Adds slot 0.. and n within ``by``."""
    return rows.withColumns({"slot": F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})


def resampled(blocks: DataFrame, order: str, samples: int, seed: int, *by: str) -> DataFrame:
    """(by..., draw, order, weight): how often each block is drawn when as many blocks are drawn as there are.

    Blocks are dates or windows, which are few; the draws multiply them and never the rows behind them.
    """
    own = numbered(blocks.select(*by, order).distinct(), order, *by)
    drawn = own.select(*by, F.col("slot").alias("_s"), "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    picked = drawn.select(*by, "draw", draw(F.col("n"), seed, *[F.col(b).cast("string") for b in by], F.col("draw").cast("string"), F.col("_s").cast("string")).alias("slot"))
    weights = picked.groupBy(*by, "draw", "slot").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(own.select(*by, "slot", order), [*by, "slot"]).drop("slot")


def window_bootstrap(deltas: DataFrame, samples: int, seed: int) -> DataFrame:
    """Interval of the mean delta over resampled windows."""
    weights = resampled(deltas, "window", samples, seed)
    means = weights.join(deltas, "window").groupBy("draw").agg((F.sum(F.col("delta") * F.col("weight")) / F.sum("weight")).alias("value"))
    return interval(means, "value").join(deltas.agg(F.avg("delta").alias("mean")), F.lit(True))


def date_block_bootstrap(predictions: DataFrame, treated: str, control: str, samples: int, seed: int) -> DataFrame:
    """Interval of each metric's delta when whole dates are resampled within their window.

    Confusion matrices are summed by date first; draws reweight those, metrics are taken for each draw,
    window and seed, averaged over seeds, then over windows.
    """
    wanted = predictions.where(F.col("arm").isin(treated, control))
    daily = confusion(wanted, "window", "target_date", "arm", "seed")
    weights = resampled(wanted, "target_date", samples, seed, "window")
    summed = weights.join(daily, ["window", "target_date"]).groupBy("draw", "window", "arm", "seed").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in CELLS])
    point = daily.groupBy("window", "arm", "seed").agg(*[F.sum(c).alias(c) for c in CELLS]).withColumn("draw", F.lit(-1))
    both = summed.unionByName(point)
    scored = both.select("draw", "window", "arm", *[v.alias(k) for k, v in from_confusion().items()])
    sign = F.when(F.col("arm") == treated, 1.0).otherwise(-1.0)
    means = scored.groupBy("draw", "window", "arm").agg(*[F.avg(m).alias(m) for m in METRICS])
    deltas = means.groupBy("draw", "window").agg(*[F.sum(sign * F.col(m)).alias(m) for m in METRICS]).groupBy("draw").agg(*[F.avg(m).alias(m) for m in METRICS])
    long = deltas.select("draw", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    blocks = wanted.select("window", "target_date").distinct().agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("window").alias("n_window_strata"))
    ends = interval(long.where("draw >= 0"), "value", "metric")
    return ends.join(long.where("draw = -1").select("metric", F.col("value").alias("mean")), "metric").join(blocks, F.lit(True))


def series_bootstrap(rows: DataFrame, column: str, date: str, samples: int, seed: int) -> DataFrame:
    """Intervals of the mean and the Sharpe ratio over resampled sessions."""
    weights = resampled(rows, date, samples, seed)
    x, w = F.col(column), F.col("weight")
    sums = weights.join(rows.select(date, column), date).groupBy("draw").agg(F.sum(w).alias("n"), F.sum(x * w).alias("s"), F.sum(x * x * w).alias("q"))
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    mean = F.col("s") / F.col("n")
    draws = sums.select(mean.alias("mean_daily_return"), F.when(std > 1e-12, mean * F.sqrt(F.lit(SESSIONS_A_YEAR)) / std).otherwise(0.0).alias("annualized_sharpe"))
    long = draws.select(F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in draws.columns])))
    return interval(long, "value", "statistic")


def information_gain(metrics: DataFrame, price: str, neutral: str, real: str) -> DataFrame:
    """(window, metric): architecture = neutral - price, gain = real - neutral, naive = real - price."""
    long = metrics.select("arm", "window", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    pick = lambda a: F.avg(F.when(F.col("arm") == a, F.col("value")))
    means = long.groupBy("window", "metric").agg(pick(price).alias("p"), pick(neutral).alias("n"), pick(real).alias("r"))
    return means.select("window", "metric", (F.col("n") - F.col("p")).alias("architecture"), (F.col("r") - F.col("n")).alias("gain"), (F.col("r") - F.col("p")).alias("naive"))


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Two runs must have predicted the same rows; raises on a row that only one has, or on repeated keys."""
    a, b = left.select(*keys), right.select(*keys)
    if a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count():
        raise ValueError(f"the runs differ in {keys}")
    if a.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {keys}")
