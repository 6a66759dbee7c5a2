"""The point-in-time panel: price features, daily sentiment, targets and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.sessions import CUTOFF, align_forward, session_as_of
from tidemark.schemas import finite

WINDOW = 5
#: Rows of a ticker that an exponentially weighted mean folds at a time.
EWM_BLOCK = 256
#: Probabilities may miss a sum of one by this much (absolute tolerance plus the default relative one).
SUM_TOLERANCE = 1.01e-3
#: Values of at most 1 are summed in two halves of this many steps each.
STEPS = float(1 << 31)


def by_session(*extra: str) -> Window:
    return Window.partitionBy("ticker", *extra).orderBy("observation_date")


def full(aggregate, column: str, rows: int, frame) -> Column:
    """An aggregate of the last ``rows`` rows, null unless all of them have a value."""
    over = frame.rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(over) == rows, aggregate(column).over(over))


def price_features(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """Returns, volatility, moving-average ratio and change in volume, from this session and earlier ones."""
    schemas.require_columns(bars, "ticker", "session_date", "close", "volume")
    own = by_session()
    base = bars.withColumnRenamed("session_date", "observation_date").withColumns({"_p": F.lag("close").over(own), "_v": F.lag("volume").over(own)})
    base = base.withColumns(
        {
            "ret_1d": F.try_divide("close", "_p") - 1,
            "log_ret_1d": F.ln(F.try_divide("close", "_p")),
            "vol_change_1d": F.try_divide("volume", "_v") - 1,
        }
    )
    return base.withColumns(
        {
            f"roll_vol_{window}": full(F.stddev_samp, "ret_1d", window, own),
            f"ma_ratio_{window}": F.try_divide("close", full(F.avg, "close", window, own)),
        }
    ).drop("_p", "_v")


def usable(row_status: str = "mapping_status") -> Column:
    """Rows with a session and valid class probabilities."""
    probs = [F.col(c) for c in ("prob_negative", "prob_neutral", "prob_positive")]
    fine = F.col(row_status).isin(*schemas.MAPPED) & F.col("observation_date").isNotNull()
    for p in probs:
        fine = fine & finite(p) & p.between(0, 1)
    return fine & (F.abs(probs[0] + probs[1] + probs[2] - 1) <= SUM_TOLERANCE)


def argmax_id(*columns: str) -> Column:
    """Index of the greatest column, the first of those that tie."""
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_in_any_order(x: Column) -> Column:
    """The mean of values from -1 to 1: their sum is exact in units of 2**-62 and rounded once, so it doesn't depend on how rows are dealt."""
    high = F.floor(x * STEPS)
    low = F.floor((x * STEPS - high) * STEPS)
    return (F.sum(high) / STEPS + F.sum(low) / (STEPS * STEPS)) / F.count(x)


def daily_sentiment(aligned: DataFrame) -> DataFrame:
    """One row for each ticker and session with usable news; sessions without any are absent."""
    best = argmax_id("prob_negative", "prob_neutral", "prob_positive")
    polarity = F.col("prob_positive") - F.col("prob_negative")
    return (
        aligned.where(usable())
        .groupBy("ticker", "observation_date")
        .agg(
            F.count(F.lit(1)).alias("news_count"),
            F.lit(1).cast("long").alias("has_news"),
            mean_in_any_order(F.col("prob_negative")).alias("sent_prob_negative_mean"),
            mean_in_any_order(F.col("prob_neutral")).alias("sent_prob_neutral_mean"),
            mean_in_any_order(F.col("prob_positive")).alias("sent_prob_positive_mean"),
            F.avg((best == 2).cast("double")).alias("sent_pos_ratio"),
            F.avg((best == 0).cast("double")).alias("sent_neg_ratio"),
            mean_in_any_order(polarity).alias("sent_pos_minus_neg"),
            F.stddev_pop(polarity).alias("sent_dispersion"),
        )
    )


def fill_no_news(panel: DataFrame) -> DataFrame:
    """Sessions without news: neutral is certain, everything else is zero."""
    fills = {c: F.lit(1.0 if c == "sent_prob_neutral_mean" else 0.0) for c in schemas.SENTIMENT_FEATURES[2:]}
    fills |= {c: F.lit(0).cast("long") for c in schemas.SENTIMENT_FEATURES[:2]}
    return panel.withColumns({c: F.coalesce(c, v) for c, v in fills.items()})


def ewm(rows: DataFrame, column: str, span: int, name: str, order: str = "observation_date", key: str = "ticker") -> DataFrame:
    """Adds y0 = x0, y_t = (1 - a) y_{t-1} + a x_t with a = 2 / (span + 1), over all rows of a key.

    Rows are folded in blocks of ``EWM_BLOCK``; blocks are then chained by what each ends with, a row for
    each block, so a long history neither is cut nor lies in one array. A null keeps the value before it.
    """
    keep = 1 - 2.0 / (span + 1)
    own = Window.partitionBy(key).orderBy(order)
    x = F.col(column).cast("double")
    # values before this row, so that the first value of all is known by its zero
    placed = rows.withColumns({"_b": F.floor((F.row_number().over(own) - 1) / EWM_BLOCK), "_k": F.count(x).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    share = F.when(F.col("_k") == 1, x).otherwise(x * (1 - keep))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    values = F.collect_list(F.when(x.isNotNull(), share)).over(inside)
    local = placed.withColumns({"_y": F.aggregate(values, F.lit(0.0), lambda y, v: y * keep + v), "_n": F.size(values)})
    ends = local.groupBy(key, "_b").agg(F.max_by("_y", order).alias("y"), F.max("_n").alias("n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    chained = F.aggregate(F.collect_list(F.struct("y", "n")).over(before), F.lit(0.0), lambda s, e: s * F.pow(F.lit(keep), e["n"]) + e["y"])
    carried = ends.select(key, "_b", chained.alias("_carry"))
    joined = local.join(carried, [key, "_b"])
    return joined.select(*rows.columns, F.when(F.col("_k") > 0, F.col("_y") + F.pow(F.lit(keep), "_n") * F.col("_carry")).alias(name))


def rolling_sentiment(panel: DataFrame, window: int = WINDOW) -> DataFrame:
    """Causal rolling and exponentially weighted features; fewer rows than the window are enough."""
    own = by_session()
    over = own.rowsBetween(1 - window, 0)
    return ewm(panel, "sent_pos_minus_neg", window, "sent_pos_minus_neg_ewm").withColumns(
        {
            "sent_pos_minus_neg_roll": F.avg("sent_pos_minus_neg").over(over),
            "news_count_roll_sum": F.sum("news_count").over(over).cast("double"),
            "has_news_roll_mean": F.avg("has_news").over(over),
        }
    )


def with_target(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """The return from this session's close to the one ``horizon`` sessions later, and that session."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    own = by_session()
    return panel.withColumns({"target_date": F.lead("observation_date", horizon).over(own), "target_return": F.try_divide(F.lead("close", horizon).over(own), F.col("close")) - 1})


def cross_sectional_excess(panel: DataFrame, column: str = "target_return") -> DataFrame:
    """Replaces the return by its excess over the session's mean; null where one finite name is all there is."""
    known = F.when(finite(F.col(column)), F.col(column))
    session = Window.partitionBy("target_date")
    return panel.withColumn(column, F.when(F.count(known).over(session) > 1, known - F.avg(known).over(session)))


def build_panel(bars: DataFrame, daily: DataFrame, horizon: int = 1, window: int = WINDOW, cutoff: str = CUTOFF) -> DataFrame:
    """One row for each ticker and session; news join on the session, many to one."""
    features = with_target(price_features(bars, window), horizon).withColumn("as_of", session_as_of(F.col("observation_date"), cutoff))
    joined = rolling_sentiment(fill_no_news(features.join(daily, ["ticker", "observation_date"], "left")), window)
    return joined.withColumns({"target_label": F.lit(None).cast("string"), "split": F.lit(None).cast("string")}).select(*schemas.PANEL)


def assemble(bars: DataFrame, news: DataFrame, **options) -> DataFrame:
    """News aligned, aggregated by session and joined to the price features."""
    return build_panel(bars, daily_sentiment(align_forward(news, bars.select("ticker", "session_date"))), **options)


def neutral_control(news: DataFrame) -> DataFrame:
    """The same rows and times with certain neutrality: what timing alone is worth."""
    return news.withColumns({"prob_negative": F.lit(0.0), "prob_neutral": F.lit(1.0), "prob_positive": F.lit(0.0)})


def fit_thresholds(train: DataFrame, low: float = 1 / 3, high: float = 2 / 3, column: str = "target_return") -> DataFrame:
    """One row (q_low, q_high): exact, linearly interpolated quantiles of the finite training returns; without any it raises when it is read."""
    if not 0 < low < high < 1:
        raise ValueError("need 0 < low < high < 1")
    none = F.raise_error(F.lit("no finite training return")).cast("double")
    return train.where(finite(F.col(column))).agg(*[F.coalesce(F.percentile(column, q), none).alias(n) for n, q in (("q_low", low), ("q_high", high))])


def trend_label(value: Column, low: Column, high: Column) -> Column:
    """DOWN below, UP above, FLAT between the bounds and on them; null without a finite return."""
    return F.when(finite(value), F.when(value < low, "DOWN").when(value > high, "UP").otherwise("FLAT"))


def label_panel(panel: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Labels under the one row of ``thresholds``, which is broadcast."""
    own = thresholds.select(F.col("q_low").alias("_l"), F.col("q_high").alias("_h"))
    return panel.join(F.broadcast(own), F.lit(True)).withColumn("target_label", trend_label(F.col("target_return"), F.col("_l"), F.col("_h"))).drop("_l", "_h")


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale) over rows that are finite in all columns; a scale of next to nothing is 1."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & finite(F.col(c))
    sums = train.where(fine).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") <= 1e-12, 1.0).otherwise(F.col(f"s_{c}")).alias("scale")) for c in columns])
    return sums.select(F.inline(pairs))


def scaled(panel: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns brought to mean 0 and scale 1 with frozen parameters, a row for each feature."""
    fit = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("_fit"))
    joined = panel.join(F.broadcast(fit), F.lit(True))
    return joined.withColumns({c: (F.col(c) - F.col("_fit")[c]["mean"]) / F.col("_fit")[c]["scale"] for c in columns}).drop("_fit")


def sequences(panel: DataFrame, features: list[str], length: int = WINDOW) -> DataFrame:
    """The last ``length`` rows of features of a ticker, where all are finite and the label is known."""
    over = by_session().rowsBetween(1 - length, 0)
    row = F.array(*[F.col(c).cast("double") for c in features])
    found = panel.withColumn("sequence", F.collect_list(row).over(over))
    whole = F.forall("sequence", lambda step: F.forall(step, lambda x: finite(x)))
    return found.where((F.size("sequence") == length) & whole & F.col("target_label").isNotNull())


def latest_sequences(panel: DataFrame, features: list[str], length: int = WINDOW) -> DataFrame:
    """The most recent sequence of each ticker; no label is needed."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("observation_date"))
    found = sequences(panel.withColumns({"_label": F.col("target_label"), "target_label": F.lit("known")}), features, length)
    last = panel.groupBy("ticker").agg(F.max("observation_date").alias("observation_date"))
    return found.withColumn("target_label", F.col("_label")).drop("_label").withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r").join(last, ["ticker", "observation_date"])
