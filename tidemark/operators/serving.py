"""Issued forecasts: ensembles, immutability, resolution and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import trend_label
from tidemark.functions.text import reader_label
from tidemark.operators.sessions import OPEN, last_known, seconds
from tidemark.schemas import CLASSES
from tidemark.sources.staging import staged

PROBABILITIES = ("prob_down", "prob_flat", "prob_up")


def ensemble(rows: DataFrame, *by: str) -> DataFrame:
    """Class probabilities averaged over seeds, the first class that has the most, and how much that is."""
    mean = rows.groupBy(*by).agg(*[F.avg(p).alias(p) for p in PROBABILITIES])
    values = F.array(*PROBABILITIES)
    best = F.array_position(values, F.array_max(values)).cast("int")
    return mean.withColumns({"y_pred": F.element_at(F.array(*map(F.lit, CLASSES)), best), "confidence": F.greatest(*PROBABILITIES)})


def differs(issued: DataFrame, computed: DataFrame, ignore: tuple[str, ...] = ("issued_at",)) -> DataFrame:
    """Rows that only one side has; empty if issuing again would change nothing."""
    columns = [c for c in issued.columns if c not in ignore]
    a, b = issued.select(*columns), computed.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("issued")).unionByName(b.exceptAll(a).withColumn("side", F.lit("computed")))


def issue(computed: DataFrame, path: str) -> str:
    """Writes forecasts once: "written", "unchanged", or an error if other rows stand there already."""
    spark = computed.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        if differs(spark.read.parquet(path), computed).limit(1).count():
            raise ValueError(f"{path} was issued with other rows")
        return "unchanged"
    computed.write.mode("error").parquet(path)
    return "written"


def resolve(issued: DataFrame, panel: DataFrame, thresholds: DataFrame, issued_at: str = "issued_at") -> DataFrame:
    """Issued rows with what came of them, under the thresholds they were issued with, else those of the
    one row (q_low, q_high) of ``thresholds``.

    prospective: issued (local wall time) before the target session opened; a null counts as no.
    """
    truth = panel.select("ticker", "observation_date", "target_date", "target_return")
    rows = issued.join(truth, ["ticker", "observation_date"], "left")
    rows = rows.join(F.broadcast(thresholds.select(F.col("q_low").alias("_l"), F.col("q_high").alias("_h"))), F.lit(True))
    own = lambda name, value: F.coalesce(F.col(name), F.col(value)) if name in issued.columns else F.col(value)
    rows = rows.withColumn("y_true", trend_label(F.col("target_return"), own("threshold_low", "_l"), own("threshold_high", "_h"))).drop("_l", "_h")
    opens = F.col("target_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds(OPEN)))
    return rows.withColumns(
        {
            "correct": F.col("y_true") == F.col("y_pred"),
            "prospective": F.coalesce(F.col(issued_at) < opens, F.lit(False)),
            "issued_same_session": F.coalesce(F.to_date(issued_at) <= F.col("observation_date"), F.lit(False)),
        }
    )


def live_accuracy(resolved: DataFrame, *by: str) -> DataFrame:
    """Counts and accuracy; only prospective rows count for accuracy."""
    done = F.col("correct").isNotNull()
    return resolved.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(done).alias("n_resolved"),
        F.count_if(done & ~F.col("prospective")).alias("n_replayed"),
        F.count_if(~done).alias("n_pending"),
        F.avg(F.when(F.col("prospective"), F.col("correct").cast("double"))).alias("accuracy"),
    )


def last_sessions(sessions: DataFrame, observation: Column, lookback: int = 5) -> DataFrame:
    """The last sessions of each ticker up to a date."""
    past = sessions.where(F.col("session_date") <= observation)
    return past.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session_date")))).where(F.col("_r") <= lookback)


def top_news(aligned: DataFrame, sessions: DataFrame, observation: Column, lookback: int = 5, k: int = 5) -> DataFrame:
    """The k news of each ticker that the classifier is surest of, from its last sessions up to a date."""
    last = last_sessions(sessions, observation, lookback)
    own = aligned.join(last.select("ticker", F.col("session_date").alias("observation_date")), ["ticker", "observation_date"], "left_semi")
    sure = own.withColumns({"conviction": F.greatest("prob_negative", "prob_positive"), "_part": F.pmod(F.xxhash64("url"), F.lit(64))})
    # the best of each part of a ticker's news first, so that no task sorts all news of a busy one
    part = Window.partitionBy("ticker", "_part").orderBy(F.desc("conviction"), "url")
    sure = sure.withColumn("place", F.row_number().over(part)).where(F.col("place") <= k).drop("_part")
    order = Window.partitionBy("ticker").orderBy(F.desc("conviction"), "url")
    return sure.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def today(latest: DataFrame, closes: DataFrame, news: DataFrame, sessions: DataFrame, thresholds: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """What a reader sees of the latest forecasts: a row for each ticker with the close of its observation
    session, the band of flat prices, whether it is out of date, and the news behind it with titles.

    ``news`` is aligned and has titles, unless ``titles`` (url, title), one of a url at most, are given: those are
    looked up for the few news that are shown. The last sessions up to the newest observation count. Bounds are
    those the forecast was issued with, else those of ``thresholds``.
    """
    newest = latest.agg(F.max("observation_date").alias("_newest"))
    past = sessions.join(F.broadcast(newest), F.lit(True)).where(F.col("session_date") <= F.col("_newest"))
    shown = top_news(news, past.drop("_newest"), F.col("session_date"))
    if titles is not None:
        shown = staged(shown, "shown-news")
        own = titles.join(F.broadcast(shown.select("url").distinct()), "url", "left_semi")
        shown = shown.join(F.broadcast(own), "url", "left")
    cards = F.array_sort(F.collect_list(F.struct("place", "title", "url", F.round("conviction", 6).alias("conviction"), reader_label().alias("label"))))
    by_ticker = shown.groupBy("ticker").agg(cards.alias("news"))
    close = last_known(closes, latest.select("ticker", "observation_date"), "close")
    bounds = thresholds.select(F.col("q_low").alias("_l"), F.col("q_high").alias("_h"))
    rows = latest.join(close, ["ticker", "observation_date"], "left").join(by_ticker, "ticker", "left").join(F.broadcast(newest), F.lit(True)).join(F.broadcast(bounds), F.lit(True))
    band = flat_band(F.col("last_close"), F.coalesce("threshold_low", "_l"), F.coalesce("threshold_high", "_h"))
    return rows.select("ticker", "observation_date", "y_pred", F.greatest(*PROBABILITIES).alias("confidence"), "last_close", *band, (F.col("observation_date") < F.col("_newest")).alias("stale"), F.coalesce(F.size("news"), F.lit(0)).alias("n_news"), "news")


def flat_band(close: Column, low: Column, high: Column) -> list[Column]:
    """Prices at the class bounds, rounded half to even."""
    return [F.bround(close * (1 + t), 2).alias(n) for t, n in ((low, "band_low"), (high, "band_high"))]


def page(rows: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    """A page of the filtered rows with their total."""
    if not (0 < limit <= 5000 and 0 <= offset <= 1_000_000):
        raise ValueError("limit must be in 1..5000 and offset in 0..1000000")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))
