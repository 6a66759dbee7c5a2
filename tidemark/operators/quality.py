"""Checks over stored data and ingest of vendor prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import numbered_apart
from tidemark.schemas import finite, refuse

PRICES = ("open", "high", "low", "close")


def normalize_prices(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor prices with lower-case names, a time column and numbers; bad rows and repeated times raise."""
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "time" not in named.columns:
        named = named.withColumnRenamed(named.columns[0], "time")
    if ticker is not None:
        named = named.withColumn("ticker", F.lit(ticker))
    typed = named.withColumns({c: F.col(c).try_cast("double") for c in (*PRICES, "volume")} | {"time": F.col("time").try_cast("timestamp_ntz")})
    fine = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in (*PRICES, "volume")]) & (F.col("close") > 0) & (F.col("volume") > 0) & F.col("time").isNotNull()
    refuse(typed.where(~F.coalesce(fine, F.lit(False))), "bad price row")
    refuse(typed.groupBy("ticker", "time").count().where("count > 1"), "repeated time")
    return typed.select("ticker", "time", *PRICES, "volume")


def price_checks(bars: DataFrame) -> DataFrame:
    """(check, subject, violations) for each ticker: finite prices, positive close and volume, unique sessions."""
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    whole = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in PRICES])
    rules = bars.groupBy("ticker").agg(
        bad(whole).alias("finite_prices"),
        bad(F.col("close") > 0).alias("positive_close"),
        bad(F.col("volume") > 0).alias("positive_volume"),
        (F.count(F.lit(1)) - F.countDistinct("session_date")).alias("unique_session"),
        bad((F.col("low") <= F.col("close")) & (F.col("close") <= F.col("high"))).alias("close_in_range"),
    )
    checks = [c for c in rules.columns if c != "ticker"]
    return rules.select(F.col("ticker").alias("subject"), F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks])))


def probability_checks(news: DataFrame) -> DataFrame:
    """(check, violations) of scored news under the strict tolerance, before a batch is committed."""
    probs = [F.col(c) for c in ("prob_negative", "prob_neutral", "prob_positive")]
    inside = reduce(lambda a, b: a & b, [finite(p) & p.between(-1e-12, 1 + 1e-12) for p in probs])
    sums = F.abs(probs[0] + probs[1] + probs[2] - 1) <= 1e-6
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    found = news.agg(bad(inside).alias("in_range"), bad(sums).alias("sum_is_one"), (F.count(F.lit(1)) - F.countDistinct("ticker", "url")).alias("unique_link"))
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in found.columns])))


def coverage(panel: DataFrame) -> DataFrame:
    """Share of panel rows with news."""
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("has_news").alias("n_with_news"), F.round(F.sum("has_news") / F.count(F.lit(1)), 6).alias("coverage"))


def misclassified(rows: DataFrame, confidence: str) -> DataFrame:
    """Wrong rows, the surest first."""
    return numbered_apart(rows.where("y_true <> y_pred"), [F.desc(confidence), F.col("ticker"), F.col("target_date")], "place")
