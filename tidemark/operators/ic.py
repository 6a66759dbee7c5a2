"""Rank information coefficients of signals and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import draw
from tidemark.functions.stats import spearman
from tidemark.operators.evaluation import interval, numbered
from tidemark.schemas import finite


def ic_targets(bars: DataFrame) -> DataFrame:
    """Same- and next-session returns, raw and less the session's mean (its own name included)."""
    own = Window.partitionBy("ticker").orderBy("session_date")
    session = Window.partitionBy("observation_date")
    found = bars.select(
        "ticker",
        F.col("session_date").alias("observation_date"),
        (F.col("close") / F.lag("close").over(own) - 1).alias("same_session_return"),
        (F.lead("close").over(own) / F.col("close") - 1).alias("next_session_return"),
    )
    return found.withColumns({f"{c}_session_excess_return": F.col(f"{c}_session_return") - F.avg(f"{c}_session_return").over(session) for c in ("same", "next")})


def signal_rows(panel: DataFrame, targets: DataFrame, signal: str, target: str, news_only: bool = True) -> DataFrame:
    """(ticker, observation_date, x, y) with both finite."""
    rows = panel.join(targets, ["ticker", "observation_date"])
    rows = rows.where("has_news = 1") if news_only else rows
    return rows.where(finite(F.col(signal)) & finite(F.col(target))).select("ticker", "observation_date", F.col(signal).alias("x"), F.col(target).alias("y"))


def pooled_ic(rows: DataFrame) -> DataFrame:
    return spearman(rows, "x", "y").select("n", "ic")


def cross_sectional_ic(rows: DataFrame, min_names: int = 4) -> DataFrame:
    """Mean of the per-session coefficients, its standard error and t; one session has neither."""
    each = spearman(rows, "x", "y", "observation_date").where((F.col("n") >= min_names) & (F.col("n_distinct") >= 3) & F.col("ic").isNotNull())
    se = F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))
    return each.agg(F.count(F.lit(1)).alias("sessions"), F.avg("ic").alias("mean_ic"), F.when(F.count(F.lit(1)) > 1, se).alias("standard_error"), F.when(F.count(F.lit(1)) > 1, F.when(se > 0, F.avg("ic") / se).otherwise(0.0)).alias("t_statistic"))


def bootstrap_ic(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """Interval of the pooled coefficient when whole sessions are drawn with their cross-sections.

    Ranks of a pooled draw depend on all its rows, so this does multiply rows by draws: they are ranked
    draw by draw, each draw in a task of its own.
    """
    dates = numbered(rows.select("observation_date").distinct(), "observation_date")
    picked = dates.select("n", F.col("slot").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    picked = picked.select("draw", draw(F.col("n"), seed, F.col("draw").cast("string"), F.col("_s").cast("string")).alias("slot"))
    drawn = picked.join(dates.select("slot", "observation_date"), "slot").join(rows, "observation_date")
    return interval(spearman(drawn, "x", "y", "draw").where("ic is not null"), "ic")
