"""A world of tickers and news derived from the driver's tables, and the same as SQL.

A ticker is a market segment; a session is a weekday with orders, so that weekends make gaps; news are
line items, published on the ship date at a minute that their keys give, with class probabilities
from tax and discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inputs(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in names]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each ticker and session: few, made once for the tables they come from."""
    return once(spark, "bars", inputs(sf_dir, "orders", "customer"), lambda: made_bars(spark, sf_dir))


def made_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where(F.weekday("o_orderdate") < 5)
    return (
        orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("session_date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.avg("o_totalprice").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored news; ``published`` is wall time in the study's zone."""
    # the small sides meet first, so that the items are shuffled once
    owners = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    items = read(spark, sf_dir, "lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1440
    return items.select(
        F.col("c_mktsegment").alias("ticker"),
        F.concat_ws("-", F.lit("n"), "l_orderkey", "l_linenumber").alias("url"),
        (F.to_date("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))).alias("published"),
        (F.col("l_tax") * 5).alias("prob_negative"),
        (1 - F.col("l_tax") * 5 - F.col("l_discount") * 5).alias("prob_neutral"),
        (F.col("l_discount") * 5).alias("prob_positive"),
    )


BARS = """bars AS (
    SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS session_date, min_by(o_totalprice, o_orderkey) AS open,
           max(o_totalprice) AS high, min(o_totalprice) AS low, avg(o_totalprice) AS close, count(*) AS volume
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2)"""
NEWS = """news AS (
    SELECT c_mktsegment AS ticker, concat('n-', l_orderkey, '-', l_linenumber) AS url,
           CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_minutes((l_orderkey * 37 + l_linenumber * 11) % 1440) AS published,
           l_tax * 5 AS prob_negative, 1 - l_tax * 5 - l_discount * 5 AS prob_neutral, l_discount * 5 AS prob_positive
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
