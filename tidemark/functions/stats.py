"""Ranks, correlations and series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

SESSIONS_A_YEAR = 252


def average_rank(column: str, *by: str) -> Column:
    """Rank within ``by``, ties getting the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2.0


def in_order(rows: DataFrame, order: list, count: str, *by: str) -> DataFrame:
    """Adds ``_before``, the sum of ``count`` over the rows of ``by`` that come before a row in ``order``.

    For few and large groups: rows are dealt by ranges of the order, each range is summed on its own and
    starts from what the ranges before it hold, so no task sees a whole group.
    """
    dealt = rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id())
    placed = staged(dealt, "ranges")
    sums = placed.groupBy("_part", *by).agg(F.sum(count).alias("_n"))
    # a row for each range
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(F.broadcast(starts.drop("_n")), ["_part", *by])
    return found.withColumn("_before", F.col("_start") + F.col("_in")).drop("_part", "_start", "_in")


def ranked_apart(rows: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    """Adds the average rank of ``column`` within few large groups: of the distinct values, joined back."""
    values = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    ranks = in_order(values, [F.col(column)], "_c", *by)
    return rows.join(ranks.select(*by, column, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name)), [*by, column])


def numbered_apart(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a row's number from 1 in the order over all rows, without one task that sorts them all."""
    return in_order(rows.withColumn("_c", F.lit(1).cast("long")), order, "_c").withColumn(name, (F.col("_before") + 1).cast("int")).drop("_before", "_c")


def numbered_within(rows: DataFrame, order: list[Column], name: str, *by: Column) -> DataFrame:
    """Adds a row's number from 1 in the order within few large groups; null is a group of its own."""
    groups = {f"_g{k}": F.coalesce(F.concat(F.lit("="), b.cast("string")), F.lit("")) for k, b in enumerate(by)}
    keys = {f"_k{k}": o for k, o in enumerate(order)}
    placed = in_order(rows.withColumns(groups | keys | {"_c": F.lit(1).cast("long")}), [F.col(k) for k in keys], "_c", *groups)
    return placed.withColumn(name, (F.col("_before") + 1).cast("int")).drop("_before", "_c", *groups, *keys)


def pearson(x: str, y: str) -> Column:
    """Aggregate; null for fewer than three rows or a side without spread."""
    spread = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.count(F.lit(1)) >= 3)
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    return F.when(spread, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by..., n, ic, distinct values of x): Pearson's correlation of average ranks."""
    if by:
        ranked = rows.withColumns({"_x": average_rank(x, *by), "_y": average_rank(y, *by)})
    else:
        ranked = ranked_apart(ranked_apart(rows, x, "_x"), y, "_y")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("ic"), F.countDistinct(x).alias("n_distinct"))


def mean_std(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean, population standard deviation and number of the known values."""
    return rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))


def series_stats(rows: DataFrame, column: str, date: str, *by: str) -> DataFrame:
    """Statistics of daily returns; the drawdown starts from the initial capital of 1."""
    own = Window.partitionBy(*by).orderBy(date)
    onward = own.rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("_e", F.product(1 + F.col(column)).over(onward))
    grown = grown.withColumn("_d", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(onward)) - 1)
    std = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return grown.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(column).alias("mean_daily_return"),
        std.alias("daily_volatility"),
        (F.pow(1 + F.avg(column), F.lit(SESSIONS_A_YEAR)) - 1).alias("annualized_return"),
        F.when(std > 0, F.try_divide(F.avg(column), std) * F.sqrt(F.lit(SESSIONS_A_YEAR))).otherwise(0.0).alias("annualized_sharpe"),
        (F.max_by("_e", date) - 1).alias("cumulative_return"),
        F.avg((F.col(column) > 0).cast("double")).alias("hit_rate"),
        F.least(F.lit(0.0), F.min("_d")).alias("max_drawdown"),
    )
