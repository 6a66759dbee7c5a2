"""Positions, the book with drifted holdings, benchmarks and the tests around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import key_hash
from tidemark.functions.stats import SESSIONS_A_YEAR, series_stats
from tidemark.operators import evaluation
from tidemark.schemas import CLASSES, refuse
from tidemark.sources.staging import staged

BOOK = ("gross_return", "cost", "net_return", "turnover", "gross_exposure", "net_exposure", "n_positions", "one_sided")


def realized_returns(bars: DataFrame) -> DataFrame:
    """(ticker, target_date, realized_return) of every session but a ticker's first."""
    own = Window.partitionBy("ticker").orderBy("session_date")
    found = bars.select("ticker", F.col("session_date").alias("target_date"), (F.col("close") / F.lag("close").over(own) - 1).alias("realized_return"))
    return found.where("realized_return is not null")


def positions(rows: DataFrame, *by: str, label: str = "y_pred") -> DataFrame:
    """Equal weights in each leg; a book with one leg only is halved."""
    own = Window.partitionBy(*by)
    longs, shorts = (F.count_if(F.col(label) == c).over(own) for c in ("UP", "DOWN"))
    half = F.when((longs > 0) & (shorts > 0), 1.0).otherwise(0.5)
    leg = F.when(F.col(label) == "UP", F.try_divide(F.lit(1.0), longs)).when(F.col(label) == "DOWN", -F.try_divide(F.lit(1.0), shorts)).otherwise(0.0)
    return rows.withColumn("weight", half * leg)


def daily_book(predictions: DataFrame, returns: DataFrame, cost_bps: float, *by: str) -> DataFrame:
    """(by..., seed, target_date, gross, net, turnover, ...): the session series of each seed.

    Turnover is against yesterday's holdings after they drifted and in fractions of today's capital,
    which depends on yesterday's cost: a recursion, folded over the days of one (by, seed) in order.
    """
    if cost_bps < 0:
        raise ValueError("cost_bps must not be negative")
    keys = [*by, "seed"]
    joined = predictions.join(returns, ["ticker", "target_date"])
    if not joined.limit(1).count():
        raise ValueError("no prediction has a realized return")
    matched = positions(joined, *keys, "target_date")
    day = F.array_sort(F.collect_list(F.struct("ticker", F.struct(F.col("weight").alias("w"), F.col("realized_return").alias("r")))))
    w = F.col("weight")
    days = matched.groupBy(*keys, "target_date").agg(
        day.alias("day"),
        F.sum(w * F.col("realized_return")).alias("gross_return"),
        F.sum(F.abs(w)).alias("gross_exposure"),
        F.sum(w).alias("net_exposure"),
        F.count_if(w != 0).cast("double").alias("n_positions"),
        (~(F.max(w > 0) & F.max(w < 0))).cast("double").alias("one_sided"),
    )
    ordered = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("target_date", "day", "gross_return", "gross_exposure", "net_exposure", "n_positions", "one_sided"))).alias("days"))
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("held"), F.array().cast("array<double>").alias("turnovers"))

    def step(state, d):
        held, target = state["held"], F.map_from_entries(d["day"])
        bought = F.aggregate(F.map_keys(target), F.lit(0.0), lambda s, t: s + F.abs(F.element_at(target, t)["w"] - F.coalesce(F.try_element_at(held, t), F.lit(0.0))))
        left = F.aggregate(F.filter(F.map_keys(held), lambda t: ~F.map_contains_key(target, t)), F.lit(0.0), lambda s, t: s + F.abs(F.element_at(held, t)))
        turnover = bought + left
        growth = 1 + d["gross_return"] - turnover * (cost_bps / 10_000.0)
        growth = F.when(growth > 0, growth).otherwise(F.raise_error("the book was wiped out").cast("double"))
        drifted = F.transform_values(target, lambda _, x: x["w"] * (1 + x["r"]) / growth)
        return F.struct(drifted.alias("held"), F.concat(state["turnovers"], F.array(turnover)).alias("turnovers"))

    folded = ordered.withColumn("t", F.aggregate("days", start, step)["turnovers"])
    rows = folded.select(*keys, F.inline(F.zip_with("days", "t", lambda d, t: F.struct(d["target_date"].alias("target_date"), *[d[c].alias(c) for c in ("gross_return", "gross_exposure", "net_exposure", "n_positions", "one_sided")], t.alias("turnover")))))
    priced = rows.withColumn("cost", F.col("turnover") * (cost_bps / 10_000.0))
    return priced.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def seed_average(book: DataFrame, *by: str) -> DataFrame:
    """The session series, averaged over seeds."""
    return book.groupBy(*by, "target_date").agg(*[F.avg(c).alias(c) for c in BOOK])


def benchmarks(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """(target_date, equal_weight_rebalanced, buy_and_hold) on the given dates.

    Buy and hold lets equal initial weights drift: its return is that of the summed growth of all names,
    a missing return counting as none.
    """
    block = returns.join(dates.select("target_date").distinct(), "target_date")
    # one row holds the names; every date of the block gets each of them
    names = block.agg(F.collect_set("ticker").alias("_names"))
    grid = block.select("target_date").distinct().join(F.broadcast(names), F.lit(True)).select("target_date", F.explode("_names").alias("ticker")).join(block, ["target_date", "ticker"], "left")
    before = Window.partitionBy("ticker").orderBy("target_date").rowsBetween(Window.unboundedPreceding, -1)
    live = F.coalesce("realized_return", F.lit(0.0))
    grown = grid.withColumn("_v", F.coalesce(F.product(1 + live).over(before), F.lit(1.0)))
    return grown.groupBy("target_date").agg(F.avg("realized_return").alias("equal_weight_rebalanced"), (F.sum(F.col("_v") * live) / F.sum("_v")).alias("buy_and_hold"))


def market_regression(rows: DataFrame, book: str, market: str) -> DataFrame:
    """Least squares of the book on the market: alpha, beta, alpha's t and the residuals' Sharpe ratio."""
    y, x = F.col(book), F.col(market)
    s = rows.agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mx"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("beta") * F.col("sxy"))
    se = F.sqrt(rss / (F.col("n") - 2) * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))
    resid_std = F.sqrt(rss / (F.col("n") - 1))
    return s.select(
        "alpha",
        "beta",
        F.when(se > 0, F.col("alpha") / se).otherwise(0.0).alias("alpha_t"),
        F.when(resid_std > 0, F.col("alpha") / resid_std * F.sqrt(F.lit(SESSIONS_A_YEAR))).otherwise(0.0).alias("residual_sharpe"),
        F.col("n").cast("long").alias("n"),
    )


def permuted_returns(predictions: DataFrame, returns: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, seed, target_date, g): the gross return of the session's book in each draw, whose labels are
    shuffled among the session's names.

    A session is one array of its names, in their order; each draw orders their labels by hashes of its own,
    lays them on the names and sums weight times return, all within the row. Names without a return take
    part in the shuffle and hold no position.
    """
    known = predictions.join(returns.select("ticker", "target_date", "realized_return"), ["ticker", "target_date"], "left")
    own = known.groupBy("seed", "target_date").agg(F.array_sort(F.collect_list(F.struct("ticker", "y_pred", "realized_return"))).alias("_s"))
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    keys = [F.col(c).cast("string") for c in ("seed", "target_date", "draw")]
    order = F.array_sort(F.transform("_s", lambda x: F.struct(key_hash(seed, *keys, x["ticker"]).alias("h"), x["ticker"].alias("t"), x["y_pred"].alias("y"))))
    laid = F.transform("_s", lambda x, k: F.struct(F.element_at("_o", k + 1)["y"].alias("y"), x["realized_return"].alias("r")))
    found = every.withColumn("_o", order).withColumn("_l", F.filter(laid, lambda x: x["r"].isNotNull()))
    side = lambda label: F.filter("_l", lambda x: x["y"] == label)
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["r"])
    up, down = side("UP"), side("DOWN")
    mean = lambda rows: F.coalesce(F.try_divide(total(rows), F.size(rows)), F.lit(0.0))
    share = F.when((F.size(up) > 0) & (F.size(down) > 0), 1.0).otherwise(0.5)
    return found.where(F.size("_l") > 0).select("draw", "seed", "target_date", (share * (mean(up) - mean(down))).alias("g"))


def permutation_null(predictions: DataFrame, returns: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, sharpe) of the cost-free book under shuffled labels; without cost there is no recursion.

    Predictions are shuffled once, to their sessions; what leaves a session is one number for each draw.
    """
    daily = permuted_returns(predictions, returns, draws, seed)
    series = daily.groupBy("draw", "target_date").agg(F.avg("g").alias("g"))
    std = F.stddev_samp("g")
    return series.groupBy("draw").agg(F.when(std > 0, F.avg("g") / std * F.sqrt(F.lit(SESSIONS_A_YEAR))).otherwise(0.0).alias("sharpe"))


def break_even_bps(book: DataFrame) -> DataFrame:
    """Cost at which the mean gross return is spent on turnover, in basis points."""
    return book.agg((F.try_divide(F.avg("gross_return"), F.avg("turnover")) * 10_000).alias("break_even_bps"), F.avg("turnover").alias("mean_turnover"), F.avg("one_sided").alias("one_sided_fraction"))


def backtest_report(predictions: DataFrame, returns: DataFrame, arm: str, cost_bps: float = 20.0, samples: int = 2000, seed: int = 7, permutations: int = 200) -> DataFrame:
    """(section, statistic, value): everything that is told about one arm as an idealized close-to-close book.

    Sections: ``net``, ``gross`` and the two benchmarks with their series' statistics, ``book`` (turnover,
    exposures, break-even cost), ``gross_vs_market``, intervals of both series from drawn sessions and,
    unless no ``permutations`` are wanted, the distribution of the gross Sharpe ratio under shuffled labels. An arm
    without predictions and classes that aren't known raise.
    """
    own = predictions.where(F.col("arm") == arm)
    if not own.limit(1).count():
        raise ValueError(f"no predictions of {arm!r}")
    refuse(own.where(~F.coalesce(F.col("y_pred").isin(*CLASSES), F.lit(False))).select("y_pred"), "unknown class")
    book = staged(seed_average(daily_book(own, returns, cost_bps)), "book")
    market = staged(benchmarks(returns, book), "benchmarks")

    def told(section: str, row: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in row.columns])
        return row.select(F.lit(section).alias("section"), F.inline(pairs))

    def ends(section: str, column: str) -> DataFrame:
        found = evaluation.series_bootstrap(book, column, "target_date", samples, seed)
        return found.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.concat("statistic", F.lit(f"_{c}")).alias("statistic"), F.col(c).alias("value")) for c in ("low", "high", "p_le_zero")])))

    means = book.agg(F.avg("turnover").alias("mean_turnover"), F.avg("gross_exposure").alias("mean_gross_exposure"), F.avg(F.abs("net_exposure")).alias("mean_abs_net_exposure"), F.avg("one_sided").alias("one_sided_fraction"), F.avg("n_positions").alias("mean_positions"), (F.try_divide(F.avg("gross_return"), F.avg("turnover")) * 10_000).alias("break_even_bps"))
    parts = [
        *(told(name, series_stats(book, f"{name}_return", "target_date")) for name in ("net", "gross")),
        *(told(name, series_stats(market, name, "target_date")) for name in ("equal_weight_rebalanced", "buy_and_hold")),
        told("book", means),
        told("gross_vs_market", market_regression(book.join(market, "target_date"), "gross_return", "equal_weight_rebalanced")),
        ends("net_bootstrap", "net_return"),
        ends("gross_bootstrap", "gross_return"),
    ]
    if permutations:
        null = staged(permutation_null(own, returns, permutations, seed), "null")
        real = series_stats(book, "gross_return", "target_date").select(F.col("annualized_sharpe").alias("_real"))
        beaten = null.join(real, F.lit(True)).agg(F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("std"), F.avg((F.col("sharpe") >= F.col("_real")).cast("double")).alias("share_at_least"), F.count(F.lit(1)).alias("draws"))
        parts.append(told("permutation_null_gross_sharpe", beaten))
    return reduce(lambda a, b: a.unionByName(b), parts)
