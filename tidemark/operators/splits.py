"""Splits by whole dates: positions never matter, only which date a row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import key_hash
from tidemark.functions.stats import numbered_within
from tidemark.operators.sessions import to_local
from tidemark.schemas import refuse, require_columns


def ranked_dates(panel: DataFrame, column: str = "target_date") -> DataFrame:
    """(date, rank from 1, n): works on the distinct dates, which are few however many rows there are."""
    dates = panel.where(F.col(column).isNotNull()).select(F.col(column).alias("date")).distinct()
    return dates.withColumns({"rank": F.row_number().over(Window.orderBy("date")), "n": F.count(F.lit(1)).over(Window.partitionBy())})


def chronological_split(panel: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, column: str = "target_date") -> DataFrame:
    """(date, split): the last dates are test, those before validation, at least one each (half-even rounding)."""
    if not (0 < val_frac < 1 and 0 < test_frac < 1 and val_frac + test_frac < 1):
        raise ValueError("fractions must be in (0, 1) and leave training dates")
    dates = ranked_dates(panel, column)
    n_test, n_val = (F.greatest(F.lit(1), F.bround(F.col("n") * f, 0).cast("int")) for f in (test_frac, val_frac))
    left = F.col("n") - n_test
    split = F.when(F.col("rank") > left, "test").when(F.col("rank") > left - n_val, "val").otherwise("train")
    return dates.select("date", split.alias("split"))


def final_split(panel: DataFrame, val_size: int, column: str = "target_date") -> DataFrame:
    """(date, split): the last ``val_size`` dates are validation, all others train."""
    return ranked_dates(panel, column).select("date", F.when(F.col("rank") > F.col("n") - val_size, "val").otherwise("train").alias("split"))


def walk_forward(panel: DataFrame, n_windows: int, test_size: int, val_size: int = 0, min_train: int | None = None, expanding: bool = True, column: str = "target_date") -> DataFrame:
    """(window, date, split) of backtest windows laid out from the last date backwards.

    The last window's test block ends with the last date, each earlier one a block before it; without
    ``min_train`` the first window trains on every date that is left, with it on so many, and windows
    begin as early as that lets them. ``expanding`` windows train from the first date on, others on as
    many dates as the first one has. Dates that don't suffice raise.
    """
    for name, value, least in (("n_windows", n_windows, 1), ("test_size", test_size, 1), ("val_size", val_size, 0), ("min_train", 1 if min_train is None else min_train, 1)):
        if value < least:
            raise ValueError(f"{name} must be at least {least}")
    dates = ranked_dates(panel, column)
    # dates are few, and how many there are decides whether there is a plan at all
    total, evaluated = dates.count(), n_windows * test_size + val_size
    train = total - evaluated if min_train is None else min_train
    if train < 1 or train + evaluated > total:
        raise ValueError(f"{total} dates are too few for {n_windows} windows")
    last = F.lit(train + evaluated) - (F.lit(n_windows - 1) - F.col("window")) * test_size
    from_end = last - F.col("rank")
    block = (
        F.when(from_end < 0, None)
        .when(from_end < test_size, "test")
        .when(from_end < test_size + val_size, "val")
        .when(F.lit(expanding) | (from_end < test_size + val_size + train), "train")
    )
    each = dates.select("date", "rank", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window"))
    return each.select("window", "date", block.alias("split")).where("split is not null")


def assign(panel: DataFrame, split: DataFrame, column: str = "target_date") -> DataFrame:
    """Rows with their split (and window), by date."""
    return panel.drop("split").join(split, F.col(column) == F.col("date")).drop("date")


def dated_or_train(rows: DataFrame, dates: DataFrame, column: str) -> DataFrame:
    """Dated rows by whole dates; rows without a date only ever train."""
    known = assign(rows.where(F.col(column).isNotNull()), dates, column)
    return known.unionByName(rows.drop("split").where(F.col(column).isNull()).withColumn("split", F.lit("train")))


def by_hash(seed, key: str, *more: str) -> list:
    """An order that is drawn by key."""
    return [key_hash(*more, F.lit(seed), F.col(key)), F.col(key)]


def stratified_folds(rows: DataFrame, k: int, label: str, key: str, seed: int = 42, fold_by: str | None = None) -> DataFrame:
    """Adds fold 0..k-1 in turn within each label; with ``fold_by`` only rows whose value is ``eval`` get one."""
    groups = [F.col(label)] if fold_by is None else [F.col(label), F.col(fold_by)]
    placed = numbered_within(rows.drop("fold"), by_hash(seed, key), "_r", *groups)
    turn = (F.col("_r") - 1) % k
    return placed.withColumn("fold", turn if fold_by is None else F.when(F.col(fold_by) == "eval", turn)).drop("_r")


def time_column(rows: DataFrame) -> str:
    """Which column dates a text: ``date`` if there is one, else ``published_at``; without either it raises."""
    for name in ("date", "published_at"):
        if name in rows.columns:
            return name
    raise ValueError("neither date nor published_at: texts can't be split by time")


def text_split(rows: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """Texts with their split, by whole local dates of the study's zone; a row without a date raises."""
    dated = rows.withColumn("_day", F.to_date(to_local(rows, time_column(rows))))
    refuse(dated.where(F.col("_day").isNull()), "no valid time")
    return assign(dated, chronological_split(dated, val_frac, test_frac, "_day"), "_day").drop("_day")


def stratum_folds(rows: DataFrame, k: int, label: str, key: str, eval_strata: tuple[str, ...], stratum: str = "stratum", seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1 to rows of evaluation strata (or of none), null to those that only ever train.

    Enriched strata don't keep the classes' shares, so nothing is measured on them. A missing column, an
    empty pool or a class with fewer than k rows raises.
    """
    require_columns(rows, stratum, label)
    own = rows.withColumn("_use", F.when(F.col(stratum).isNull() | F.col(stratum).isin(*eval_strata), "eval").otherwise("train"))
    sizes = {r[label]: r["count"] for r in own.where("_use = 'eval'").groupBy(label).count().collect()}
    if not sizes:
        raise ValueError(f"no row belongs to {eval_strata}")
    if len(sizes) < 3 or min(sizes.values()) < k:
        raise ValueError(f"each of three classes needs {k} rows: {sizes}")
    return stratified_folds(own, k, label, key, seed, "_use").drop("_use")


def inner_validation(rows: DataFrame, fold: int, label: str, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split for one outer fold: its rows test, a stratified share of all others validates, drawn only
    from rows that have a fold themselves, so that it keeps the classes' shares; the rest trains."""
    outer = rows.withColumn("_test", F.coalesce(F.col("fold") == fold, F.lit(False)))
    counts = outer.where("not _test").agg(F.ceil(F.count(F.lit(1)) * share).alias("want"), F.count("fold").alias("pool")).first()
    if counts["want"] >= counts["pool"]:
        raise ValueError("the pool is too small for a validation part")
    pool = (~F.col("_test")) & F.col("fold").isNotNull()
    ranked = numbered_within(outer.withColumn("_pool", pool), by_hash(seed, key, "inner"), "_r", F.col("_pool"), F.col(label))
    # of each class the first rows, as many as its share of the pool
    cuts = ranked.groupBy("_pool", F.col(label).alias("_label")).agg(F.bround(F.count(F.lit(1)) * (counts["want"] / counts["pool"]), 0).alias("_cut")).withColumnRenamed("_pool", "_of")
    ranked = ranked.join(F.broadcast(cuts), (F.col("_pool") == F.col("_of")) & F.col(label).eqNullSafe(F.col("_label")))
    split = F.when(F.col("_test"), "test").when(F.col("_pool") & (F.col("_r") <= F.col("_cut")), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_test", "_pool", "_r", "_of", "_label", "_cut")


def stratified_split(rows: DataFrame, label: str, key: str, val_frac: float, test_frac: float, seed: int = 42) -> DataFrame:
    """Random split within each label, at least one row of validation and test each."""
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(*[F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * f, 0).cast("int")).alias(n) for f, n in ((test_frac, "_test"), (val_frac, "_val"))])
    placed = numbered_within(rows, by_hash(seed, key), "_r", F.col(label)).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    split = F.when(F.col("_r") <= F.col("_test"), "test").when(F.col("_r") <= F.col("_test") + F.col("_val"), "val").otherwise("train")
    return placed.withColumn("split", split).drop("_r", "_label", "_test", "_val")
