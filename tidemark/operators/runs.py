"""Experiment records: artifacts, guards that pair two runs, the point-in-time verdict and the views over runs."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.operators import evaluation
from tidemark.operators.evaluation import METRICS
from tidemark.schemas import refuse, require_columns
from tidemark.sources.files import folders_with, replace, run_folder
from tidemark.sources.staging import staged

PAIRING = ["window", "seed", "ticker", "target_date", "y_true"]
#: Keys of older records and what they are called now (fixed values).
NEWS_KEYS = {"path": "source_path", "hash": "source_hash"}
EFFECT_KEYS = {"architecture_effect": "architecture_and_news_presence_volume_effect"}


def renamed_keys(entries: Column, names: dict[str, str]) -> Column:
    """A map whose old keys got their new names; where both occur, the new one's value stays."""
    kept = F.map_filter(entries, lambda k, _: ~k.isin(*names))
    old = F.map_filter(entries, lambda k, _: k.isin(*names))
    new = F.transform_keys(old, lambda k, _: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), k))
    return F.map_concat(kept, F.map_filter(new, lambda k, _: ~F.map_contains_key(kept, k)))


def news_provenance(entries: Column) -> Column:
    """The news part of a record under its present keys; a known source without a mode was real news."""
    own = renamed_keys(entries, NEWS_KEYS)
    real = F.try_element_at(own, F.lit("mode")).isNull() & F.try_element_at(own, F.lit("source_path")).isNotNull()
    return F.when(real, F.map_concat(F.map_filter(own, lambda k, _: k != "mode"), F.create_map(F.lit("mode"), F.lit("real")))).otherwise(own)


def require_paired(real: DataFrame, control: DataFrame, arm: str, same: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of one arm in both runs; raises unless they are about the same test rows, once each, and
    equal in the columns of ``same``."""
    own = []
    for name, rows in (("real", real), ("control", control)):
        require_columns(rows, "arm", *PAIRING, *same)
        found = rows.where(F.col("arm") == arm)
        if not found.limit(1).count():
            raise ValueError(f"the {name} run has no rows of {arm!r}")
        own.append(found)
    evaluation.require_same_keys(own[0], own[1], PAIRING)
    if same:
        pair = [*PAIRING, *same]
        a, b = (rows.select(*pair) for rows in own)
        refuse(a.exceptAll(b).unionByName(b.exceptAll(a)), f"the runs differ in {same} of {arm!r}")
    return own[0], own[1]


def require_same_settings(real: dict, control: dict, keys: tuple[str, ...]) -> None:
    """Two runs' settings (configuration, windows, hashes of prices and news, mode of the news) must agree in ``keys``."""
    if differing := [k for k in keys if real.get(k) != control.get(k)]:
        raise ValueError(f"the runs differ in {differing}")


def compare_runs(real: DataFrame, control: DataFrame, price: str, treated: str, samples: int, seed: int) -> DataFrame:
    """(metric, effect, mean, low, high, p_le_zero): what news are worth, with intervals over dates.

    The control ran on neutral news. Only if both price arms are one and the same, and the treated arms
    predicted the same rows, is the difference due to the news: anything else raises.
    """
    require_paired(real, control, price, ("y_pred", "has_news"))
    with_news, without = require_paired(real, control, treated)
    arms = with_news.withColumn("arm", F.lit("real")).unionByName(without.withColumn("arm", F.lit("neutral")), allowMissingColumns=True)
    arms = arms.unionByName(real.where(F.col("arm") == price).withColumn("arm", F.lit("price")), allowMissingColumns=True)
    effects = {"information_gain": ("real", "neutral"), "architecture": ("neutral", "price"), "naive": ("real", "price")}
    found = [evaluation.date_block_bootstrap(arms, a, b, samples, seed).withColumn("effect", F.lit(name)) for name, (a, b) in effects.items()]
    return reduce(lambda a, b: a.unionByName(b), found).select("metric", "effect", "mean", "low", "high", "p_le_zero")


def gain_report(real: DataFrame, control: DataFrame, price: str, treated: str, samples: int = 2000, seed: int = 7) -> DataFrame:
    """(metric, effect, window, value, window_low, window_high, date_low, date_high): what news are worth, in full.

    Rows with a window have its effect, averaged over seeds; those without have the mean over windows with
    its intervals from drawn windows and from drawn dates. Pairing is checked as in ``compare_runs``.
    """
    dates = compare_runs(real, control, price, treated, samples, seed)
    named = {"price": real.where(F.col("arm") == price), "real": real.where(F.col("arm") == treated), "neutral": control.where(F.col("arm") == treated)}
    arms = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("arm", F.lit(name)) for name, rows in named.items()])
    scores = staged(evaluation.scores(arms, "window", "arm", "seed"), "gain-scores")
    parts = []
    for effect, (a, b) in {"information_gain": ("real", "neutral"), "architecture": ("neutral", "price"), "naive": ("real", "price")}.items():
        for metric in METRICS:
            deltas = evaluation.paired_delta(scores, a, b, metric)
            ends = evaluation.window_bootstrap(deltas, samples, seed).select(F.lit(None).cast("int").alias("window"), F.col("mean").alias("value"), F.col("low").alias("window_low"), F.col("high").alias("window_high"))
            each = deltas.select(F.col("window").cast("int").alias("window"), F.col("delta").alias("value"))
            parts.append(each.unionByName(ends, allowMissingColumns=True).select(F.lit(metric).alias("metric"), F.lit(effect).alias("effect"), "window", "value", "window_low", "window_high"))
    whole = reduce(lambda x, y: x.unionByName(y), parts)
    own = dates.select(F.col("metric").alias("_m"), F.col("effect").alias("_e"), F.col("low").alias("date_low"), F.col("high").alias("date_high"))
    return whole.join(F.broadcast(own), (F.col("metric") == F.col("_m")) & (F.col("effect") == F.col("_e")) & F.col("window").isNull(), "left").drop("_m", "_e")


def ladder_table(scores: DataFrame, deltas: list[tuple[str, str]], samples: int, seed: int, metric: str = "macro_f1") -> DataFrame:
    """(arm, mean, std, n_runs, low, high): every arm, and a DELTA row with an interval for each pair."""
    rows = scores.groupBy("arm").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(F.lit(1)).alias("n_runs"))
    rows = rows.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    for treated, control in deltas:
        own = evaluation.paired_delta(scores, treated, control, metric)
        ends = evaluation.window_bootstrap(own, samples, seed)
        spread = own.agg(F.stddev_pop("delta").alias("std"), F.count(F.lit(1)).alias("n_runs"))
        row = ends.join(spread, F.lit(True)).select(F.lit(f"DELTA {treated}__minus__{control}").alias("arm"), "mean", "std", "n_runs", "low", "high")
        rows = rows.unionByName(row)
    return rows


def verdict(label_cutoff: Column, first_test_date: Column, manifest_sha256: Column, expected_sha256: Column) -> list[Column]:
    """(point_in_time, reason): whether the scorer learnt only from labels that the first test date allows."""
    reason = (
        F.when(manifest_sha256.isNull(), "manifest_missing")
        .when(expected_sha256.isNull(), "hash_missing")
        .when(manifest_sha256 != expected_sha256, "hash_mismatch")
        .when(label_cutoff.isNull(), "no_label_cutoff")
        .when(first_test_date.isNull(), "no_test_window")
        .when(label_cutoff > first_test_date, "cutoff_after_test_start")
        .otherwise("verified")
    )
    return [(F.coalesce(label_cutoff <= first_test_date, F.lit(False)) & (reason == "verified")).alias("point_in_time"), reason.alias("reason")]


def fold_summary(folds: DataFrame, *metrics: str) -> DataFrame:
    """One row: mean and sample deviation of each metric over the folds."""
    return folds.agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))], F.count(F.lit(1)).alias("folds"))


def client_windows(strata: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """(arm, window, rows and mean metric with and without news, their difference); rows add up over seeds."""
    of = lambda name, x: F.when(F.col("stratum") == name, F.col(x))
    out = strata.groupBy("arm", "window").agg(
        F.coalesce(F.sum(of("has_news", "n")), F.lit(0)).alias("n_news"),
        F.coalesce(F.sum(of("no_news", "n")), F.lit(0)).alias("n_no_news"),
        F.avg(of("has_news", metric)).alias("mean_news"),
        F.avg(of("no_news", metric)).alias("mean_no_news"),
    )
    return out.withColumn("delta", F.col("mean_news") - F.col("mean_no_news"))


def window_lines(gains: DataFrame) -> DataFrame:
    """(window, a column for each metric) of rows (metric, per_window array): the arrays, turned."""
    long = gains.select("metric", F.posexplode("per_window").alias("k", "value"))
    return long.groupBy(F.concat(F.lit("W"), F.col("k") + 1).alias("window")).pivot("metric", list(METRICS)).agg(F.first("value"))


def ordered_digest(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One digest of rows in their order, by a tree of them."""
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return digests.ordered(rows.withColumn("_line", line), order, "_line")


def article_coverage(articles: DataFrame) -> DataFrame:
    """How many stored articles there are, with a time, with a body and failed."""
    body = F.coalesce(F.length(F.trim("body")) > 0, F.lit(False))
    return articles.agg(F.count(F.lit(1)).alias("n_rows"), F.count("published_at").alias("with_time"), F.count_if(body).alias("with_body"), F.count_if("parse_failed").alias("failed"))


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as JSON text: dates in ISO form, nulls kept, and what is no number as null."""
    safe = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_run(path: str, record: DataFrame, tables: dict[str, DataFrame]) -> None:
    """A run's folder: the record (one row, as JSON), and predictions, metrics and strata as tables."""
    for name, rows in tables.items():
        replace(rows, f"{path}/{name}")
    json_rows(record).write.mode("overwrite").text(f"{path}/forecast_results.json")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(name, and what the record says of the panel, the target and the news) of every run under ``root``."""
    schema = "panel_rows long, config map<string,string>, provenance map<string,string>, news map<string,string>"
    found = None
    for name in folders_with(spark, root, "forecast_results.json"):
        lines = spark.read.text(f"{root}/{name}/forecast_results.json", wholetext=True)
        own = lines.select(F.lit(name).alias("name"), F.from_json("value", schema).alias("r")).select("name", "r.*")
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise FileNotFoundError(f"no run under {root}")
    news, config = news_provenance(F.coalesce("news", F.create_map().cast("map<string,string>"))), F.col("config")
    setting = lambda m, k, default=None: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default).cast("string"))
    return found.select("name", "panel_rows", setting(news, "mode").alias("mode"), setting(config, "target_mode", "raw").alias("target_mode"), setting(config, "horizon", "1").cast("int").alias("horizon"), setting(F.col("provenance"), "date_start").alias("date_start"), setting(F.col("provenance"), "date_end").alias("date_end"))


def run_table(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A table of a discovered run."""
    return spark.read.parquet(f"{run_folder(spark, root, name)}/{table}")


def warmup_steps(examples: int, batch: int, epochs: float, ratio: float) -> int:
    """The share ``ratio`` of all optimizer steps (rounded half to even), never more than there are."""
    if examples < 1 or batch < 1 or epochs <= 0 or not 0 <= ratio <= 1:
        raise ValueError("examples and batch must be positive, epochs above 0 and ratio within 0 and 1")
    steps = max(1, math.ceil(math.ceil(examples / batch) * epochs))
    return min(steps, round(steps * ratio))


def inference_settings(manifest: str | None, defaults: dict, **given) -> dict:
    """Settings for scoring: what is given, else what the model's manifest (JSON text) was trained with, else a default."""
    try:
        trained = json.loads(manifest or "{}").get("config") or {}
    except (json.JSONDecodeError, AttributeError):
        trained = {}
    return {k: given[k] if given.get(k) is not None else trained.get(k, default) for k, default in defaults.items()}


def require_reference(reference: dict, actual: dict, optional: tuple[str, ...] = ()) -> None:
    """A refit must repeat what cross-validation chose: every field of ``actual`` must be the reference's."""
    if bad := sorted(k for k, v in actual.items() if k not in optional and reference.get(k) != v):
        raise ValueError(f"the reference differs in {bad}")
    if not reference.get("fold_results") or not reference.get("aggregate"):
        raise ValueError("the reference has no folds or no aggregate")
