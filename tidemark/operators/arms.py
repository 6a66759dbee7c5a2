"""An arm in service: fitted once on all dates, frozen with its thresholds and scaler, and read back to predict."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.metrics import from_confusion
from tidemark.operators import evaluation, splits
from tidemark.operators import panel as panels
from tidemark.operators.eventlog import append
from tidemark.operators.serving import PROBABILITIES, issue
from tidemark.schemas import CLASSES, require_columns
from tidemark.sources.files import file_system, replace
from tidemark.sources.staging import staged

#: Strengths of the penalty that the validation dates choose from, in units of one over the training rows.
PENALTIES = (0.1, 1.0, 10.0)


def training_rows(panel: DataFrame, features: list[str], thresholds: DataFrame, scaler: DataFrame, length: int) -> DataFrame:
    own = panels.label_panel(panels.scaled(panel, scaler, features), thresholds)
    rows = panels.sequences(own, features, length)
    return rows.select("target_date", "ticker", "observation_date", array_to_vector(F.element_at("sequence", -1)).alias("features"), evaluation.class_id("target_label").cast("double").alias("label"), F.col("target_label").alias("y_true"))


def probabilities(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Rows with a probability for each of the three classes, 0 for one that wasn't in training, and the first greatest."""
    found = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    named = found.withColumns({c: F.coalesce(F.try_element_at("_p", F.lit(k + 1)), F.lit(0.0)) for k, c in enumerate(PROBABILITIES)})
    best = F.array_position(F.array(*PROBABILITIES), F.greatest(*PROBABILITIES)).cast("int")
    return named.withColumn("y_pred", F.element_at(F.array(*map(F.lit, CLASSES)), best)).drop("_p", "features", "rawPrediction", "probability", "prediction")


def fit(train: DataFrame, penalty: float, n: int) -> LogisticRegressionModel:
    return LogisticRegression(family="multinomial", regParam=penalty / n, elasticNetParam=0.0, standardization=False, maxIter=2000).fit(train)


def choose(rows: DataFrame, dates: DataFrame) -> tuple[LogisticRegressionModel, float, float]:
    """The model whose macro F1 on the validation dates is best, fitted on the training dates; the weaker penalty on a tie."""
    split = staged(splits.assign(rows, dates), "arm-rows")
    train, val = (split.where(F.col("split") == s) for s in ("train", "val"))
    n, best = train.count(), None
    for penalty in PENALTIES:
        model = fit(train, penalty, n)
        scored = evaluation.confusion(probabilities(model, val)).select(from_confusion()["macro_f1"].alias("f1")).first()["f1"]
        if best is None or scored > best[2]:
            best = model, penalty, scored
    return best


def refit(panel: DataFrame, features: list[str], val_size: int, path: str, length: int = 5, arm: str = "logreg_price") -> dict:
    """Fits thresholds, scaler and model on the training dates and freezes them at ``path``; returns the manifest."""
    require_columns(panel, "ticker", "observation_date", "target_date", "target_return", *features)
    spark, dates = panel.sparkSession, splits.final_split(panel, val_size)
    train = splits.assign(panel, dates).where("split = 'train'")
    thresholds, scaler = staged(panels.fit_thresholds(train), "thresholds"), staged(panels.fit_scaler(train, features), "scaler")
    model, penalty, f1 = choose(training_rows(panel, features, thresholds, scaler, length), dates)
    bounds = thresholds.first()
    manifest = {"arm": arm, "features": features, "length": length, "val_size": val_size, "penalty": penalty, "val_macro_f1": f1, "thresholds": [bounds["q_low"], bounds["q_high"]]}
    replace(scaler, f"{path}/scaler")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame, LogisticRegressionModel]:
    system, place = file_system(spark, f"{path}/manifest.json")
    if not system.exists(place):
        raise FileNotFoundError(path)
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    return manifest, spark.read.parquet(f"{path}/scaler"), LogisticRegressionModel.load(f"{path}/model")


def predict_latest(panel: DataFrame, path: str) -> DataFrame:
    """A forecast for the latest session of each ticker, under the frozen thresholds, stamped with them."""
    manifest, scaler, model = load(panel.sparkSession, path)
    features, (low, high) = manifest["features"], manifest["thresholds"]
    last = panels.latest_sequences(panels.scaled(panel, scaler, features), features, manifest["length"])
    rows = last.select("ticker", "observation_date", "has_news", array_to_vector(F.element_at("sequence", -1)).alias("features"))
    return probabilities(model, rows).withColumns({"arm": F.lit(manifest["arm"]), "threshold_low": F.lit(low), "threshold_high": F.lit(high)})


def daily_job(panel: DataFrame, model: str, live: str, log: DataFrame) -> tuple[str, DataFrame]:
    """One day: predict, issue under the date and as the latest, and what the event log gets for it.

    Issuing again is fine while nothing changed; other rows under an issued date raise.
    """
    made = staged(predict_latest(panel, model), "forecast").withColumn("issued_at", F.current_timestamp().cast("timestamp_ntz"))
    arm, day = made.agg(F.first("arm"), F.max("observation_date")).first()
    path = f"{live}/{arm}/predictions_{day}.parquet"
    outcome = issue(made, path)
    replace(made.sparkSession.read.parquet(path), f"{live}/{arm}/latest.parquet")
    event = made.sparkSession.createDataFrame([(f"{arm}/{day}", "signal.issued", str(day))], "key string, type string, day string")
    return outcome, append(log, event, ["day"])
