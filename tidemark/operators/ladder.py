"""The classical arms of the ladder: one fit for each window on its training rows only, scored on the same test rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import panel as panels
from tidemark.operators import splits
from tidemark.operators.evaluation import class_id
from tidemark.schemas import CLASSES
from tidemark.sources.staging import staged


def window_rows(panel: DataFrame, windows: DataFrame, window: int, features: list[str], length: int) -> DataFrame:
    """Sequences of one window, scaled and labelled with what its training rows know."""
    dates = windows.where(F.col("window") == window).select("date", "split")
    train = splits.assign(panel, dates).where("split = 'train'")
    own = panels.scaled(panel, panels.fit_scaler(train, features), features)
    own = panels.label_panel(own, panels.fit_thresholds(train))
    return splits.assign(panels.sequences(own, features, length), dates)


def fit_predict(rows: DataFrame, arm: str, seed: int = 42) -> DataFrame:
    """Adds y_pred and class probabilities to the test rows. ``logreg`` sees the last step of a sequence,
    ``mlp`` all of it."""
    steps = F.element_at("sequence", -1) if arm == "logreg" else F.flatten("sequence")
    data = rows.select("*", array_to_vector(steps).alias("features"), class_id("target_label").cast("double").alias("label"))
    train = staged(data.where("split = 'train'").select("features", "label"), "ladder-train")
    n = train.count()
    if arm == "logreg":
        model = LogisticRegression(family="multinomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000).fit(train)
    elif arm == "mlp":
        width = len(train.first()["features"])
        model = MultilayerPerceptronClassifier(layers=[width, 16, 3], seed=seed, maxIter=60).fit(train)
    else:
        raise ValueError(f"unknown arm {arm!r}")
    found = model.transform(data.where("split = 'test'")).withColumn("_p", vector_to_array("probability"))
    known = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.coalesce(F.try_element_at("_p", k.cast("int")), F.lit(0.0)))
    named = found.withColumn("_p", known).withColumns({f"prob_{c.lower()}": F.col("_p")[k] for k, c in enumerate(CLASSES)})
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return named.withColumn("y_pred", F.element_at(F.array(*map(F.lit, CLASSES)), best)).withColumnRenamed("target_label", "y_true").drop("_p", "features", "label", "rawPrediction", "probability", "prediction")


def only(places: list[int]):
    """A function that keeps some features of a step."""
    return lambda step: F.array(*[step[k] for k in places])


def run_ladder(panel: DataFrame, features: dict[str, list[str]], arms: tuple[str, ...], n_windows: int, test_size: int, val_size: int, length: int = 5) -> DataFrame:
    """Predictions of every arm on the test rows of every window; rows of a window are the same for all arms."""
    windows, out = splits.walk_forward(panel, n_windows, test_size, val_size), None
    every = sorted({c for columns in features.values() for c in columns})
    for window in range(n_windows):
        rows = window_rows(panel, windows, window, every, length)
        for name, columns in features.items():
            own = rows.withColumn("sequence", F.transform("sequence", only([every.index(c) for c in columns])))
            for arm in arms:
                made = fit_predict(own, arm).select(F.lit(window).alias("window"), F.lit(f"{arm}_{name}").alias("arm"), F.lit(42).alias("seed"), "ticker", "observation_date", "target_date", "y_true", "y_pred", "has_news", *[f"prob_{c.lower()}" for c in CLASSES])
                out = made if out is None else out.unionByName(made)
    return out
