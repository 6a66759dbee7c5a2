"""The text classifier: hashed terms and a multinomial logistic regression, cross-validated over folds and over a grid of inputs.

Each fold's rows are scored by a model that never saw them; the penalty is chosen on validation rows that are
drawn from the rest. Rows of enriched strata only ever train. Fits are Spark jobs over all rows, and several run
at once, so that a grid keeps the cluster busy however small one fit is; each iteration shuffles a gradient for each
part of the rows, so a fit has no more parts than their size asks for. What a run leaves is a table of
results and, if wanted, a model for each fold; a run that fails leaves no models.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.metrics import CELLS, confusion_counts, from_confusion
from tidemark.functions.text import truncated
from tidemark.operators import curation, splits
from tidemark.operators.evaluation import METRICS
from tidemark.schemas import refuse
from tidemark.sources.files import file_system
from tidemark.sources.staging import clearing, delete, staged

VARIANTS = ("title", "context", "title_context")
TRUNCATIONS = ("head", "tail", "head_tail")
LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
#: Strengths of the penalty that validation rows choose from; this library's own choice.
PENALTIES = (0.003, 0.03)
TERMS, TOKENS, PARALLEL = 1 << 13, 256, 4
#: Tokens of training rows that a part of a fit holds at most, 12 bytes each.
PART_TOKENS = 1 << 24


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def known(rows: DataFrame, allow_preliminary: bool) -> DataFrame:
    """Rows with reviewed and valid labels; others raise."""
    return curation.normalize_labels(curation.refuse_preliminary(rows, allow_preliminary))


def check(variant: str, *hows: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"unknown input {variant!r}")
    for how in hows:
        if how not in TRUNCATIONS:
            raise ValueError(f"unknown truncation {how!r}")


def features(labelled: DataFrame, variant: str, columns: dict[str, str], key: str, size: int, terms: int) -> DataFrame:
    """Rows with the features of one input under each truncation, one row for each text; made once.

    Texts are truncated and hashed first and told apart by their digests, so that no whole text is shuffled.
    """
    made = curation.with_input(labelled, variant).withColumns({"_text": F.sha2("input_text", 256), "_tokens": tokens(F.col("input_text"))})
    made = made.withColumns({f"_{how}": truncated(F.col("_tokens"), size, how) for how in columns})
    for how, name in columns.items():
        made = HashingTF(inputCol=f"_{how}", outputCol=name, numFeatures=terms).transform(made)
    kept = [c for c in (key, "label_id", *columns.values(), "fold", "stratum") if c in made.columns]
    found = curation.keep_first(made.select(*kept, "_text"), ["_text"], key)
    # stored with a number, by which what is drawn over keys finds its row even where a key isn't unique
    return staged(found.select(*kept, F.monotonically_increasing_id().alias("_row")), "text-features")


def prepared(rows: DataFrame, variant: str, how: str, key: str, size: int = TOKENS, terms: int = TERMS, allow_preliminary: bool = False) -> DataFrame:
    """Labelled rows with the features of one input: reviewed labels, one row for each text, truncated and hashed; made once."""
    check(variant, how)
    return features(known(rows, allow_preliminary), variant, {how: "features"}, key, size, terms)


def folded(rows: DataFrame, folds: int, key: str, seed: int, eval_strata: tuple[str, ...] | None) -> DataFrame:
    """Rows with their fold: the given column, or drawn in turn within each class (and only in strata that keep the classes' shares)."""
    if "fold" in rows.columns:
        return rows
    if eval_strata:
        return splits.stratum_folds(rows, folds, "label_id", key, eval_strata, seed=seed)
    return splits.stratified_folds(rows, folds, "label_id", key, seed)


def weighted(train: DataFrame, balanced: bool) -> DataFrame:
    """Rows with ``weight``: the rarer its class, the more a row weighs; a class without rows raises."""
    if not balanced:
        return train.withColumn("weight", F.lit(1.0))
    counts = {r[0]: r[1] for r in train.groupBy("label_id").count().collect()}
    if missing := [LABELS[k] for k in range(len(LABELS)) if k not in counts]:
        raise ValueError(f"no rows of {missing}")
    total = sum(counts.values())
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (len(LABELS) * n))])
    return train.withColumn("weight", shares[F.col("label_id")])


def scored(model: LogisticRegressionModel, rows: DataFrame) -> dict:
    """The metrics of a model's first greatest class, with the nine counts."""
    p = F.transform(F.sequence(F.lit(1), F.lit(len(LABELS))), lambda k: F.coalesce(F.try_element_at("_p", k.cast("int")), F.lit(0.0)))
    names = F.array(*map(F.lit, LABELS))
    found = model.transform(rows).withColumn("_p", vector_to_array("probability")).withColumn("_p", p)
    named = found.select(F.element_at(names, F.col("label_id") + 1).alias("y_true"), F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int")).alias("y_pred"))
    counted = named.agg(*confusion_counts(classes=LABELS))
    return counted.select(*CELLS, *[v.alias(k) for k, v in from_confusion().items()]).first().asDict()


def fit(train: DataFrame, penalty: float) -> LogisticRegressionModel:
    return LogisticRegression(family="multinomial", labelCol="label", weightCol="weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=100).fit(train)


def at_once(spark: SparkSession, work: Iterable[Callable[[], object]], parallel: int) -> list:
    """What each piece of work gives, several running at a time; the first failure raises once the rest has ended."""
    with ThreadPoolExecutor(parallel) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(w)) for w in work]
    return [r.result() for r in running]


def remove(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def with_splits(rows: DataFrame, folds: int, key: str, seed: int, eval_strata: tuple[str, ...] | None) -> DataFrame:
    """Rows with ``split_<fold>`` for each fold, made once: splits are drawn over keys and labels alone and meet the features in one join."""
    names = [c for c in ("fold", "stratum") if c in rows.columns]
    own = staged(folded(rows.select("_row", key, "label_id", *names), folds, key, seed, eval_strata), "cv-folds")
    numbers = [r[0] for r in own.where("fold is not null").select("fold").distinct().orderBy("fold").collect()]
    refuse(own.where((F.col("fold") < 0) | (F.col("fold") >= folds)), f"folds must be 0 to {folds - 1}")
    if len(numbers) != folds:
        raise ValueError(f"{folds} folds are wanted, the rows have {numbers}")
    every = own.select("_row", key, "label_id", "fold")
    hashed = [c for c in rows.columns if c.startswith("features")]
    for f in numbers:
        every = staged(splits.inner_validation(every, f, "label_id", key, seed=seed + f + 1).withColumnRenamed("split", f"split_{f}"), "cv-splits")
    return staged(rows.select("_row", *hashed).join(every, "_row"), "cv-rows")


def parts(n_rows: int, size: int) -> int:
    """How many parts a fit on so many rows of at most ``size`` tokens has."""
    return max(1, -(-n_rows * size // PART_TOKENS))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that are over: it does when the driver collects what refers to them, which by itself may be long after."""
    spark.sparkContext._jvm.java.lang.System.gc()


def run_fold(rows: DataFrame, fold: int, penalties: tuple[float, ...], balanced: bool, path: str | None, size: int = TOKENS) -> dict:
    """Trains without a fold, chooses the penalty on validation rows, and scores the fold."""
    split = rows.withColumn("split", F.col(f"split_{fold}"))
    sizes = {r[0]: r[1] for r in split.groupBy("split").count().collect()}
    train, val, test = (split.where(F.col("split") == s).withColumn("label", F.col("label_id").cast("double")) for s in ("train", "val", "test"))
    train, best = weighted(train, balanced).coalesce(parts(sizes["train"], size)), None
    for penalty in penalties:
        model = fit(train, penalty)
        f1 = scored(model, val)["macro_f1"]
        if best is None or f1 > best[2]:
            best = model, penalty, f1
    if path:
        best[0].write().overwrite().save(f"{path}/fold-{fold + 1:02}/model")
    result = scored(best[0], test)
    release(rows.sparkSession)
    return {"fold": fold + 1, "train_size": sizes["train"], "validation_size": sizes["val"], "holdout_size": sizes["test"], "penalty": best[1], "val_macro_f1": best[2], **result}


FOLD_SCHEMA = "fold int, train_size long, validation_size long, holdout_size long, penalty double, val_macro_f1 double, " + ", ".join(f"{c} long" for c in CELLS) + ", macro_f1 double, balanced_accuracy double, accuracy double"


def cross_validated(
    rows: DataFrame, variant: str = "title", how: str = "head", folds: int = 5, key: str = "doc_id", seed: int = 42, path: str | None = None, save_models: bool = False,
    eval_strata: tuple[str, ...] | None = None, balanced: bool = True, penalties: tuple[float, ...] = PENALTIES, size: int = TOKENS, terms: int = TERMS, parallel: int = PARALLEL, allow_preliminary: bool = False,
) -> DataFrame:
    """A row for each fold: sizes, the chosen penalty, counts and metrics of its held-out rows.

    With ``path`` the table and a record of the settings are written there, and with ``save_models`` each
    fold's model. If anything fails, the models that were written go and the failure is raised.
    """
    check(variant, how)
    with or_no_models(rows.sparkSession, path, folds), kept_rows(rows.sparkSession, lambda: with_splits(prepared(rows, variant, how, key, size, terms, allow_preliminary), folds, key, seed, eval_strata)) as own:
        return validated(own, variant, how, folds, seed, path, save_models, eval_strata, balanced, penalties, size, terms, parallel)


@contextmanager
def or_no_models(spark: SparkSession, path: str | None, folds: int) -> Iterator[None]:
    """Deletes the folds' models under ``path`` if the block fails."""
    try:
        yield
    except BaseException:
        if path:
            for fold in range(folds):
                remove(spark, f"{path}/fold-{fold + 1:02}")
        raise


@contextmanager
def kept_rows(spark: SparkSession, make: Callable[[], DataFrame]) -> Iterator[DataFrame]:
    """The stored table that ``make`` gives: what was stored on its way goes at once, the table when the block ends."""
    with clearing(spark) as made:
        own = make()
        made.remove(own.staged_at)
    try:
        yield own
    finally:
        delete(spark, own.staged_at)


def validated(own: DataFrame, variant: str, how: str, folds: int, seed: int, path: str | None, save_models: bool, eval_strata: tuple[str, ...] | None, balanced: bool, penalties: tuple[float, ...], size: int, terms: int, parallel: int) -> DataFrame:
    """``cross_validated`` on rows that have their features and splits."""
    spark = own.sparkSession
    kept = path if path and save_models else None
    found = at_once(spark, [lambda f=f: run_fold(own, f, penalties, balanced, kept, size) for f in range(folds)], parallel)
    names = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
    result = spark.createDataFrame([tuple(r[n] for n in names) for r in found], FOLD_SCHEMA)
    if path:
        result.coalesce(1).write.mode("overwrite").parquet(f"{path}/cv_results")
        settings = {"input_variant": variant, "truncation_strategy": how, "folds": folds, "seed": seed, "eval_strata": list(eval_strata) if eval_strata else None, "balanced": balanced, "terms": terms, "tokens": size, "data_size": own.count()}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cv_results.json")
    return result


def aggregated(folds: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation of each metric over folds (0 for a single one), and the rows that were held out."""
    spread = [f.alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg(m)), ("std", F.coalesce(F.stddev_samp(m), F.lit(0.0))))]
    return folds.groupBy(*by).agg(F.sum("holdout_size").alias("data_size"), *spread)


def ablation(
    rows: DataFrame, path: str | None = None, variants: tuple[str, ...] = VARIANTS, truncations: tuple[str, ...] = TRUNCATIONS, folds: int = 5, key: str = "doc_id", seed: int = 42,
    eval_strata: tuple[str, ...] | None = None, balanced: bool = True, penalties: tuple[float, ...] = PENALTIES, size: int = TOKENS, terms: int = TERMS, parallel: int = PARALLEL, allow_preliminary: bool = False,
) -> DataFrame:
    """A row for each input and truncation, the best first: metrics, and no models are kept.

    Texts and splits of an input are the same under every truncation, so both are made once for each input.
    """
    spark = rows.sparkSession
    names = {how: f"features_{how}" for how in truncations}
    for variant in variants:
        check(variant, *truncations)
    labelled = known(rows, allow_preliminary)

    def one(own: DataFrame, variant: str, how: str) -> DataFrame:
        place = f"{path}/{variant}__{how}" if path else None
        cell = own.withColumnRenamed(names[how], "features")
        with or_no_models(spark, place, folds):
            found = validated(cell, variant, how, folds, seed, place, False, eval_strata, balanced, penalties, size, terms, parallel=1)
        return found.select(F.lit(variant).alias("input_variant"), F.lit(how).alias("truncation_strategy"), "*")

    with ExitStack() as open_tables:
        make = lambda v: with_splits(features(labelled, v, names, key, size, terms), folds, key, seed, eval_strata)
        made = at_once(spark, [lambda v=v: open_tables.enter_context(kept_rows(spark, lambda: make(v))) for v in variants], parallel)
        tables = dict(zip(variants, made, strict=True))
        found = at_once(spark, [lambda v=v, h=h: one(tables[v], v, h) for v in variants for h in truncations], parallel)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    summary = aggregated(out, "input_variant", "truncation_strategy").orderBy(F.desc("macro_f1_mean"), "input_variant", "truncation_strategy")
    if path:
        summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/ablation_summary")
    return summary
