"""Readers and writers of stored files: prices, news, labels, run folders, and writes that replace a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null
from tidemark.operators.curation import link_join, refuse_preliminary
from tidemark.schemas import require_columns

#: The file's own name is what a table without the column belongs to: <name>.parquet, a file or a folder.
NAMED_FILE = r"/([^/]+)\.parquet(?:/|$)"
#: Dated forecasts: <arm>/predictions_<date>.parquet.
DATED_FILE = r"/([^/]+)/predictions_(\d{4}-\d{2}-\d{2})\.parquet(?:/|$)"


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def require_path(spark: SparkSession, path: str) -> str:
    system, place = file_system(spark, path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    return path


def read_prices(spark: SparkSession, folder: str) -> DataFrame:
    """All price tables of a folder as one; a table without a ticker column gets that of its name."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{require_path(spark, folder)}/*.parquet").withColumn("_of", F.regexp_extract(F.col("_metadata.file_path"), NAMED_FILE, 1))
    known = F.col("ticker") if "ticker" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("ticker", F.coalesce(known, "_of")).drop("_of")


def read_news(spark: SparkSession, listings: str, articles: str, order: str = "published_at") -> DataFrame:
    """Stored links with their stored articles; raises if either is missing."""
    links, contents = (spark.read.parquet(require_path(spark, p)) for p in (listings, articles))
    return link_join(links, contents.withColumn("_order", F.col(order)), "_order")


def read_labels(spark: SparkSession, path: str, allow_preliminary: bool = False) -> DataFrame:
    """A label file, CSV or Parquet by its suffix, trimmed; rows without a label or any text go."""
    require_path(spark, path)
    if path.endswith(".csv"):
        rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    elif path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    require_columns(rows, "label")
    texts = [c for c in ("text", "title", "body", "body_preview") if c in rows.columns]
    if not texts:
        raise ValueError("no text column")
    trimmed = rows.withColumns({c: blank_to_null(F.trim(F.col(c).cast("string"))) for c in (*texts, "label")})
    return refuse_preliminary(trimmed.where(F.col("label").isNotNull() & F.coalesce(*texts).isNotNull()), allow_preliminary)


def folders_with(spark: SparkSession, root: str, marker: str) -> list[str]:
    """Names of the folders under ``root`` that hold ``marker``, in order: runs, or arms that are live."""
    system, place = file_system(spark, f"{root}/*/{marker}")
    return sorted({f.getPath().getParent().getName() for f in system.globStatus(place) or ()})


def run_folder(spark: SparkSession, root: str, name: str, marker: str = "forecast_results.json") -> str:
    """The folder of a run that was discovered; any other name raises, whatever path it would make."""
    if name not in folders_with(spark, root, marker):
        raise KeyError(name)
    return f"{root}/{name}"


def dated_identity(path: Column) -> list[Column]:
    """(arm, observation_date) of a dated forecast's path; null for other files."""
    arm, day = (blank_to_null(F.regexp_extract(path, DATED_FILE, k)) for k in (1, 2))
    return [arm.alias("arm"), F.try_to_date(day, "yyyy-MM-dd").alias("observation_date")]


def replace(rows: DataFrame, path: str) -> None:
    """Writes a whole table beside ``path`` and then takes its place.

    The rows may come from the table that is replaced. Readers never see half a table, but between the two
    renames there is none at the path, and a crash just then leaves the old one under ``<path>.old-...``:
    a table that is read all the time belongs into ``snapshots``.
    """
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    system, place = file_system(spark, path)
    fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{mark}") for kind in ("new", "old"))
    rows.write.parquet(f"{path}.new-{mark}")
    if system.exists(place) and not system.rename(place, old):
        raise OSError(f"could not put {path} aside")
    if not system.rename(fresh, place):
        raise OSError(f"could not replace {path}")
    system.delete(old, True)


def synthetic_prices(spark: SparkSession, n: int, ticker: str = "SYN", start: str = "2020-01-01") -> DataFrame:
    """Deterministic daily bars on ``n`` weekdays, for smoke tests."""
    day = spark.range(n).select("id", F.date_add(F.lit(start).cast("date"), (F.col("id") + 2 * F.expr("(id + weekday(date'" + start + "')) div 5")).cast("int")).alias("session_date"))
    close = 100 + F.col("id") * 0.05 + 5 * F.sin(F.col("id") / 7.0)
    return day.select(
        F.lit(ticker).alias("ticker"),
        "session_date",
        (close - 0.5).alias("open"),
        (close + 1.0).alias("high"),
        (close - 1.0).alias("low"),
        close.alias("close"),
        (1000 + F.col("id") % 17 * 10).cast("double").alias("volume"),
    )
