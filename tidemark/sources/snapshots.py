"""Tables as numbered snapshots: readers never find nothing, and an upsert writes only the buckets that it touches.

A table's folder holds data folders, which are never changed once written, and one small manifest for each
snapshot: which data folder each bucket of keys is in. The greatest manifest is the table. A change writes its
data first and commits with one rename of a finished manifest to the next number, which doesn't exist before;
a crash at any point leaves the snapshot before, and of two writers the second fails and can try again on what
the first has made. A reader holds on to the snapshot that it began with until ``expire`` takes it away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.schemas import refuse
from tidemark.sources.files import file_system
from tidemark.sources.staging import staged

MANIFESTS, DATA = "snapshots", "data"
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the snapshot that this one was about to make."""


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The snapshots that there are, in order."""
    system, place = file_system(spark, f"{path}/{MANIFESTS}")
    if not system.exists(place):
        return []
    names = (f.getPath().getName() for f in system.listStatus(place))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    known = numbers(spark, path)
    if not known:
        raise FileNotFoundError(path)
    number = known[-1] if number is None else number
    if number not in known:
        raise KeyError(f"no snapshot {number}")
    return json.loads(spark.read.text(f"{path}/{MANIFESTS}/{number:010}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, made: dict) -> int:
    """Writes the manifest beside its place and renames it to it: the only step that readers see."""
    system, target = file_system(spark, f"{path}/{MANIFESTS}/{made['snapshot']:010}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}.tmp")
    out = system.create(draft, False)
    try:
        out.write(bytearray(json.dumps(made).encode()))
        out.hsync()
    finally:
        out.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise Conflict(f"snapshot {made['snapshot']} of {path} exists")
    return made["snapshot"]


def bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def write_data(rows: DataFrame, path: str, bucket_of: list[str], buckets: int) -> dict[str, str]:
    """bucket -> folder, of rows written into a data folder of their own."""
    spark, folder = rows.sparkSession, f"{DATA}/{uuid.uuid4().hex}"
    bucketed(rows, bucket_of, buckets).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    system, place = file_system(spark, f"{path}/{folder}")
    names = [f.getPath().getName() for f in system.listStatus(place)]
    return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose keys are whole and occur once; anything else raises."""
    refuse(rows.where(F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)) == 1).select(*key), "a key is null")
    refuse(rows.groupBy(*key).count().where("count > 1").select(*key), "a key is repeated")
    return rows


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of a snapshot, the latest if none is named."""
    found = manifest(spark, path, number)
    schema, folders = StructType.fromJson(found["schema"]), sorted(set(found["buckets"].values()))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def replace(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> int:
    """Makes a snapshot of ``rows`` alone; the rows may come from the table itself. Returns its number."""
    spark = rows.sparkSession
    number = (numbers(spark, path) or [0])[-1] + 1
    held = write_data(unique(rows, key), path, key, buckets)
    return commit(spark, path, {"snapshot": number, "key": key, "bucket_count": buckets, "schema": rows.schema.jsonValue(), "buckets": held})


def upsert(rows: DataFrame, path: str) -> int:
    """Makes a snapshot in which ``rows`` take the place of those with their keys, or join them. Returns its number.

    Only the buckets of those keys are read and written; what another column set is refused.
    """
    spark = rows.sparkSession
    before = manifest(spark, path)
    key, buckets, schema = before["key"], before["bucket_count"], StructType.fromJson(before["schema"])
    if [(f.name, f.dataType) for f in rows.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
        raise ValueError(f"columns differ: {rows.schema.simpleString()} and {schema.simpleString()}")
    # buckets are few: their number is the table's own setting
    touched = [str(r[0]) for r in bucketed(unique(rows, key), key, buckets).select("_bucket").distinct().collect()]
    old = [before["buckets"][b] for b in touched if b in before["buckets"]]
    merged = rows
    if old:
        stored = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in old])
        merged = stored.join(rows.select(*key), key, "left_anti").select(rows.columns).unionByName(rows)
    held = before["buckets"] | write_data(merged, path, key, buckets)
    return commit(spark, path, before | {"snapshot": before["snapshot"] + 1, "buckets": held})


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Takes away all but the last ``keep`` snapshots and the data that only they have; returns the data's folders.

    Data folders of a writer that is at work, or has crashed, belong to no snapshot: those stay until a
    snapshot that is younger than them is expired by a later call.
    """
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    known = numbers(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    used = {f for n in kept for f in manifest(spark, path, n)["buckets"].values()}
    dropped = {f for n in gone for f in manifest(spark, path, n)["buckets"].values()} - used
    for n in gone:
        system, place = file_system(spark, f"{path}/{MANIFESTS}/{n:010}.json")
        system.delete(place, False)
    for folder in sorted(dropped):
        system, place = file_system(spark, f"{path}/{folder}")
        system.delete(place, True)
    return sorted(dropped)


# --- the article store ------------------------------------------------------


def stored_articles(parsed: DataFrame) -> DataFrame:
    """Rows of the article store from parsed pages (url, article_id, published_at, title, body); a page without a time is marked."""
    return parsed.select("url", "article_id", "published_at", "title", "body", F.col("published_at").isNull().alias("parse_failed"))


def upsert_articles(parsed: DataFrame, path: str, flush: int = 100_000) -> list[int]:
    """Stores parsed pages, a snapshot for about every ``flush`` of them, so that a crash loses one flush at most.

    Flushes go by a digest of the url. A page that was parsed before is replaced; what it said before stays
    in earlier snapshots until they expire.
    """
    spark, rows = parsed.sparkSession, staged(stored_articles(parsed), "parsed")
    n = rows.count()
    if not numbers(spark, path):
        replace(rows.where("false"), path, ["url"])
    parts = -(-n // flush)
    deal = F.pmod(F.xxhash64(F.lit("flush"), "url"), F.lit(max(1, parts)))
    return [upsert(rows.where(deal == k), path) for k in range(parts)]
