"""Exact dedup (operator 2): stateful streaming deduplication over disk-backed keyed state.

Documents arrive as a stream of slim records: the digest of the normalised text, its number of code
points, the stable identifier and a content locator (file and row, where the full bytes are). A
streaming aggregation keeps, for each digest and without expiry, the best arrival so far and the
number of arrivals, in RocksDB state stores on disk whose snapshots lie in the shared folder; later
streams over the same state folder continue where the last one ended. Digests that were hit more
than once are then checked on full bytes: the arrivals' texts and the text that the retained locator
opens, which may be of an earlier stream, must be one text. A digest that fails the check is taken
apart by its texts. DataFrame operations only.

Scale: arrivals are aggregated before the shuffle, so a text that makes up a third of all rows sends
one record for each task; the byte check aggregates in the same way; no text is shuffled except one
least and one greatest text for each task and repeated digest.

Defined results: null text equals empty text, and texts of white space only equal both; repeated rows
(same id, same text) are separate arrivals of which one is kept; of equal texts the one with most code
points, then the smallest id, then the last locator stays; a null id sorts after all others. An empty
table gives an empty result. Columns named like the results are replaced. With a ``state`` folder of
the caller's, documents of earlier streams take part through the arrival that the state retains.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: What normalising deletes; a fixed value.
BLANKS = r"[\x20\x09-\x0D]+"
#: Settings of the state stores: on disk, and no space set aside beforehand, as there is one for each partition.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
FILES_PER_BATCH = 1000
ARRIVAL = "_digest string, _points long, _id long, _file string, _row long"


def best() -> Column:
    """Of arrivals with one digest: most code points, then the smallest id, then the last locator."""
    return F.max(F.struct("_points", (-F.col("_id")).alias("_minus"), "_file", "_row")).alias("_best")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def absorb(spark: SparkSession, arrivals: str, state: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Streams all arrival files under ``arrivals`` that ``state`` hasn't seen into it."""
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    keyed = stream.groupBy("_digest").agg(best(), F.count(F.lit(1)).alias("_n"))
    with rocksdb(spark):
        query = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def held(spark: SparkSession, state: str) -> DataFrame:
    """What the state holds: digest, best arrival and number of arrivals."""
    value = spark.read.format("statestore").load(state)
    names = value.schema["value"].dataType.fieldNames()
    return value.select(
        F.col("key._digest").alias("_digest"),
        F.col(f"value.{names[0]}").alias("_best"),
        F.col(f"value.{names[1]}").alias("_n"),
    )


def texts_of(rows: DataFrame, text: str) -> DataFrame:
    """Locator, digest input and what is kept of each row."""
    return rows.select(F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_points"), normalised(F.col(text)).alias("_text"), "_id", "_file", "_row")


def retained_elsewhere(groups: DataFrame, rows: DataFrame, text: str) -> DataFrame | None:
    """The texts that retained locators of repeated digests open in files that aren't this stream's."""
    spark = rows.sparkSession
    kept = groups.where("_n > 1").select("_digest", "_best.*")
    # as many names as there are files at most, which the driver lists for every scan anyway
    here = {r[0] for r in rows.select("_file").distinct().collect()}
    there = sorted({r[0] for r in kept.select("_file").distinct().collect()} - here)
    if not there:
        return None
    wanted = kept.where(F.col("_file").isin(there)).select("_digest", (-F.col("_minus")).alias("_id"), "_file", "_row")
    found = spark.read.parquet(*there).select(F.col(text).alias("_in"), *common.locator()).join(wanted, ["_file", "_row"])
    return texts_of(found.select("_in", "_id", "_file", "_row", "_digest"), "_in").join(wanted.select("_file", "_row", "_digest"), ["_file", "_row"])


def decided(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The located documents, and for each of their rows what was decided, by locator."""
    spark = docs.sparkSession
    rows, (own_id, own_text) = common.located(docs, doc_id, text)
    keyed = texts_of(rows.withColumn("_id", F.col(own_id).cast("long")), own_text).withColumn("_digest", digest(F.col("_text")))
    root = state or common.scratch(spark, "dedup-state")
    arrivals = f"{root}/arrivals/{uuid.uuid4().hex}"
    keyed.select("_digest", "_points", "_id", "_file", "_row").write.parquet(arrivals)
    slim = spark.read.schema(ARRIVAL).parquet(arrivals)
    absorb(spark, f"{root}/arrivals/*", f"{root}/stores", files_per_batch)
    with rocksdb(spark):
        groups = common.staged(held(spark, f"{root}/stores"), "dedup-groups")

    hit = groups.where("_n > 1").select("_digest")
    texts = keyed.join(common.lookup_side(hit, hit.count()), "_digest", "left_semi")
    earlier = retained_elsewhere(groups, slim, text) if state else None
    if earlier is not None:
        earlier = common.staged(earlier.select(texts.columns), "dedup-earlier")
        texts = texts.unionByName(earlier)
    checked = texts.groupBy("_digest").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
    clashes = common.staged(checked.where("_least <> _most").select("_digest"), "dedup-clashes")
    n_clashes = clashes.count()

    shown = ["_digest", "_id", "_file", "_row", "_best", "_n"]
    made = slim.join(groups, "_digest").select(shown)
    if n_clashes:
        side = common.lookup_side(clashes, n_clashes)
        apart = texts.join(side, "_digest", "left_semi")
        grouped = apart.groupBy("_digest", "_text").agg(best(), F.count(F.lit(1)).alias("_n"))
        again = keyed.join(side, "_digest", "left_semi").join(grouped, ["_digest", "_text"])
        made = made.join(side, "_digest", "left_anti").unionByName(again.select(shown))
    return rows, made.select(
        "_file",
        "_row",
        F.col("_id").alias("doc_id"),
        (-F.col("_best._minus")).alias("keep_id"),
        F.col("_n").alias("group_size"),
        ((F.col("_file") == F.col("_best._file")) & (F.col("_row") == F.col("_best._row"))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: id, kept id, group size, kept or not, digest of the normalised text."""
    return decided(docs, **options)[1].drop("_file", "_row")


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows, made = decided(docs, **options)
    gone = common.staged(made.where(~F.col("kept")).select("_file", "_row"), "dedup-gone")
    left = rows.join(common.lookup_side(gone, gone.count()), ["_file", "_row"], "left_anti")
    return left.drop("_file", "_row").toDF(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.documents(spark, sf_dir))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {
    "op2_exact_dedup": r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept,
           text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """
}
