"""Queries over stored logs, ledgers and snapshots, which they write from the driver's tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.curation import keep_first, keep_last
from tidemark.plans.catalog import Catalog
from tidemark.plans.texts import ARTICLES, articles
from tidemark.sources import event_log, ledger, snapshots
from tidemark.sources.staging import shared_dir

CATALOG = Catalog()
query = CATALOG.query

EVENTS = """logged AS (
    SELECT event_id + 1 AS id, ['signal.issued', 'news.ingested', 'job.status'][1 + event_id % 3] AS type, concat('k', event_id) AS key, event_type, value FROM events)"""


def logged(spark: SparkSession, d: str) -> DataFrame:
    """The events table as events of a log."""
    events = spark.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, event_log.TYPES)), (F.col("event_id") % 3 + 1).cast("int"))
    data = F.to_json(F.struct("event_type", "value"))
    return events.select((F.col("event_id") + 1).alias("id"), F.col("ts").cast("string").alias("ts"), kind.alias("type"), F.concat(F.lit("k"), "event_id").alias("key"), data.alias("data"))


def folder(spark: SparkSession, what: str) -> str:
    return event_log.local_path(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")


def followed(tail: DataFrame, place: str) -> None:
    """Runs a stream over what is there now into a table; going on from where it ended before."""
    found = tail.writeStream.format("parquet").option("path", f"{place}-rows").option("checkpointLocation", f"{place}-offsets")
    found.trigger(availableNow=True).start().awaitTermination()


@query("SELECT 'event' AS kind, id, type, key, event_type, value FROM logged", (EVENTS,))
def log_tail(spark, d):
    """The log followed by byte position over two runs of one stream, the second after it has grown."""
    rows, log = logged(spark, d), folder(spark, "log")
    early = F.col("id") % 5 < 3
    event_log.write_segments(rows.where(early), log)
    followed(event_log.tail_log(spark, log, rangeBytes=1 << 20), log)
    event_log.write_segments(rows.where(~early), log)
    followed(event_log.tail_log(spark, log, rangeBytes=1 << 20), log)
    found = spark.read.parquet(f"{log}-rows")
    return found.select("kind", "id", "type", "key", F.get_json_object("data", "$.event_type").alias("event_type"), F.get_json_object("data", "$.value").cast("double").alias("value"))


@query("SELECT 'event' AS kind, id, type, key FROM logged WHERE id > (SELECT max(id) // 3 FROM logged)", (EVENTS,))
def log_tail_after(spark, d):
    """What a client that knows a third of the log has missed; its place is found by bisection."""
    rows, log = logged(spark, d), folder(spark, "log")
    event_log.write_segments(rows, log)
    known = rows.agg(F.max("id")).first()[0] // 3
    followed(event_log.tail_log(spark, log, startingId=str(known)), log)
    return spark.read.parquet(f"{log}-rows").select("kind", "id", "type", "key")


@query("SELECT type, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM logged GROUP BY type", (EVENTS,))
def log_scan(spark, d):
    """The log read as a table, by ranges of bytes."""
    log = folder(spark, "log")
    event_log.write_segments(logged(spark, d), log)
    return event_log.read_log(spark, log, rangeBytes=1 << 18).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# --- the ledger of output batches -------------------------------------------

BATCHES = 6


@query(
    f"""SELECT concat('batch-', b) AS key, count(*) AS n_rows, sum(value) AS value FROM (SELECT event_id % {BATCHES} AS b, value FROM events)
        WHERE b NOT IN (1, 2, 5) GROUP BY b""",
    doubles="value",
)
def prepared_batches(spark, d):
    """Of batches that were prepared: without the one that is logged, one whose output never came and one whose output has changed."""
    events, place = spark.read.parquet(f"{d}/events.parquet"), f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    records = f"{place}/ledger"
    for b in range(BATCHES):
        rows = events.where(F.col("event_id") % BATCHES == b)
        if b == 2:
            ledger.prepare(spark, records, "batch-2", f"{place}/2", "0" * 64, {"batch": 2})
        else:
            ledger.publish(rows, f"{place}/{b}", records, f"batch-{b}", {"batch": b})
    events.where(F.col("event_id") % BATCHES == 5).limit(1).write.mode("append").parquet(f"{place}/5")
    found = ledger.committed(spark, records, spark.createDataFrame([("batch-1",)], "key string"))
    happened = found.select("key", F.get_json_object("data", "$.batch").cast("long").alias("b"))
    rows = events.select((F.col("event_id") % BATCHES).alias("b"), "value")
    return rows.join(F.broadcast(happened), "b").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("value"))


# --- snapshots --------------------------------------------------------------

STORE = f"""parsed AS (
    SELECT url, doc_id AS article_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE title END AS title, body, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) END AS published_at FROM articles),
older AS (SELECT * FROM parsed WHERE article_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id) = 1),
newer AS (SELECT * FROM parsed WHERE article_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id DESC) = 1)"""


@query(
    """SELECT url, article_id, title, published_at, published_at IS NULL AS parse_failed FROM newer
       UNION ALL SELECT url, article_id, title, published_at, published_at IS NULL FROM older WHERE url NOT IN (SELECT url FROM newer)""",
    (ARTICLES, STORE),
)
def article_store(spark, d):
    """The article store after two runs, each a few snapshots: the later parse of a page takes the place of the earlier."""
    shown = F.when(F.col("doc_id") % 5 != 0, F.col("title")).alias("title")
    when = F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))).alias("published_at")
    parsed = articles(spark, d).select("url", F.col("doc_id").alias("article_id"), when, shown, "body")
    part = F.col("article_id") % 3
    older, newer = keep_first(parsed.where(part < 2), ["url"], "article_id"), keep_last(parsed.where(part > 0), ["url"], "article_id")
    path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
    flush = max(1, older.count() // 2)
    snapshots.upsert_articles(older, path, flush)
    snapshots.upsert_articles(newer, path, flush)
    snapshots.expire(spark, path, 1)
    return snapshots.read(spark, path).select("url", "article_id", "title", "published_at", "parse_failed")
