"""The event log: idempotent appends, replay, ledgers, coverage and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import numbered_within
from tidemark.sources import event_log

LINE = "id long, ts string, type string, key string, data string"
TYPES = event_log.TYPES


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; lines that can't be read, or lack an id, a known type or a key, are passed over."""
    schema = "id long, ts string, type string, key string, data string"
    event = F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("e")
    return lines.select(event).select("e.*").where(F.col("id").isNotNull() & F.col("key").isNotNull() & F.col("type").isin(*TYPES))


def append(log: DataFrame, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """The events that aren't in the log yet, with the ids that follow its last one.

    Of arrivals with one key the first counts; ids are dense and in order of arrival, numbered by ranges of
    that order. One writer at a time.
    """
    fresh = arrivals.join(log.select("key").distinct(), "key", "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("_r = 1").drop("_r")
    head = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_head"))
    numbered = numbered_within(first, [F.col(c) for c in order], "_n")
    return numbered.join(F.broadcast(head), F.lit(True)).withColumn("id", F.col("_head") + F.col("_n")).drop("_head", "_n")


def replay(log: DataFrame, last_event_id: str | None) -> DataFrame:
    """(kind, id, key): the events after an id, or one reset row.

    No id: nothing to replay. Not a number: reset(invalid). Beyond the head, or so old that events
    between are gone: reset(stale).
    """
    ends = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("head"), F.min("id").alias("first"))
    empty = log.where("false").select(F.lit("event").alias("kind"), "id", "key")
    if last_event_id is None:
        return empty
    reset = lambda why: ends.select(F.lit(f"reset:{why}").alias("kind"), F.col("head").alias("id"), F.lit(None).cast("string").alias("key"))
    text = last_event_id.strip()
    if not (text.isascii() and text.isdigit()):
        return reset("invalid_last_event_id")
    # ids are longs; anything beyond them is beyond the head as well
    last = F.lit(min(int(text), (1 << 63) - 1))
    stale = (last > F.col("head")) | F.coalesce(last < F.col("first") - 1, F.lit(False))
    events = log.join(F.broadcast(ends), F.lit(True)).where(~stale & (F.col("id") > last)).select(F.lit("event").alias("kind"), "id", "key")
    refused = reset("stale_last_event_id").join(F.broadcast(ends.select(stale.alias("_s"))), F.lit(True)).where("_s").drop("_s")
    return events.unionByName(refused)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log of JSON lines, dealt by ranges of bytes; torn and malformed lines are passed over."""
    return event_log.read_log(spark, path).where("kind = 'event'").select("id", "ts", "type", "key", "data")


def tail_state(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row (kind, head): how a log that was read up to ``before``'s last id goes on.

    append: more events or none; log_replaced: the last known event is gone or another one has its id.
    """
    known = before.agg(F.max_by("key", "id").alias("_key"), F.max("id").alias("_id"))
    found = now.join(F.broadcast(known), F.lit(True)).agg(F.count_if((F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))).alias("_n"), F.coalesce(F.max("id"), F.lit(0)).alias("head"))
    # nothing was read before: whatever is there is new
    fresh = known.select(F.col("_id").isNull().alias("_none"))
    return found.join(fresh, F.lit(True)).select(F.when(F.col("_none") | (F.col("_n") > 0), "append").otherwise("log_replaced").alias("kind"), "head")


def reconcile(log: DataFrame, signals: DataFrame, batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events of what was committed and isn't logged, with their ids: forecasts by observation date, then
    news batches, then jobs; doing it again gives none.

    ``signals`` (key, observation_date, arm), ``batches`` and ``jobs`` (key, at): derived from artifacts.
    """
    blank = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    parts = [
        signals.select("key", F.lit("signal.issued").alias("type"), F.lit(0).alias("stage"), F.col("observation_date").cast("string").alias("at"), F.col("arm").alias("arm")),
        batches.select("key", F.lit("news.ingested").alias("type"), F.lit(1).alias("stage"), F.col("at").cast("string").alias("at"), *blank("arm")),
        jobs.select("key", F.lit("job.status").alias("type"), F.lit(2).alias("stage"), F.col("at").cast("string").alias("at"), *blank("arm")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return append(log, every, ["stage", "at", "arm", "key"]).select("id", "key", "type")


def job_event(spark: SparkSession, job: str, status: str, at: str) -> DataFrame:
    """The record of a job's last run, as one event."""
    return spark.createDataFrame([(f"{job}/{at}", "job.status", at, status)], "key string, type string, at string, status string")


def walked(pages: DataFrame, max_pages: int = 200) -> tuple[DataFrame, DataFrame]:
    """Links found by walking stored listing pages in order, and whether each walk came to its end.

    ``pages`` (ticker, year, page, status, redirect, declared, links): status null is a failed fetch,
    declared the number of pages that a listing names. A walk is complete if it ended on a page without
    anything new, on the declared last page, or was sent to an error page past that.
    Returns (ticker, year, url, list_date) and (ticker, year, complete).
    """
    walk = ["ticker", "year"]
    total = pages.where("status = 200").groupBy(*walk).agg(F.min_by("declared", "page").alias("_total"))
    links = pages.where("status = 200").select(*walk, "page", F.inline("links")).groupBy(*walk, "url").agg(F.min("page").alias("page"), F.min_by("list_date", "page").alias("list_date"))
    new = links.groupBy(*walk, "page").agg(F.count(F.lit(1)).alias("_new"))
    known = pages.join(total, walk, "left").join(new, [*walk, "page"], "left")
    sent_away = F.coalesce(F.col("status").isin(301, 302, 303, 307, 308) & F.col("redirect").contains("/Error") & (F.col("page") > F.col("_total")), F.lit(False))
    fine = F.coalesce(F.col("status") == 200, F.lit(False))
    ended = F.when(~fine, F.when(sent_away, True).otherwise(False)).when(F.col("_new").isNull(), True).when(F.col("page") >= F.col("_total"), True)
    stops = known.where(F.col("page") <= max_pages).withColumn("_end", ended).where("_end is not null").groupBy(*walk).agg(F.min("page").alias("_stop"), F.min_by("_end", "page").alias("complete"))
    walks = pages.select(*walk).distinct().join(stops, walk, "left").select(*walk, "_stop", F.coalesce("complete", F.lit(False)).alias("complete"))
    kept = links.join(walks, walk).where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    return kept.where(F.col("page") <= max_pages).select(*walk, "url", "list_date"), walks.select(*walk, "complete")


def committed_batches(ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Ledger rows whose recorded digest is that of an output that exists: the batches that happened."""
    return ledger.join(outputs.select(F.col("sha256").alias("output_sha256")).distinct(), "output_sha256", "left_semi")


def uncovered(work: DataFrame, coverage: DataFrame, wanted_through: str) -> DataFrame:
    """(ticker, year) that must be walked: years not covered through the wanted date."""
    covered = coverage.where(F.col("walked_through") >= F.lit(wanted_through).cast("date"))
    return work.join(covered.select("year"), "year", "left_anti")


def new_coverage(walks: DataFrame, wanted_through: str) -> DataFrame:
    """Years of which every ticker was walked completely."""
    return walks.groupBy("year").agg(F.every("complete").alias("_all")).where("_all").select("year", F.lit(wanted_through).cast("date").alias("walked_through"))


def fetch_queue(links: DataFrame, store: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """Links to fetch: not stored, without a body, or without a time unless parsing failed before."""
    found = links.select("url").distinct().join(store.select("url", "body", "published_at", "parse_failed", F.lit(True).alias("_stored")), "url", "left")
    bodyless = ~F.coalesce(F.length(F.trim("body")) > 0, F.lit(False))
    untimed = F.col("published_at").isNull() & (F.lit(retry_failed) | ~F.coalesce("parse_failed", F.lit(False)))
    reason = F.when(F.col("_stored").isNull(), "new").when(bodyless, "no_body").when(untimed, "no_time")
    queue = found.select("url", reason.alias("reason")).where("reason is not null")
    return queue.orderBy("url").limit(limit) if limit else queue


def token_bucket(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """Adds retry_after: 0 if a request is allowed, else seconds until it would be.

    A bucket refills with limit / window tokens a second up to ``limit``. Folded over the requests of one
    client in order of time and id; a bucket is independent of all others.
    """
    rate = limit / window_seconds
    ordered = requests.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id"))).alias("r"))
    start = F.struct(F.lit(float(limit)).alias("tokens"), F.lit(None).cast("long").alias("seen"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        passed = F.coalesce((x["us"] - s["seen"]) / 1e6, F.lit(0.0))
        have = F.least(F.lit(float(limit)), s["tokens"] + passed * rate)
        free = have >= 1
        return F.struct(F.when(free, have - 1).otherwise(have).alias("tokens"), x["us"].alias("seen"), F.concat(s["out"], F.array(F.when(free, 0.0).otherwise((1 - have) / rate))).alias("out"))

    folded = ordered.withColumn("o", F.aggregate("r", start, step)["out"])
    return folded.select("user_id", F.inline(F.zip_with("r", "o", lambda r, o: F.struct(r["event_id"].alias("event_id"), o.alias("retry_after")))))


def concurrency(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The most spans of each key that are open at once; a span that ends makes room first."""
    changes = spans.select(key, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn("open", running).groupBy(key).agg(F.max("open").alias("most_open"))
