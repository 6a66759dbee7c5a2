"""Queries over stored files, which they write from the driver's tables first: one table for each ticker, articles and listings, labels, pages and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.text import client_key
from tidemark.operators import evaluation, eventlog, quality, runs
from tidemark.plans.catalog import Catalog
from tidemark.plans.evaluation import METRICS, SCORES, TO_PREDICTIONS, predictions
from tidemark.plans.texts import ARTICLES, articles
from tidemark.sources import files, verify
from tidemark.sources.derived import BARS, bars, read
from tidemark.sources.staging import shared_dir

CATALOG = Catalog()
query = CATALOG.query


def folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def priced(spark, d) -> str:
    """A folder with a table of bars for each ticker; some without a ticker column, one with another's, one without volume and one empty."""
    place, rows = folder(spark, "prices"), bars(spark, d).withColumn("session_date", F.to_timestamp("session_date"))
    names = sorted(r[0] for r in rows.select("ticker").distinct().collect())
    for k, name in enumerate(names):
        own = rows.where(F.col("ticker") == name)
        own = (own, own.drop("ticker"), own.withColumn("ticker", F.lit("OTHER")), own.drop("volume"), own.where("false"))[k % 5]
        own.repartition(2).write.parquet(f"{place}/{name}.parquet")
    return place


@query(
    """SELECT named, CASE WHEN k = 4 THEN 0 ELSE n END AS n_rows, array_to_string(CASE k WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['no ticker column'] WHEN 2 THEN ['ticker is not the file''s'] WHEN 3 THEN ['volume missing'] ELSE ['empty'] END, '; ') AS problems, k < 2 AS ok
       FROM (SELECT ticker AS named, count(*) AS n, (row_number() OVER (ORDER BY ticker) - 1) % 5 AS k FROM bars GROUP BY ticker)
       UNION ALL SELECT 'UNHEARD OF', 0, 'missing', false""",
    (BARS,),
)
def verify_files(spark, d):
    """What the footers of the stored price tables tell."""
    found = verify.verified(spark, priced(spark, d), verify.PRICE_COLUMNS, True, ("BUILDING", "UNHEARD OF"))
    return found.select("named", F.col("rows").alias("n_rows"), F.array_join("problems", "; ").alias("problems"), "ok")


@query("SELECT ticker, count(*) AS n_rows, sum(close) AS close FROM bars GROUP BY ticker", (BARS,), "close", places=4)
def stored_prices(spark, d):
    """Price tables read as one; a table without a ticker column belongs to its name."""
    place = folder(spark, "prices")
    rows = bars(spark, d)
    for k, name in enumerate(sorted(r[0] for r in rows.select("ticker").distinct().collect())):
        own = rows.where(F.col("ticker") == name)
        (own.drop("ticker") if k % 2 else own).write.parquet(f"{place}/{name}.parquet")
    return files.read_prices(spark, place).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("close").alias("close"))


@query("SELECT l.ticker, a.url, a.title FROM (SELECT DISTINCT ticker, url FROM articles) l JOIN (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) = 1) a ON l.url = a.url", (ARTICLES,))
def stored_news(spark, d):
    """Stored links with their stored articles."""
    place, rows = folder(spark, "news"), articles(spark, d)
    rows.select("ticker", "url").distinct().write.parquet(f"{place}/listings.parquet")
    rows.select("url", "title", "body", F.col("doc_id").alias("published_at")).write.parquet(f"{place}/articles.parquet")
    return files.read_news(spark, f"{place}/listings.parquet", f"{place}/articles.parquet").select("ticker", "url", "title")


@query("SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' END AS label FROM labels) WHERE label IS NOT NULL")
def stored_labels(spark, d):
    """A label file without the rows that have no label."""
    place = folder(spark, "labels")
    label = F.when(F.col("toxic") == 1, "NEGATIVE ").when(F.col("quality") == 1, " POSITIVE").otherwise("  ")
    read(spark, d, "labels").select("doc_id", label.alias("label"), F.concat(F.lit("text "), "doc_id").alias("text")).write.parquet(f"{place}/own.parquet")
    return files.read_labels(spark, f"{place}/own.parquet").select("doc_id", "label")


@query(
    """SELECT ['AAA', 'BBB', 'CCC'][1 + t] AS ticker, year, coalesce(bool_or(stale AND n = stop), false) AS complete, count_if(NOT failed AND NOT stale AND n <= coalesce(stop, n)) AS n_links
       FROM (SELECT *, min(CASE WHEN failed OR stale THEN n END) OVER (PARTITION BY t, year) AS stop FROM walk) GROUP BY t, year""",
    ("walk AS (SELECT page_id % 3 AS t, CAST(2000 + page_id // 600 AS INTEGER) AS year, page_id % 600 // 3 + 1 AS n, page_id % 59 = 3 AS failed, page_id % 41 = 5 AND page_id % 600 >= 3 AND page_id % 59 <> 3 AS stale FROM pages)",),
)
def listing_walk(spark, d):
    """Stored listing pages walked in order: a failed fetch ends a walk, a page without anything new completes it."""
    k, pages = F.col("page_id"), read(spark, d, "pages")
    walk = [F.element_at(F.array(*map(F.lit, ("AAA", "BBB", "CCC"))), (k % 3 + 1).cast("int")).alias("ticker"), (2000 + F.expr("page_id div 600")).cast("int").alias("year")]
    page, first = (F.expr("page_id % 600 div 3") + 1).cast("int"), k - k % 600 + k % 3
    link = F.struct(F.concat(F.lit("u"), F.when((k % 41 == 5) & (k % 600 >= 3), first).otherwise(k)).alias("url"), F.lit("01/01/2024").alias("list_date"))
    rows = pages.select(*walk, page.alias("page"), F.when(k % 59 != 3, 200).alias("status"), F.lit(None).cast("string").alias("redirect"), F.lit(None).cast("int").alias("declared"), F.array(link).alias("links"))
    links, walks = eventlog.walked(rows)
    counts = links.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n_links"))
    return walks.join(counts, ["ticker", "year"], "left").select("ticker", "year", "complete", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('10.0.', user_id % 250, '.7') WHEN 1 THEN concat('2001:db8:1:', printf('%x', 1 + user_id % 60000), '::/64') END AS key FROM events"""
)
def limiter_keys(spark, d):
    """Addresses of requests as the limiter's keys: IPv4 as it is, IPv6 by its network, nothing for what is no address."""
    user, k = F.col("user_id"), F.col("event_id") % 3
    six = F.concat(F.lit("2001:db8:1:"), F.lower(F.hex(1 + user % 60000)), F.lit(":0:0:0:"), F.lower(F.hex(F.col("event_id") % 9999 + 1)))
    address = F.when(k == 0, F.concat(F.lit("10.0."), user % 250, F.lit(".7"))).when(k == 1, six).otherwise("no address")
    return read(spark, d, "events").select("event_id", client_key(address).alias("key"))


@query("SELECT ticker, CAST(session_date AS TIMESTAMP) AS time, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars", (BARS,), "open high low close volume")
def normalized_prices(spark, d):
    """Vendor prices with other names and text for numbers, as the library has them."""
    raw = bars(spark, d).select("ticker", F.col("session_date").cast("string").alias("Time"), *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low", "close", "volume")])
    return quality.normalize_prices(raw)


@query("SELECT window, arm, seed, n, macro_f1, balanced_accuracy, accuracy FROM scores", (*TO_PREDICTIONS, SCORES), METRICS)
def stored_run(spark, d):
    """A run's folder written, discovered and read back: its metrics by window."""
    root = folder(spark, "runs")
    made = predictions(spark, d)
    record = made.agg(F.count(F.lit(1)).alias("panel_rows")).withColumns({"config": F.create_map(F.lit("horizon"), F.lit("1")), "news": F.create_map(F.lit("path"), F.lit("news.parquet"))})
    runs.write_run(f"{root}/own", record, {"predictions": made})
    listed = runs.list_runs(spark, root).first()
    if (listed["name"], listed["mode"], listed["horizon"]) != ("own", "real", 1):
        raise ValueError(f"the run is listed as {listed}")
    return evaluation.scores(runs.run_table(spark, root, "own", "predictions"), "window", "arm", "seed")
