"""Queries over issued forecasts and the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import eventlog, serving, sessions
from tidemark.plans.catalog import Catalog
from tidemark.plans.evaluation import TO_PREDICTIONS, predictions
from tidemark.plans.panel import ALIGNED, fitted, labelled
from tidemark.sources.derived import BARS, NEWS, bars, news, read
from tidemark.sources.staging import shared_dir
from tidemark.streaming import limiter

CATALOG = Catalog()
query = CATALOG.query

ISSUED = """issued AS (
    SELECT ticker, p.observation_date, y_pred, prob_down, prob_flat, prob_up, q_low AS threshold_low, CASE WHEN day(p.observation_date) % 2 = 0 THEN q_high END AS threshold_high, q_low, q_high,
           CAST(p.target_date AS TIMESTAMP) + to_minutes((day(p.observation_date) * 60) % 1440 - 480) AS issued_at
    FROM predictions p WHERE arm = 'price' AND seed = 42)"""
RESOLVED = """resolved AS (
    SELECT i.*, l.target_date, l.target_return, CASE WHEN l.target_return < i.threshold_low THEN 'DOWN' WHEN l.target_return > coalesce(i.threshold_high, i.q_high) THEN 'UP' WHEN l.target_return IS NOT NULL THEN 'FLAT' END AS y_true
    FROM issued i LEFT JOIN labelled l USING (ticker, observation_date)),
flagged AS (
    SELECT *, y_true = y_pred AS correct, coalesce(issued_at < CAST(target_date AS TIMESTAMP) + INTERVAL 9 HOUR, false) AS prospective, coalesce(CAST(issued_at AS DATE) <= observation_date, false) AS issued_same_session FROM resolved)"""
TO_ISSUED = (*TO_PREDICTIONS, ISSUED)


def issued(spark, d):
    own = predictions(spark, d).where("arm = 'price' and seed = 42")
    bounds = fitted(spark, d)
    day = F.day("observation_date")
    return own.join(F.broadcast(bounds), F.lit(True)).select(
        "ticker",
        "observation_date",
        "y_pred",
        "prob_down",
        "prob_flat",
        "prob_up",
        F.col("q_low").alias("threshold_low"),
        F.when(day % 2 == 0, F.col("q_high")).alias("threshold_high"),
        (F.col("target_date").cast("timestamp_ntz") + F.make_dt_interval(mins=(day * 60) % 1440 - 480)).alias("issued_at"),
    )


def resolved(spark, d):
    return serving.resolve(issued(spark, d), labelled(spark, d), fitted(spark, d))


@query("SELECT ticker, observation_date, target_date, y_pred, y_true, correct, prospective, issued_same_session FROM flagged", (*TO_ISSUED, RESOLVED))
def resolve_predictions(spark, d):
    return resolved(spark, d).select("ticker", "observation_date", "target_date", "y_pred", "y_true", "correct", "prospective", "issued_same_session")


@query(
    """SELECT target_date, count(*) AS n_total, count(correct) AS n_resolved, count_if(correct IS NOT NULL AND NOT prospective) AS n_replayed, count_if(correct IS NULL) AS n_pending,
              avg(CASE WHEN prospective THEN CASE WHEN correct THEN 1.0 WHEN NOT correct THEN 0.0 END END) AS accuracy FROM flagged GROUP BY target_date""",
    (*TO_ISSUED, RESOLVED),
    "accuracy",
)
def live_accuracy(spark, d):
    return serving.live_accuracy(resolved(spark, d), "target_date")


@query("SELECT ticker, observation_date, y_pred, 'computed' AS side FROM issued WHERE ticker = 'BUILDING' UNION ALL SELECT ticker, observation_date, 'NONE', 'issued' FROM issued WHERE ticker = 'BUILDING'", TO_ISSUED)
def issue_diff(spark, d):
    rows = issued(spark, d).select("ticker", "observation_date", "y_pred")
    other = rows.withColumn("y_pred", F.when(F.col("ticker") == "BUILDING", "NONE").otherwise(F.col("y_pred")))
    return serving.differs(other, rows)


def shown_news(spark, d, observation):
    """Aligned news of at least the last sessions up to a date; all others are left out where they are read."""
    own = bars(spark, d)
    ends = serving.last_sessions(own, observation).agg(F.min("session_date"), F.max("session_date")).first()
    found = news(spark, d) if ends[0] is None else sessions.between_sessions(news(spark, d), *ends)
    return sessions.align_forward(found, own)


@query(
    """SELECT ticker, url, observation_date, place, greatest(prob_negative, prob_positive) AS conviction FROM (
           SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY greatest(prob_negative, prob_positive) DESC, url) AS place FROM aligned
           WHERE (ticker, observation_date) IN (SELECT (ticker, session_date) FROM (SELECT ticker, session_date, row_number() OVER (PARTITION BY ticker ORDER BY session_date DESC) AS r FROM bars WHERE session_date <= DATE '1998-02-01') WHERE r <= 5)) WHERE place <= 5""",
    (BARS, NEWS, ALIGNED),
    "conviction",
)
def top_news(spark, d):
    day = F.lit("1998-02-01").cast("date")
    return serving.top_news(shown_news(spark, d, day), bars(spark, d), day).select("ticker", "url", "observation_date", "place", "conviction")


@query(
    """SELECT i.ticker, i.observation_date, y_pred, greatest(prob_down, prob_flat, prob_up) AS confidence, close AS last_close, round_even(close * (1 + q_low), 2) AS band_low, round_even(close * (1 + q_high), 2) AS band_high
       FROM issued i JOIN (SELECT ticker AS t, session_date, close FROM bars) b ON i.ticker = t AND i.observation_date = session_date""",
    TO_ISSUED,
    "confidence last_close band_low band_high",
    places=6,
)
def live_today(spark, d):
    rows = issued(spark, d)
    close = sessions.last_known(bars(spark, d), rows.select("ticker", "observation_date"), "close")
    bounds = fitted(spark, d)
    joined = rows.join(close, ["ticker", "observation_date"]).join(F.broadcast(bounds), F.lit(True))
    return joined.select("ticker", "observation_date", "y_pred", F.greatest("prob_down", "prob_flat", "prob_up").alias("confidence"), "last_close", *serving.flat_band(F.col("last_close"), F.col("q_low"), F.col("q_high")))


@query("SELECT ticker, target_date, y_pred, total FROM (SELECT *, count(*) OVER () AS total FROM predictions WHERE arm = 'price' AND seed = 42) ORDER BY ticker, target_date LIMIT 25 OFFSET 50", TO_PREDICTIONS)
def paginate(spark, d):
    return serving.page(predictions(spark, d).where("arm = 'price' and seed = 42").select("ticker", "target_date", "y_pred"), ["ticker", "target_date"], 25, 50)


@query("SELECT max(observation_date) AS observation_date, count(*) AS n_rows FROM issued", TO_ISSUED)
def live_status(spark, d):
    return issued(spark, d).agg(F.max("observation_date").alias("observation_date"), F.count(F.lit(1)).alias("n_rows"))


# --- events -----------------------------------------------------------------

#: Every two events of the table are one entry of the log; arrivals are keyed by threes, so half of them are new.
LOG = "log AS (SELECT min(event_id) // 2 + 1 AS id, concat('k', event_id // 2 * 2) AS key, min_by(event_type, event_id) AS type FROM events GROUP BY event_id // 2)"


def log(spark, d):
    events = read(spark, d, "events").groupBy(F.expr("event_id div 2").alias("pair")).agg(F.min_by("event_type", "event_id").alias("type"))
    return events.select((F.col("pair") + 1).alias("id"), F.concat(F.lit("k"), F.col("pair") * 2).alias("key"), "type")


def arrivals(spark, d):
    return read(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id") - F.col("event_id") % 3).alias("key"), F.col("event_type").alias("type"), "event_id")


def head(spark, d):
    """The last id of the log."""
    return log(spark, d).agg(F.max("id")).first()[0]


@query(
    """SELECT key, type, (SELECT max(id) FROM log) + row_number() OVER (ORDER BY event_id) AS id FROM (
           SELECT concat('k', event_id - event_id % 3) AS key, event_type AS type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1)
       WHERE key NOT IN (SELECT key FROM log)""",
    (LOG,),
)
def event_append(spark, d):
    return eventlog.append(log(spark, d), arrivals(spark, d), ["event_id"]).select("key", "type", "id")


@query("SELECT 'event' AS kind, id, key FROM log WHERE id > (SELECT max(id) // 2 FROM log)", (LOG,))
def event_replay(spark, d):
    return eventlog.replay(log(spark, d), str(head(spark, d) // 2))


@query("SELECT 'reset:stale_last_event_id' AS kind, max(id) AS id, CAST(NULL AS VARCHAR) AS key FROM log", (LOG,))
def event_replay_stale(spark, d):
    return eventlog.replay(log(spark, d), "99999999999999999999")


@query("SELECT 'reset:invalid_last_event_id' AS kind, max(id) AS id, CAST(NULL AS VARCHAR) AS key FROM log", (LOG,))
def event_replay_invalid(spark, d):
    return eventlog.replay(log(spark, d), "12x")


@query("SELECT ticker, year FROM (SELECT DISTINCT c_mktsegment AS ticker FROM customer), (SELECT unnest([1995, 1996, 1997, 1998]) AS year) WHERE year IN (1996, 1998)")
def coverage_watermark(spark, d):
    years = F.explode(F.array(*[F.lit(y) for y in (1995, 1996, 1997, 1998)]))
    work = read(spark, d, "customer").select(F.col("c_mktsegment").alias("ticker")).distinct().select("ticker", years.alias("year"))
    walks = work.withColumn("complete", ~((F.col("ticker") == "BUILDING") & (F.col("year") == 1996)))
    covered = eventlog.new_coverage(walks.where("year <> 1998"), "2001-12-31")
    return eventlog.uncovered(work, covered, "2001-06-30").select("ticker", F.col("year").cast("int").alias("year"))


@query("SELECT event_id % 50 AS batch, count(*) AS n_rows FROM events WHERE event_id % 50 % 3 = 0 GROUP BY 1")
def ledger_recovery(spark, d):
    own = read(spark, d, "events").groupBy((F.col("event_id") % 50).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"))
    ledger = own.withColumn("output_sha256", F.sha2(F.col("batch").cast("string"), 256))
    outputs = own.where("batch % 3 = 0").select(F.sha2(F.col("batch").cast("string"), 256).alias("sha256"))
    return eventlog.committed_batches(ledger, outputs).select("batch", "n_rows")


BUCKETS = """buckets AS (
        SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS us, CAST(0 AS BIGINT) AS i, 3.0::DOUBLE AS have, 3.0::DOUBLE AS after FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT t.user_id, t.event_id, t.us, t.i, h.v, CASE WHEN h.v >= 1 THEN h.v - 1 ELSE h.v END
        FROM buckets b JOIN timed t ON b.user_id = t.user_id AND t.i = b.i + 1, LATERAL (SELECT least(3.0::DOUBLE, b.after + coalesce((t.us - b.us) / 1e6, 0) * (3 / 3600.0::DOUBLE)) AS v) h)"""
TIMED = "timed AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(
    """SELECT user_id, event_id, CASE WHEN have >= 1 THEN 0.0::DOUBLE ELSE (1 - have) / (3 / 3600.0::DOUBLE) END AS retry_after FROM buckets WHERE i > 0""",
    (TIMED, BUCKETS),
    "retry_after",
    recursive=True,
    places=4,
)
def token_bucket(spark, d):
    return eventlog.token_bucket(read(spark, d, "events"), 3, 3600.0)


@query(
    """SELECT user_id, event_id, CASE WHEN have >= 1 THEN 0.0::DOUBLE ELSE (1 - have) / (3 / 3600.0::DOUBLE) END AS retry_after FROM buckets WHERE i > 0""",
    (TIMED, BUCKETS),
    "retry_after",
    recursive=True,
    places=4,
)
def limiter_stream(spark, d):
    """The bounded limiter over the requests as a stream; while clients fit, it answers as unbounded buckets do."""
    events = read(spark, d, "events")
    place = f"{shared_dir(spark)}/limiter-{uuid.uuid4().hex}"
    # a pattern, as a table may be a file or a folder
    requests = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    with limiter.stores(spark):
        limiter.limited(requests, 3, 3600.0, most_clients=1 << 20, shards=8).writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows").select(F.col("user_id").cast("long").alias("user_id"), "event_id", "retry_after")


@query(
    """SELECT user_id, max(open) AS most_open FROM (
           SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY moment, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM (
               SELECT user_id, ts AS moment, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 6 HOUR, -1 FROM events)) GROUP BY user_id"""
)
def stream_slots(spark, d):
    spans = read(spark, d, "events").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("until"))
    return eventlog.concurrency(spans, "user_id", "ts", "until").select("user_id", F.col("most_open"))
