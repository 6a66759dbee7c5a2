"""Structured Streaming twins: the event log's writer, news against sessions, and a stateful rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.eventlog import append
from tidemark.operators.sessions import align_forward

LOG = "id long, ts timestamp, type string, key string, data string"


def append_stream(events: DataFrame, path: str, checkpoint: str, order: list[str]):
    """Appends a stream of events to the log at ``path`` once each, whatever is replayed.

    A micro-batch is checked against the log's keys, numbered after its last id and written in one
    commit; after a crash the batch comes again and finds its keys there. One writer at a time.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        log = stored_log(spark, path)
        fresh = append(log, batch, order).select("id", "ts", "type", "key", "data")
        fresh.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as written so far; empty before the first commit."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(LOG).parquet(path)


def aligned_batches(news: DataFrame, sessions: DataFrame, sink, checkpoint: str):
    """Aligns a stream of news with a table of sessions, batch by batch: late news roll forward or go stale
    by the same rule as stored ones, and what was issued before is never touched."""
    return news.writeStream.foreachBatch(lambda batch, n: sink(align_forward(batch, sessions), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(requests: DataFrame, limit: int, window_seconds: float, evict: bool = False) -> DataFrame:
    """A token bucket for each client over a stream of (user_id, event_id, ts): state is two numbers.

    With ``evict``, for queries that keep running, it goes after a window without requests, when the
    bucket is full again. A query over what is there now would wait for those timeouts.
    """
    rate = limit / window_seconds

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, seen = state.get if state.exists else (float(limit), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"], strict=True):
            now = ts.timestamp()
            if seen is not None:
                tokens = min(float(limit), tokens + max(0.0, now - seen) * rate)
            seen = now
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens -= tokens >= 1
            out.append((key[0], event_id, wait))
        state.update((float(tokens), float(seen)))
        if evict:
            state.setTimeoutDuration(int(window_seconds * 1000))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "retry_after"])

    grouped = requests.groupBy("user_id")
    return grouped.applyInPandasWithState(spend, "user_id long, event_id long, retry_after double", "tokens double, seen double", "append", GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond the log itself: counts by event-time window and type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
