"""A rate limiter over a stream of requests whose state is bounded: buckets of tokens, the least recently seen client goes first.

Clients are dealt over shards by key; a shard keeps at most its part of ``most_clients``. State lies in RocksDB:
a client's tokens, when it was seen and its place in the order of use, and that order as a map from places to
clients, with the first and the next place. A client that is seen again leaves its old place behind, which is
passed over when the order is read from its front, so every step costs what it touches and never a scan.
Each call of the store is a message to the JVM: a batch asks for a client once, however often it is seen and
forgotten within the batch, and for the front of the order once until that moves.

A client that was idle for a whole window has a full bucket again, so forgetting it changes nothing. Beyond
``most_clients`` the least recently seen one is forgotten early, and has a full bucket when it comes back.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id string, event_id bigint, retry_after double"
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


@contextmanager
def stores(spark: SparkSession):
    """Settings of the state stores that a limiter's query needs when it starts."""
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Buckets(StatefulProcessor):
    """The buckets of one shard."""

    def __init__(self, limit: int, window_seconds: float, most: int, wake_after_ms: int | None) -> None:
        self.limit, self.window, self.most, self.wake_after_ms = float(limit), window_seconds, most, wake_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getMapState("clients", "user string", "tokens double, seen double, place bigint")
        self.order = handle.getMapState("order", "place bigint", "user string")
        self.ends = handle.getValueState("ends", "first bigint, next bigint, n bigint")

    def begin(self) -> None:
        self.first, self.next, self.n = self.ends.get() if self.ends.exists() else (0, 0, 0)
        #: Clients of this batch in order of use; all others were seen before them.
        self.hot: OrderedDict[str, tuple[float, float]] = OrderedDict()
        #: Whether the store has a client, of those that this batch has asked for; the front of the order, if it is known.
        self.asked: dict[str, bool] = {}
        self.ahead: tuple[str, tuple] | None = None
        self.empty = self.n == 0

    def stored(self, user: str) -> bool:
        if user not in self.asked:
            self.asked[user] = not self.empty and self.clients.containsKey((user,))
        return self.asked[user]

    def front(self) -> tuple[str, tuple] | None:
        """The least recently seen client outside this batch; places that were left behind go."""
        if self.ahead is not None and self.ahead[0] not in self.hot:
            return self.ahead
        while self.first < self.next:
            place = (self.first,)
            if self.order.containsKey(place):
                user = self.order.getValue(place)[0]
                if user not in self.hot and self.stored(user):
                    held = self.clients.getValue((user,))
                    if held[2] == self.first:
                        self.ahead = user, held
                        return self.ahead
                self.order.removeKey(place)
            self.first += 1
        return None

    def forget(self, idle_since: float | None) -> bool:
        """Forgets the least recently seen client if it is idle since then, or whenever it was seen; whether it did."""
        found = self.front()
        if found is not None:
            user, (_, seen, place) = found
            if idle_since is not None and seen > idle_since:
                return False
            self.order.removeKey((place,))
            self.first += 1
        elif self.hot:
            user, (_, seen) = next(iter(self.hot.items()))
            if idle_since is not None and seen > idle_since:
                return False
            del self.hot[user]
        else:
            return False
        if self.ahead is not None and self.ahead[0] == user:
            self.ahead = None
        if self.stored(user):
            self.clients.removeKey((user,))
            self.asked[user] = False
        self.n -= 1
        return True

    def spend(self, user: str, now: float) -> float:
        """Seconds until the request would be allowed, 0 if it is."""
        while self.forget(now - self.window):
            pass
        known = self.hot.pop(user, None)
        if known is None and self.stored(user):
            known = self.clients.getValue((user,))[:2]
        if known is None:
            while self.n >= self.most and self.forget(None):
                pass
            self.n += 1
            known = (self.limit, now)
        rate = self.limit / self.window
        tokens = min(self.limit, known[0] + max(0.0, now - known[1]) * rate)
        wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
        self.hot[user] = (tokens - 1 if tokens >= 1 else tokens, now)
        return wait

    def keep(self) -> None:
        for user, (tokens, seen) in self.hot.items():
            self.clients.updateValue((user,), (float(tokens), float(seen), self.next))
            self.order.updateValue((self.next,), (user,))
            self.next += 1
        self.ends.update((self.first, self.next, self.n))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.begin()
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [(u, e, self.spend(u, t.timestamp())) for u, e, t in zip(batch["user_id"], batch["event_id"], batch["ts"], strict=True)]
        self.keep()
        if self.wake_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wake_after_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A shard without requests for a window: all of its buckets are full again."""
        self.begin()
        while self.forget(None):
            pass
        self.keep()
        yield pd.DataFrame({"user_id": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "retry_after": pd.Series(dtype=float)})


def limited(requests: DataFrame, limit: int, window_seconds: float, most_clients: int = 10_000, shards: int = 64, evict: bool = False) -> DataFrame:
    """(user_id, event_id, retry_after) of a stream of requests (user_id, event_id, ts).

    Requests of a batch are taken in order of time and id. With ``evict``, for queries that keep running, a
    shard is emptied by a timer once a window has passed without a request.
    """
    if limit < 1 or window_seconds <= 0 or most_clients < shards or shards < 1:
        raise ValueError("limit, window and shards must be positive, and each shard must hold a client")
    user = F.col("user_id").cast("string")
    dealt = requests.select(user.alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.pmod(F.xxhash64(user), F.lit(shards)).cast("int").alias("shard"))
    processor = Buckets(limit, window_seconds, most_clients // shards, int(window_seconds * 1000) if evict else None)
    return dealt.groupBy("shard").transformWithStateInPandas(processor, OUTPUT, "Append", "ProcessingTime" if evict else "None")
