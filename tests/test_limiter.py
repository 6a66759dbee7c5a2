"""The bounded limiter against a plain one that keeps its clients in order of use."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.streaming import limiter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(batches, limit, window, most):
    clients, out = OrderedDict(), {}
    for batch in batches:
        for user, event, at in sorted(batch, key=lambda x: (x[2], x[1])):
            while clients and next(iter(clients.values()))[1] <= at - window:
                clients.popitem(last=False)
            tokens, seen = clients.pop(user, (None, None))
            if tokens is None:
                while len(clients) >= most:
                    clients.popitem(last=False)
                tokens, seen = float(limit), at
            tokens = min(limit, tokens + max(0, at - seen) * limit / window)
            out[event] = 0.0 if tokens >= 1 else (1 - tokens) * window / limit
            clients[user] = (tokens - (tokens >= 1), at)
    return out


def run(spark, place, batches, *given, **options):
    """Each batch is a run of one stream over the folder."""
    schema = "user_id string, event_id long, ts timestamp"
    found = {}
    for batch in batches:
        spark.createDataFrame([(u, e, START + timedelta(seconds=t)) for u, e, t in batch], schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        with limiter.stores(spark):
            rows = limiter.limited(spark.readStream.schema(schema).parquet(f"{place}/in"), *given, **options)
            rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/at").trigger(availableNow=True).start().awaitTermination()
    for r in spark.read.parquet(f"{place}/out").collect():
        assert r.event_id not in found
        found[r.event_id] = r.retry_after
    return found


@pytest.mark.parametrize(("most", "users"), [(3, 8), (100, 8)])
def test_equals_a_plain_limiter_over_batches(spark, tmp_path, most, users):
    rng, event, at, batches = random.Random(most), 0, 0.0, []
    for _ in range(4):
        batch = []
        for _ in range(40):
            at += rng.choice([0, 0.25, 1, 3, 12])
            batch.append((f"u{rng.randrange(users)}", event, at))
            event += 1
        rng.shuffle(batch)
        batches.append(batch)
    got, expected = run(spark, tmp_path, batches, 3, 10.0, most_clients=most, shards=1), plain(batches, 3, 10.0, most)
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in expected.items()}
    assert any(expected.values())


def test_a_client_that_was_forgotten_early_starts_with_a_full_bucket(spark, tmp_path):
    batches = [[("a", 0, 0), ("a", 1, 0)], [("b", 2, 1), ("c", 3, 1), ("a", 4, 2)]]
    assert run(spark, tmp_path / "few", batches, 1, 100.0, most_clients=2, shards=1) == {0: 0, 1: 100, 2: 0, 3: 0, 4: 0}
    assert run(spark, tmp_path / "many", batches, 1, 100.0, most_clients=3, shards=1)[4] == pytest.approx(98)


class State(dict):
    """A map or value state of a store, in memory."""

    exists = lambda self: "value" in self
    update = lambda self, v: self.__setitem__("value", v)
    containsKey = dict.__contains__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = lambda self, k: self.pop(k, None)  # noqa: E731, N815

    def get(self, *key):
        return self["value"]


def test_state_is_bounded_by_the_clients_that_may_be_kept():
    box = limiter.Buckets(2, 1e9, 5, None)
    box.clients, box.order, box.ends = State(), State(), State()
    rng = random.Random(4)
    for k in range(60):
        box.begin()
        for j in range(rng.randrange(1, 9)):
            box.spend(f"u{rng.randrange(40)}", k + j / 10)
        box.keep()
        assert len(box.clients) <= 5 and box.n == len(box.clients)
    # places left behind are dropped when they come to the front
    box.begin()
    while box.forget(None):
        pass
    box.keep()
    assert not box.clients and not box.order and box.n == 0


def test_a_batch_asks_the_store_for_a_client_once():
    class Counted(State):
        calls = 0

        def containsKey(self, key):  # noqa: N802
            Counted.calls += 1
            return key in self

        def getValue(self, key):  # noqa: N802
            Counted.calls += 1
            return self[key]

    # clients that are idle for a window between any two of their requests are forgotten again and again
    box = limiter.Buckets(2, 10.0, 100, None)
    box.clients, box.order, box.ends = Counted(), Counted(), State()
    for start in (0, 1000):
        box.begin()
        for k in range(600):
            assert box.spend(f"u{k % 20}", start + k) == 0
        box.keep()
        assert len(box.clients) == box.n <= 20
    assert Counted.calls < 200
    # and those that stay are asked for once while the front of the order stays
    box = limiter.Buckets(2, 1e9, 100, None)
    box.clients, box.order, box.ends = Counted(), Counted(), State()
    for users in ("ab", "b"):
        box.begin()
        Counted.calls = 0
        for k in range(500):
            box.spend(users[k % len(users)], k / 10)
        box.keep()
    assert Counted.calls < 20


def test_settings_that_make_no_sense_raise(spark):
    rows = spark.createDataFrame([], "user_id string, event_id long, ts timestamp")
    for bad in ({"limit": 0, "window_seconds": 1.0}, {"limit": 1, "window_seconds": 0.0}, {"limit": 1, "window_seconds": 1.0, "most_clients": 3, "shards": 4}):
        with pytest.raises(ValueError):
            limiter.limited(rows, **bad)
