"""The log followed by byte position: appends, torn lines, replacement, and where a client goes on."""

import json
import os

import pytest

from tidemark.operators import eventlog
from tidemark.sources import event_log as el


def line(k, **more):
    return json.dumps({"id": k, "ts": f"2024-01-01T00:00:{k % 60:02}Z", "type": "job.status", "key": f"key-{k}", "data": {"n": k}} | more) + "\n"


class Follower:
    """A stream that is run over what is there and stopped; each run goes on from the last one's offset."""

    def __init__(self, spark, log, place, **options):
        self.spark, self.log, self.place, self.options, self.runs = spark, log, place, options, 0

    def read(self):
        out = []

        def take(batch, _):
            rows = batch.collect()
            out.extend(sorted((r for r in rows), key=lambda r: (r.kind == "event", r.segment or "", r.position or 0)))

        stream = el.tail_log(self.spark, str(self.log), **self.options).writeStream.foreachBatch(take).option("checkpointLocation", str(self.place))
        stream.trigger(availableNow=True).start().awaitTermination()
        return [r.id if r.kind == "event" else r.kind for r in out]


class Reader:
    """The same by the stream reader alone, whose offsets go through JSON as Spark's do."""

    def __init__(self, log, **options):
        self.tail = el.LogTail(str(log), int(options.get("rangeBytes", el.RANGE_BYTES)), options.get("startingId", "earliest"))
        self.at = json.dumps(self.tail.initialOffset())

    def read(self):
        end = json.dumps(self.tail.latestOffset())
        parts = self.tail.partitions(json.loads(self.at), json.loads(end))
        self.at = end
        rows = [r for p in parts for batch in self.tail.read(p) for r in batch.to_pylist()]
        return [r["id"] if r["kind"] == "event" else r["kind"] for r in rows]


@pytest.fixture
def log(tmp_path):
    return tmp_path / "events.jsonl"


def test_appends_torn_lines_and_malformed_ones(spark, log, tmp_path):
    log.write_text(line(1) + line(2))
    tail = Follower(spark, log, tmp_path / "at", rangeBytes=40)
    assert tail.read() == [1, 2]
    assert tail.read() == []
    with log.open("a") as out:
        out.write(line(3) + "not json\n" + line(4, type="other") + line(True) + line(5, key=None) + line(6)[:20])
    assert tail.read() == [3]
    with log.open("a") as out:
        out.write(line(6)[20:] + line(7).rstrip("\n"))
    assert tail.read() == [6]
    with log.open("a") as out:
        out.write("\n")
    assert tail.read() == [7]


@pytest.mark.parametrize("how", ["recreated", "shrunk", "rewritten"])
@pytest.mark.parametrize("streamed", [False, True])
def test_a_replaced_log_is_reset_and_read_from_its_beginning(request, log, tmp_path, how, streamed):
    log.write_text(line(1) + line(2) + line(3))
    tail = Follower(request.getfixturevalue("spark"), log, tmp_path / "at") if streamed else Reader(log)
    assert tail.read() == [1, 2, 3]
    if how == "recreated":
        other = log.with_name("other")
        other.write_text("".join(map(line, range(1, 6))))
        os.replace(other, log)
        expected = [1, 2, 3, 4, 5]
    elif how == "shrunk":
        os.truncate(log, len(line(1)))
        expected = [1]
    else:
        # in place, longer than before: only the first line tells
        with log.open("r+") as out:
            out.write("".join(line(k, ts="later") for k in range(1, 9)))
        expected = list(range(1, 9))
    assert tail.read() == ["reset:log_replaced", *expected]
    assert tail.read() == []


def test_a_log_that_vanishes_and_comes_back(log):
    tail = Reader(log)
    assert tail.read() == []
    log.write_text(line(1))
    assert tail.read() == [1]
    log.unlink()
    assert tail.read() == ["reset:log_replaced"]
    log.write_text(line(1) + line(2))
    assert tail.read() == [1, 2]


@pytest.mark.parametrize(
    ("known", "expected"),
    [("0", [1, 2, 3, 4, 5]), ("2", [3, 4, 5]), (" 4 ", [5]), ("5", []), ("6", ["reset:stale_last_event_id"]), ("9" * 30, ["reset:stale_last_event_id"]), ("x1", ["reset:invalid_last_event_id"]), ("-1", ["reset:invalid_last_event_id"]), ("٣", ["reset:invalid_last_event_id"]), ("latest", []), ("earliest", [1, 2, 3, 4, 5])],
)
def test_where_a_client_goes_on(log, known, expected):
    log.write_text("".join(map(line, range(1, 6))))
    tail = Reader(log, startingId=known)
    assert tail.read() == expected
    with log.open("a") as out:
        out.write(line(6))
    assert tail.read() == [6]


def test_a_client_that_is_too_old(spark, log, tmp_path):
    log.write_text("junk\n" + "".join(map(line, range(10, 15))) + "junk\n")
    assert Follower(spark, log, tmp_path / "a", startingId="5").read() == ["reset:stale_last_event_id"]
    assert Follower(spark, log, tmp_path / "b", startingId="9").read() == [10, 11, 12, 13, 14]
    assert Reader(log, startingId="9", rangeBytes=30).read() == [10, 11, 12, 13, 14]


def test_places_of_ids_are_found_by_bisection(log):
    ids = [3, 4, 9, 10, 11, 40]
    log.write_text("junk\n" + "".join("x" * (7 * k % 50) + "\n" + line(i, data="y" * (i * 13 % 200)) for k, i in enumerate(ids)) + "{\n")
    end = os.path.getsize(log)
    for wanted in range(45):
        at = el.place_after(str(log), end, wanted)
        assert [e[0] for _, text in el.lines(str(log), at, end) if (e := el.parsed(text))] == [i for i in ids if i > wanted]
    assert el.last_id(str(log), end) == 40 and el.last_id(str(log), 0) is None


def test_every_line_belongs_to_one_range(spark, log, tmp_path):
    log.write_text("".join(line(k, data="é" * (k % 7)) for k in range(1, 60)) + line(60)[:10])
    for size in (1, 17, 1000):
        assert sorted(r.id for r in el.read_log(spark, str(log), rangeBytes=size).collect()) == list(range(1, 60))
    assert sorted(r.key for r in eventlog.read_log(spark, f"file://{log}").collect()) == sorted(f"key-{k}" for k in range(1, 60))
    with pytest.raises(ValueError, match="mounted"):
        el.local_path("hdfs://host/log")


def test_segments_of_a_folder(spark, tmp_path):
    events = spark.createDataFrame([(k, "t\"x", "job.status", f"k\\{k}", '{"a": [1, null]}' if k % 2 else None) for k in range(1, 20)], "id long, ts string, type string, key string, data string")
    log = tmp_path / "log"
    el.write_segments(events.where("id < 12"), str(log), 3)
    tail = Follower(spark, log, tmp_path / "at")
    assert sorted(tail.read()) == list(range(1, 12))
    el.write_segments(events.where("id >= 12"), str(log), 2)
    assert sorted(tail.read()) == list(range(12, 20))
    rows = {r.id: r for r in el.read_log(spark, str(log)).collect()}
    assert len(rows) == 19 and rows[3].ts == 't"x' and rows[3].key == "k\\3" and json.loads(rows[3].data) == {"a": [1, None]} and rows[4].data is None
    assert sorted(r.id for r in el.read_log(spark, str(log), startingId="14").collect()) == [15, 16, 17, 18, 19]
