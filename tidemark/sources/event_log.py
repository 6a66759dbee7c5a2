"""The JSON-lines event log as a data source, in batch and as a stream that is followed by byte position.

A log is one file or a folder of segments, in order of their names. A stream's offset holds, for each
segment, which file it is (its number on the file system and a digest of its first line) and up to which byte
it was read. Only complete lines are read: what a writer hasn't finished, or a crash has torn off, waits.
If a known segment is gone, is another file or has shrunk, the log was replaced: the stream says so with one
row (kind ``reset:log_replaced``) and reads what is there from its beginning. Work is dealt by ranges of bytes;
a line belongs to the range that it begins in, so a backlog of any length is read in parallel.

A reader can start at the beginning (``startingId`` earliest), at the end (latest) or after an event's id.
Ids ascend within a segment, so the place of an id is found by bisection over bytes. An id that isn't a number, is beyond
the head or whose successor is gone gives one reset row, and the stream goes on from the end.

Lines that can't be parsed, or lack a whole-number id, a known type or a key, are passed over. The log must
be on a file system that the driver and the executors have mounted.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "event_log"
SCHEMA = "kind string, segment string, position bigint, id bigint, ts string, type string, key string, data string"
NAMES = ["kind", "segment", "position", "id", "ts", "type", "key", "data"]
#: Kinds of event; a fixed value.
TYPES = ("signal.issued", "news.ingested", "job.status")
#: Bytes of a task's range, and of a piece that is read while a line break is looked for.
RANGE_BYTES, PIECE = 16 << 20, 1 << 20
ROWS = 4096


def local_path(path: str) -> str:
    """The mounted path; schemes other than file raise."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"an event log is read from a mounted file system, not from {parts.scheme}://")
    return unquote(parts.path) if parts.scheme else path


def segments(path: str) -> dict[str, str]:
    """name -> path of the log's files, in order; names that begin with a dot or an underscore aren't segments."""
    if not os.path.isdir(path):
        return {os.path.basename(path): path} if os.path.exists(path) else {}
    return {name: f"{path}/{name}" for name in sorted(os.listdir(path)) if name[0] not in "._"}


def complete_end(path: str, size: int, floor: int = 0) -> int:
    """The position after the last line break before ``size``; ``floor`` if there is none after it."""
    with open(path, "rb") as file:
        while size > floor:
            start = max(floor, size - PIECE)
            file.seek(start)
            found = file.read(size - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return floor


def identity(path: str, end: int) -> str:
    """Which file this is: its number and, once there is one, its first line."""
    with open(path, "rb") as file:
        number = os.fstat(file.fileno()).st_ino
        first = file.readline(PIECE) if end else b""
    return f"{number}:{hashlib.sha256(first).hexdigest()[:16] if first else ''}"


def another_file(before: str, now: str) -> bool:
    (number, line), (new_number, new_line) = before.split(":"), now.split(":")
    return number != new_number or (line != "" and line != new_line)


def state(path: str) -> dict[str, dict]:
    """segment -> file and end of its complete lines; a segment that vanishes meanwhile isn't there."""
    found = {}
    for name, place in segments(path).items():
        try:
            end = complete_end(place, os.stat(place).st_size)
            found[name] = {"file": identity(place, end), "at": end}
        except FileNotFoundError:
            continue
    return found


def parsed(line: bytes) -> tuple | None:
    """(id, ts, type, key, data) of a line, or None."""
    try:
        event = json.loads(line)
        number, kind, key = event["id"], event["type"], event["key"]
    except (ValueError, KeyError, TypeError):
        return None
    if type(number) is not int or kind not in TYPES or type(key) is not str:
        return None
    data = event.get("data")
    return number, event.get("ts"), kind, key, data if data is None or isinstance(data, str) else json.dumps(data, separators=(",", ":"))


def lines(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in a range of bytes, whole."""
    with open(path, "rb") as file:
        if start:
            # a line that began before belongs to the range before
            file.seek(start - 1)
            if file.read(1) != b"\n":
                file.readline()
        at = file.tell()
        while at < stop:
            line = file.readline()
            if not line.endswith(b"\n"):
                return
            yield at, line
            at += len(line)


def event_from(path: str, start: int, stop: int) -> tuple[int, int] | None:
    """(position after it, id) of the first event that begins at ``start`` or later."""
    for at, line in lines(path, start, stop):
        if (event := parsed(line)) is not None:
            return at + len(line), event[0]
    return None


def last_id(path: str, end: int) -> int | None:
    """The id of the last event before ``end``."""
    while end > 0:
        begin = max(0, end - 1)
        begin = complete_end(path, begin)
        if (found := event_from(path, begin, end)) is not None:
            return found[1]
        end = begin
    return None


def place_after(path: str, end: int, wanted: int) -> int:
    """The position at which events with an id greater than ``wanted`` begin, by bisection."""
    low, high = 0, end
    # before low: ids up to wanted; the first event from high on, if there is one, is greater
    while low < high:
        middle = (low + high) // 2
        found = event_from(path, middle, high)
        if found is None or found[1] > wanted:
            high = middle
        else:
            low = found[0]
    return low


def starting(path: str, after: str) -> dict:
    """The offset to start from: earliest, latest or the id of the last event that is known."""
    now = state(path)
    if after == "earliest":
        return {"segments": {}}
    whole = {"segments": now}
    if after == "latest":
        return whole
    places = segments(path)
    known = [(name, s["at"]) for name, s in now.items() if name in places]
    first = min((f[1] for name, end in known if (f := event_from(places[name], 0, end)) is not None), default=None)
    head = max((i for name, end in known if (i := last_id(places[name], end)) is not None), default=0)
    text = after.strip()
    if not (text.isascii() and text.isdigit()):
        return whole | {"reset": "invalid_last_event_id", "head": head}
    wanted = int(text)
    if wanted > head or (first is not None and wanted < first - 1):
        return whole | {"reset": "stale_last_event_id", "head": head}
    return {"segments": {name: s | {"at": place_after(places[name], s["at"], wanted)} for name, s in now.items() if name in places}}


@dataclass
class Reset(InputPartition):
    why: str
    head: int | None = None


@dataclass
class Range(InputPartition):
    path: str
    segment: str
    file: str
    start: int
    stop: int


def ranges(path: str, start: dict, end: dict, size: int) -> list[InputPartition]:
    """What was added between two offsets; everything, after a reset, if the log was replaced."""
    before, now, out = start.get("segments", {}), end.get("segments", {}), []
    if start.get("reset"):
        out.append(Reset(start["reset"], start.get("head")))
    if any(name not in now or another_file(s["file"], now[name]["file"]) or now[name]["at"] < s["at"] for name, s in before.items()):
        before, out = {}, [Reset("log_replaced")]
    places = segments(path)
    for name in sorted(now):
        begin, stop = before.get(name, {"at": 0})["at"], now[name]["at"]
        if name in places:
            out += [Range(places[name], name, now[name]["file"], a, min(a + size, stop)) for a in range(begin, stop, size)]
    return out


def read_range(part: InputPartition) -> Iterator[pa.RecordBatch]:
    """Rows of a range. A file that has been replaced since has none: the next offset tells of it."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

    if isinstance(part, Reset):
        yield batch([(f"reset:{part.why}", None, None, part.head, None, None, None, None)])
        return
    rows = []
    try:
        if another_file(part.file, identity(part.path, part.stop)):
            return
        for at, line in lines(part.path, part.start, part.stop):
            if (event := parsed(line)) is not None:
                rows.append(("event", part.segment, at, *event))
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
    except FileNotFoundError:
        pass
    if rows:
        yield batch(rows)


class LogReader(DataSourceReader):
    def __init__(self, path: str, size: int, after: str) -> None:
        self.path, self.size, self.after = path, size, after

    def partitions(self) -> list[InputPartition]:
        return ranges(self.path, starting(self.path, self.after), {"segments": state(self.path)}, self.size) or [Range("", "", "0:", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if getattr(partition, "path", True) else iter(())


class LogTail(DataSourceStreamReader):
    def __init__(self, path: str, size: int, after: str) -> None:
        self.path, self.size, self.after = path, size, after

    def initialOffset(self) -> dict:
        return starting(self.path, self.after)

    def latestOffset(self) -> dict:
        return {"segments": state(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(self.path, start, end, self.size)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class EventLog(DataSource):
    """Options: path, startingId (earliest, latest or an id), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def own(self) -> tuple[str, int, str]:
        return local_path(self.options["path"]), int(self.options.get("rangeBytes", RANGE_BYTES)), self.options.get("startingId", "earliest")

    def reader(self, schema) -> DataSourceReader:
        return LogReader(*self.own())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTail(*self.own())


def read_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The log's events so far, and reset rows; (kind, segment, position, id, ts, type, key, data)."""
    spark.dataSource.register(EventLog)
    return spark.read.format(FORMAT).option("path", path).options(**options).load()


def tail_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The log as a stream of events and reset rows."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).option("path", path).options(**options).load()


def write_segments(events: DataFrame, path: str, files: int = 8) -> None:
    """Adds (id, ts, type, key, data) to a log folder as segments of ascending ids; data is JSON text."""
    line = "to_json(named_struct('id', id, 'ts', ts, 'type', type, 'key', key, 'data', parse_json(data)), map('ignoreNullFields', 'false'))"
    events.repartitionByRange(files, "id").sortWithinPartitions("id").selectExpr(f"{line} as value").write.mode("append").text(path)
