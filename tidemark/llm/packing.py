"""Token-ID output (operator 9): best-fit-decreasing packing with a segment tree over capacities.

Texts become ids of a byte-level vocabulary. Documents longer than a row are split into segments that
keep their place, so nothing is lost; segments of a buffer are taken longest first and each goes to
the open row with the least room that still holds it, which a segment tree over the rooms finds in
log(row length) steps. Each row of the packed matrix comes with cumulative segment lengths and the
positions at which position ids start anew.

Documents are dealt to buckets by a hash of where they are stored (file and row), so the packing doesn't
depend on how the input is split into tasks, a lost task is packed again alike and no bucket is hot,
however often a text or an id repeats. Only ids travel, two bytes each. A bucket is packed in buffers of
at most ``BUFFER`` segments; the rows that a buffer leaves partly empty are the cost. Ids are unsigned
16-bit little-endian numbers, rows are filled up with ``PAD``.

Defined results: null and empty texts have no tokens and appear in no row; repeated rows are packed
each; special strings in a text are ordinary text; a null id is carried as null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_vocab, common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens of a row, and the id that no token has.
ROW, PAD = 2048, 50256
BUFFER = 8192
SCHEMA = "ids binary, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, resets array<int>, n_tokens int"


class Rooms:
    """Which rows have how much room; the least room of at least some size, by descent in a tree."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room >= ``size``, and its room; it is out until put again."""
        at = self.leaves + size
        if not self.count[at]:
            # up to the first right neighbour with a row, then down its left edge
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return row, room


def best_fit_decreasing(sizes: list[int], row: int = ROW) -> list[list[int]]:
    """Numbers of the segments in each row."""
    rooms, packed = Rooms(row), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at, room = rooms.take(sizes[k]) or (len(packed), row)
        if at == len(packed):
            packed.append([])
        packed[at].append(k)
        rooms.put(room - sizes[k], at)
    return packed


def segments(doc_id, ids: np.ndarray, row: int = ROW) -> Iterator[tuple]:
    """(doc_id, offset, ids) of a document's segments, each at most a row long."""
    for at in range(0, len(ids), row):
        yield doc_id, at, ids[at : at + row]


def packed_rows(held: list[tuple], row: int = ROW, pad: int = PAD) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6)]
    for own in best_fit_decreasing([len(s[2]) for s in held], row):
        parts = [held[k] for k in own]
        ends = np.cumsum([0, *(len(p[2]) for p in parts)]).tolist()
        ids = np.full(row, pad, "<u2")
        ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
        for column, value in zip(columns, (ids.tobytes(), [p[0] for p in parts], [p[1] for p in parts], ends, ends[:-1], ends[-1]), strict=True):
            column.append(value)
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["ids", "doc_ids", "doc_offsets", "cu_seqlens", "resets", "n_tokens"])


def encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(docs: DataFrame, path: str | None = None, row: int = ROW, buffer: int = BUFFER) -> DataFrame:
    """The rows of the packed matrix; ``resets`` are the places where position ids start at 0."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe_vocab.read(path or public_tokenizers.path(VOCABULARY)))
    rows, (doc_id, text) = common.located(docs.select("doc_id", "text"), "doc_id", "text")
    n = max(1, -(-rows.count() * 4 // (3 * buffer)))
    place = F.xxhash64("_file", "_row")
    placed = rows.select(F.pmod(place, F.lit(n)).alias("bucket"), place.alias("place"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["bucket", "place", "doc_id", "doc_offset", "ids"]

    def encoded(batches):
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            held = []
            for bucket, at, own, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += [(bucket, at, own, offset, ids.tobytes()) for _, offset, ids in segments(own, np.array(encode(t), "<u2") if t else (), row)]
            columns = list(zip(*held, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.binary()], strict=True)], names=names)

    def run(batches):
        held, current = [], None
        for batch in batches:
            for bucket, _, own, offset, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (bucket != current or len(held) >= buffer):
                    yield packed_rows(held, row)
                    held = []
                current = bucket
                held.append((own, offset, np.frombuffer(ids, "<u2")))
        if held:
            yield packed_rows(held, row)

    dealt = common.mapped(placed, encoded, "bucket long, place long, doc_id long, doc_offset long, ids binary").repartition("bucket")
    return common.mapped(dealt.sortWithinPartitions("bucket", "place", "doc_offset"), run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes the packed matrix, cumulative lengths and resets as Parquet, committed task by task."""
    packed(docs, **options).write.parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, offset, ids) of every segment: what a reader needs to put documents together again."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for ids, docs, offsets, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(d, o, ids[2 * s : 2 * e]) for d, o, s, e in zip(docs, offsets, ends[:-1], ends[1:], strict=True)]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["doc_id", "offset", "ids"])

    return rows.select("ids", "doc_ids", "doc_offsets", "cu_seqlens").mapInArrow(run, "doc_id long, offset long, ids binary")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
