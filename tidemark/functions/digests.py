"""Digests of whole tables: of all values in a row, or as trees.

A tree's leaf covers so many rows, and no task gathers more than a leaf. With at most ``LEAF`` rows a tree is one
leaf, and its digest that of all rows in a row; larger tables have leaves whose digests are digested in turn. How
many levels there are follows from the number of rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import in_order

#: Rows of a leaf, about, and branches of a node above.
LEAF, BRANCHES = 100_000, 16
#: Bytes of joined values that go to the one hash in a row, about.
PIECE = 8192


def levels(n: int, leaf: int = LEAF) -> int:
    """Levels above the leaves: 0 for one leaf."""
    found = 0
    while n > leaf * BRANCHES**found:
        found += 1
    return found


def in_a_row(rows: DataFrame, column: str, separator: str = "", piece: int = PIECE) -> DataFrame:
    """(digest, n_rows) of all sorted values joined into one text, copies repeated, however many there are.

    Values are counted, sorted and joined by ranges. SHA-256 of one text has to see its bytes one after another,
    so one task reads the pieces in order and passes them through a hash; it holds a batch of them at a time.
    """
    apart = separator.encode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        piece_of = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "piece": [b"".join(held)], "n": pa.array([n], pa.int64())})
        for batch in batches:
            for value, copies in zip(batch["_v"].to_pylist(), batch["_n"].to_pylist(), strict=True):
                line = apart + value.encode()
                most = max(1, piece // max(1, len(line)))
                for left in range(copies, 0, -most):
                    more = min(most, left)
                    held.append(line * more)
                    size, n = size + len(line) * more, n + more
                    if size >= piece:
                        yield piece_of()
                        at, held, size, n = at + 1, [], 0, 0
        if n:
            yield piece_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for text, rows in zip(batch["piece"], batch["n"].to_pylist(), strict=True):
                whole.update(memoryview(text.as_buffer())[0 if n else len(apart) :])
                n += rows
        yield pa.RecordBatch.from_pydict({"digest": [whole.hexdigest()], "n_rows": pa.array([n], pa.int64())})

    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.repartitionByRange("_v").sortWithinPartitions("_v").mapInArrow(join, "part int, at long, piece binary, n long")
    found = pieces.repartition(1).sortWithinPartitions("part", "at").select("piece", "n").mapInArrow(digest, "digest string, n_rows long")
    # no values at all may leave no task to run
    return found.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))


def multiset(rows: DataFrame, column: str, separator: str = "", leaf: int = LEAF) -> DataFrame:
    """(digest, n_rows) of the values of a column, whatever their order.

    One leaf joins the sorted values, copies repeated. With several, values are dealt by the first digits of
    their own digests and a leaf names the number of copies instead: one value of very many rows is one line.
    """
    counted = rows.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    n = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    depth = levels(n, leaf)
    sorted_ = F.array_sort(F.collect_list(F.struct("_v", "_n")))
    if not depth:
        repeated = F.flatten(F.transform(sorted_, lambda x: F.array_repeat(x["_v"], x["_n"].cast("int"))))
        return counted.agg(F.sha2(F.array_join(repeated, separator), 256).alias("digest"), F.lit(n).cast("long").alias("n_rows"))
    lines = F.transform(sorted_, lambda x: F.concat(x["_v"], F.lit("\x1e"), x["_n"].cast("string")))
    nodes = counted.groupBy(F.substring(F.sha2("_v", 256), 1, depth).alias("_p")).agg(F.sha2(F.array_join(lines, separator), 256).alias("_h"))
    for level in range(depth - 1, -1, -1):
        below = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: F.concat(x["_p"], x["_h"]))
        nodes = nodes.groupBy(F.substring("_p", 1, level).alias("_p")).agg(F.sha2(F.array_join(below, ""), 256).alias("_h"))
    return nodes.select(F.col("_h").alias("digest"), F.lit(n).cast("long").alias("n_rows"))


def ordered(rows: DataFrame, order: list[str], column: str, leaf: int = LEAF) -> DataFrame:
    """(digest, n_rows) of the values of a column in an order: of leaves of consecutive rows, then of their digests."""
    nodes = in_order(rows.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(column).alias("_h"), F.lit(1).cast("long").alias("_c")), [F.col(f"_o{k}") for k in range(len(order))], "_c")
    nodes = nodes.select(F.col("_before").alias("_at"), "_h")
    n = blocks = nodes.count()
    while True:
        gathered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"])
        joined = F.sha2(F.array_join(gathered, ""), 256).alias("_h")
        if blocks <= leaf:
            return nodes.agg(joined).select(F.col("_h").alias("digest"), F.lit(n).cast("long").alias("n_rows"))
        nodes = nodes.groupBy(F.expr(f"_at div {leaf}").alias("_at")).agg(joined)
        blocks = -(-blocks // leaf)
