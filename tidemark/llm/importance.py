"""Target-distribution importance resampling (operator 12): array-scored weights, runs and tournament trees.

Features are runs of one to three words, hashed into buckets. What a bucket tells for the target is the log
ratio of its shares in target and raw texts: one array of gains, by which a document's features are looked
up and added up. A keyed Gumbel number on top makes the best scores a draw without replacement.

The crc of a run is put together from those of its words: appending bytes is linear over bits, so the crc
so far moves on by the length of the word, four table lookups for a whole array of runs, and takes the
word's own crc. No run of words is ever built.

The draw: each task sorts the eligible rows that it has into runs, cuts them at common edges into blocks
and writes them. Edges are score quantiles (and, within a score of very many rows, quantiles of ids), so
they only set how the work is dealt; the rows of a range are counted exactly, which gives each range the
rank that it begins at. Ranges that begin beyond the number of draws are not merged. The others are each
merged by one task from their blocks, which come in order of their first keys: a block is opened when its
first key is due, a tournament tree over the open runs gives the next row, and the tree stops at the exact
number of draws.

Scale: two passes over the texts (counts, then scores); buckets are added up within a task and before the
shuffle; the 10,000 sums are all that goes to the driver, with the counts of ranges (of ``RANGES`` quantiles at
most). A merging task holds one block of each run that is open at a time. No row meets another by id, so
nothing is joined back.

Defined results: null texts have no words, no features and weight 0; equal scores are drawn by smaller id, a
null id last; rows that repeat id, score and number of features are interchangeable and get ranks of their
own; a null id hashes as if empty. Empty tables: no raw features and no target features give every bucket the
gain of the formula; no documents give no rows. Columns named like the results are replaced, others are carried by
``weighted`` and pruned by ``resampled``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

ORDER = 3
BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
#: Share of the eligible documents that is drawn, in hundredths.
PERCENT = 5
#: Drawn rows of a range, rows of a run and of a block; how many quantiles cut ranges at most.
RANGE_ROWS, RUN_ROWS, BLOCK_ROWS, RANGES = 1 << 13, 1 << 20, 4096, 4096
#: Ranges are cut in the best scores only: so many times the share that is drawn.
MARGIN = 1.05

#: Bytes of no word become blanks, A-Z become small.
_CLEAN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320
#: Words longer than this are moved over by zlib's own routine for each run.
_LONGEST = 64


def _forward(length: int) -> np.ndarray:
    """Tables for each of the four bytes of a crc: what it is once ``length`` zero bytes have followed."""
    bits = 1 << np.arange(32, dtype=np.uint64)
    for _ in range(8 * length):
        bits = (bits >> np.uint64(1)) ^ np.where(bits & np.uint64(1), np.uint64(_POLYNOMIAL), np.uint64(0))
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            tables[k][(np.arange(256) >> b & 1) == 1] ^= np.uint32(bits[8 * k + b])
    return tables


class Runs:
    """Buckets of the features of texts; one for each task."""

    def __init__(self, order: int = ORDER, buckets: int = BUCKETS) -> None:
        self.order, self.buckets = order, buckets
        self.forward = np.stack([_forward(n) for n in range(_LONGEST + 2)])
        #: word -> its length and crc, in one number.
        self.words = common.Memory(lambda w: len(w) << 32 | zlib.crc32(w), 16 << 20)

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        t = self.forward
        return t[by, 0, crc & 255] ^ t[by, 1, crc >> 8 & 255] ^ t[by, 2, crc >> 16 & 255] ^ t[by, 3, crc >> 24]

    def of(self, text: bytes | None) -> tuple[int, list[np.ndarray]]:
        """Number of words, and for each length of run the buckets of all runs, in order."""
        words = text.translate(_CLEAN).split() if text else []
        known = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        lengths, crc = known >> 32, (known & 0xFFFFFFFF).astype(np.uint32)
        if len(words) and lengths.max() > _LONGEST:
            return len(words), [self.plain(words, n) for n in range(1, self.order + 1)]
        # with the blank before it
        follows = crc ^ self.moved(np.full(len(words), zlib.crc32(b" "), np.uint32), lengths)
        found, run = [crc], crc
        for n in range(1, self.order):
            run = self.moved(run[:-1], lengths[n:] + 1) ^ follows[n:]
            found.append(run)
        return len(words), [(x % np.uint32(self.buckets)).astype(np.int64) for x in found]

    def plain(self, words: list[bytes], n: int) -> np.ndarray:
        runs = (b" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
        return np.fromiter((zlib.crc32(r) % self.buckets for r in runs), np.int64, max(0, len(words) - n + 1))


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, sums = Runs(order, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for found in runs.of(value.as_py())[1]:
                    sums += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    rows = common.mapped(docs.select(docs[text].cast("binary").alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        sums[bucket] = n
    return sums


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the log of its share in the target over that in raw texts, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """1000 times a Gumbel number that belongs to the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score."""
    new = ["n_words", "n_features", "weight", "score"]
    plain, (t, i) = common.numbered(docs, text, doc_id)
    own = plain.select("*", F.col(t).cast("binary").alias("text_in"), F.col(i).cast("string").alias("id_in"))
    kept = [f for f, name in zip(plain.schema.fields, docs.columns, strict=True) if name.lower() not in new]
    names, before = [f.name for f in kept], [name for name in docs.columns if name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(order, len(gain))
        for batch in batches:
            found = []
            for value, i in zip(batch.column("text_in"), batch.column("id_in").to_pylist(), strict=True):
                n, buckets = runs.of(value.as_py())
                weight = sum(int(gain[b].sum()) for b in buckets)
                found.append((n, sum(map(len, buckets)), weight, weight + noise(i, seed)))
            arrays = [batch.column(x) for x in names] + [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + new)

    return common.mapped(own, run, T.StructType(kept + [common.field(x, T.LongType()) for x in new])).toDF(*before, *new)


class Tournament:
    """The least head of several sorted sources, by a tree of their matches; sources join while it runs."""

    def __init__(self) -> None:
        self.size, self.sources, self.tree, self.free = 1, [None], [None, None], [0]

    def head(self, place: int) -> tuple | None:
        return self.sources[place][0] if self.sources[place] else None

    def play(self, place: int) -> None:
        """Plays the matches from a leaf to the root; a node holds the place of its winner."""
        node = place + self.size
        self.tree[node] = place if self.sources[place] else None
        while node > 1:
            node >>= 1
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = b if a is None or (b is not None and self.head(b) < self.head(a)) else a

    def grow(self) -> None:
        self.sources += [None] * self.size
        self.free += range(self.size, 2 * self.size)
        self.size *= 2
        self.tree = [None] * (2 * self.size)
        for place in range(self.size):
            self.tree[place + self.size] = place if self.sources[place] else None
        for node in range(self.size - 1, 0, -1):
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = b if a is None or (b is not None and self.head(b) < self.head(a)) else a

    def join(self, rows: Iterator[tuple]) -> None:
        """Takes in a sorted source."""
        first = next(rows, None)
        if first is None:
            return
        if not self.free:
            self.grow()
        place = self.free.pop()
        self.sources[place] = (first, rows)
        self.play(place)

    def least(self) -> tuple | None:
        return None if self.tree[1] is None else self.head(self.tree[1])

    def pop(self) -> tuple:
        place = self.tree[1]
        row, rows = self.sources[place]
        after = next(rows, None)
        self.sources[place] = None if after is None else (after, rows)
        if after is None:
            self.free.append(place)
        self.play(place)
        return row


#: What a row of a run holds; rows are ordered by all of it. ``id`` comes after ``no_id``, which is 1 for null ids.
_RUN = ["down", "no_id", "id", "n_features", "weight"]
_PACKED = np.dtype([(x, "<i8") for x in _RUN])


class Edges:
    """Ranges of the order: between score quantiles, a quantile itself, and by ids where one score has several quantiles."""

    def __init__(self, scores: list[int], ids: list[int]) -> None:
        down, times = np.unique(-np.asarray(scores, np.int64), return_counts=True)
        self.down, self.times, self.ids = down, times, np.unique(np.asarray(ids, np.int64))
        self.wide = len(self.ids) + 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The range of each row; ascending with the order of rows."""
        if not len(self.down):
            return np.zeros(len(rows), np.int64)
        at = np.searchsorted(self.down, rows["down"])
        inside = np.minimum(at, len(self.down) - 1)
        same = (self.down[inside] == rows["down"]) & (at < len(self.down))
        part = np.where(rows["no_id"] == 1, self.wide - 1, np.searchsorted(self.ids, rows["id"]))
        return (2 * at + same) * self.wide + np.where(same & (self.times[inside] > 1), part, 0)


def sorted_runs(rows: DataFrame, edges: Edges, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the sorted runs of each task: range, first key (``down``, ``no_id``, ``id``), number of rows and the rows."""

    def blocks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        run = np.sort(np.concatenate(held), order=_RUN)
        of = edges.of(run)
        cuts = np.flatnonzero(np.diff(of)) + 1
        starts = sorted({0, *cuts.tolist(), *(x for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True) for x in range(int(a), int(b), block_rows))})
        out = [(int(of[a]), int(run["down"][a]), int(run["no_id"][a]), int(run["id"][a]), b - a, run[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
        for k in range(0, len(out), 16):
            yield pa.RecordBatch.from_pylist([dict(zip(("range", "down", "no_id", "id", "n", "rows"), x, strict=True)) for x in out[k : k + 16]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            part = np.empty(batch.num_rows, _PACKED)
            for k, name in enumerate(_RUN):
                part[name] = batch.column(k).to_numpy(zero_copy_only=False)
            held.append(part)
            n += len(part)
            if n >= run_rows:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    keys = [(-F.col("score")).alias("down"), F.col("id").isNull().cast("long").alias("no_id"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "n_features", "weight"]
    return common.mapped(rows.select(*keys), run, "range long, down long, no_id long, id long, n long, rows binary")


_RESULT = "id long, n_features long, weight long, score long, rank long"


def _result(rows: np.ndarray, ranks: list) -> pa.RecordBatch:
    ids = pa.array(rows["id"], mask=rows["no_id"] == 1)
    columns = [ids, pa.array(rows["n_features"]), pa.array(rows["weight"]), pa.array(-rows["down"]), pa.array(ranks, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_features", "weight", "score", "rank"])


def merged(blocks: DataFrame, begins: dict[int, int], draws: int) -> DataFrame:
    """Ranks the rows of ranges from blocks in order of range and first key; ``begins``: rows before a range.

    Rows beyond the number of draws have no rank.
    """

    def unpacked(packed: bytes) -> Iterator[tuple]:
        return iter(np.frombuffer(packed, _PACKED).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out, ranks = Tournament(), [], []
        rank, now = 0, None

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                yield _result(np.array(out, _PACKED), ranks)
                out.clear()
                ranks.clear()

        def give(until: tuple | None) -> Iterator[pa.RecordBatch]:
            """The rows before a key, or all that are open."""
            nonlocal rank
            while (row := tree.least()) is not None and (until is None or row[:3] < until):
                if rank >= draws:
                    break
                rank += 1
                out.append(tree.pop())
                ranks.append(rank)
                if len(out) >= BLOCK_ROWS:
                    yield from emit(0)
            if rank >= draws:
                # the draw is complete: what is open goes as it is
                for source in tree.sources:
                    if source:
                        for row in (source[0], *source[1]):
                            out.append(row)
                            ranks.append(None)
                        yield from emit(BLOCK_ROWS)
                tree.__init__()

        for batch in batches:
            for block in batch.to_pylist():
                if block["range"] != now:
                    yield from give(None)
                    rank, now = begins[block["range"]], block["range"]
                yield from give((block["down"], block["no_id"], block["id"]))
                tree.join(unpacked(block["rows"]))
        yield from give(None)
        yield from emit(0)

    tasks = max(1, min(len(begins), 4096))
    dealt = blocks.repartition(tasks, "range").sortWithinPartitions("range", "down", "no_id", "id")
    return common.mapped(dealt, run, _RESULT)


def unranked(blocks: DataFrame) -> DataFrame:
    """The rows of blocks, without rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("rows"):
                rows = np.frombuffer(packed.as_py(), _PACKED)
                yield _result(rows, [None] * len(rows))

    return common.mapped(blocks.select("rows"), run, _RESULT)


def resampled(scored: DataFrame, eligible: Column, percent: int = PERCENT, doc_id: str = "doc_id", range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows; of the eligible ones the best ``percent`` in a hundred are drawn."""
    narrow = common.staged(scored.select(F.col(doc_id).cast("long").alias("id"), "n_features", "weight", "score", F.coalesce(eligible, F.lit(False)).alias("may")), "scored")
    rows = narrow.where("may")
    n = rows.count()
    draws = percent * n // 100
    edges = Edges([], [])
    if draws:
        cuts = min(RANGES, draws // range_rows + 1)
        best = [1 - min(1, MARGIN * percent / 100) * (k + 1) / cuts for k in range(cuts)]
        even = [(k + 1) / (cuts + 1) for k in range(cuts)]
        found = rows.agg(F.percentile_approx("score", best, 10 * RANGES).alias("s"), F.percentile_approx("id", even, 10 * RANGES).alias("i")).first()
        edges = Edges(found.s, found.i or [])
    blocks = common.staged(sorted_runs(rows, edges, run_rows, block_rows), "runs")
    begins, before = {}, 0
    for at, size in blocks.groupBy("range").agg(F.sum("n")).orderBy("range").collect():
        if before < draws:
            begins[at], last = before, at
        before += size
    if not begins:
        drawn = unranked(blocks)
    else:
        drawn = merged(blocks.where(F.col("range") <= last), begins, draws).unionByName(unranked(blocks.where(F.col("range") > last)))
    rest = narrow.where("NOT may").select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", doc_id)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    gain = gains(bucket_counts(docs), bucket_counts(common.table(spark, sf_dir, "benchmark")))
    return resampled(weighted(docs, gain).drop("text"), F.col("n_words") >= LEAST_WORDS)


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLE_SQL = {
    "op12_importance_resampling": r"""
    WITH RECURSIVE
    bits(byte, c, k) AS (
        SELECT b, CAST(b AS UBIGINT), 0 FROM range(256) AS t(b)
        UNION ALL
        SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE k = 8),
    texts AS (
        SELECT 'raw' AS side, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT 'target', CAST(item_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    features AS (
        SELECT side, id, array_to_string(w[i : i + n - 1], ' ') AS f
        FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
    counted AS (SELECT side, id, f, count(*) AS c FROM features GROUP BY ALL),
    hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
    buckets AS (
        SELECT f, xor(list_reduce(
            list_transform(range(1, len(h), 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS UBIGINT)),
            lambda c, b: xor(c // 256, steps[CAST(xor(c % 256, b) AS BIGINT) + 1]),
            CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
        FROM hexed, crc),
    held AS (SELECT side, id, bucket, sum(c) AS c FROM counted JOIN buckets USING (f) GROUP BY ALL),
    sides AS (SELECT bucket, sum(CASE WHEN side = 'raw' THEN c ELSE 0 END) AS s, sum(CASE WHEN side = 'target' THEN c ELSE 0 END) AS t FROM held GROUP BY bucket),
    sums AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM sides),
    gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sides, sums),
    weights AS (SELECT id, sum(c * gain) AS weight, sum(c) AS n FROM held JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY id),
    scores AS (
        SELECT d.doc_id, len(x.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) AS BIGINT)
               + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
        FROM documents d JOIN texts x ON x.side = 'raw' AND x.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN weights ON weights.id = x.id),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible FROM scores)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * eligible // 100 THEN CAST(r AS BIGINT) END AS rank FROM ranked
    """
}
