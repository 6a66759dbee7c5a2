"""LM scoring (operator 8): stupid backoff from n-gram count tables partitioned by hash.

Relations, with the columns that are packed into one value marked by *:

* shards (shard, *documents): the documents of a task, about ``SHARD_BYTES`` of text each, compressed;
* exploded (bucket, shard, n, *gram, *count): the n-grams of every order of a shard's documents, equal
  ones added up; the bucket is a range of the gram's hash;
* counts (bucket, n, *gram, *count): the count table of the whole corpus, partitioned by bucket;
* joined (shard, n, bucket, *count): exploded joined to counts on bucket, n and gram, in exploded's order;
* scores (doc_id, ...): shards joined to ``joined`` on the shard and summed per document.

A row for each n-gram occurrence would take several times the text on disk; packed by (bucket, shard, n)
a gram takes what its hash differs from the one before it and a small count, laid out by bytes so that
they compress. A gram travels once for each shard that has it, so no key is hot: a bucket holds a hash
range of grams, and an entry for each shard at most. Shards and buckets are sized from the corpus.

Counts leave out the occurrence that is scored, as the scored texts are the corpus itself:
S(w | context) = (c(context w) - 1) / (c(context) - 1) if the n-gram occurs elsewhere, else ``BACKOFF`` *
S(w | shorter context), down to c(w) / N. A document's score is the sum of ln S over its words. Words are
runs of anything but ASCII white space, with A-Z lower-cased; n-grams don't span documents and are told
apart by 64-bit hashes (two of a billion n-grams collide with a chance of 3 %, which changes the scores
of the texts that hold them).

Defined results: a null text or one without words has 0 words, score 0 and a null mean; repeated rows
count as text of their own and are each scored; a null id is carried; other columns of the input are
left out, whatever their names. The rows of a partition must come in the same order when a lost task is
run again, as rows read from files do: shards are told apart by it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.shingles import grams, word_hashes

#: Words of the longest n-gram and the factor of a backoff.
ORDER, BACKOFF = 3, 0.4
SHARD_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20


def cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the buckets in ascending hashes."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: high bytes, mostly 0, compress to nothing."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def from_planes(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def small(counts: np.ndarray) -> bytes:
    """Counts by bytes, in as few bytes each as the greatest needs; the first byte says how many."""
    kind = np.min_scalar_type(counts.max(initial=0))
    return bytes([kind.itemsize]) + planes(counts.astype(kind))


def from_small(packed: bytes) -> np.ndarray:
    return from_planes(memoryview(packed)[1:], np.dtype(f"u{packed[0]}").type)


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and the number of words of each."""
    words = [word_hashes(t) for t in texts]
    return np.concatenate([np.empty(0, np.uint64), *words]), np.array([len(w) for w in words], np.int64)


def occurrences(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of all texts in a row; a text of k words has k - n + 1, or none."""
    found = grams(words, n)
    # words from each place to the end of its text: grams that run over it are left out
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    return found[left[: len(found)] >= n]


def scores(words: np.ndarray, sizes: np.ndarray, count, total: int, order: int, backoff: float) -> np.ndarray:
    """Sum of ln S of each text; ``count(n)`` gives the corpus counts of its n-grams, in their order."""
    ends = np.cumsum(sizes)
    # how many words of its text stand before each word
    before = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    shorter = count(1)
    logs = np.log(shorter / total) if len(words) else np.empty(0)
    for n in range(2, order + 1):
        own, at = count(n), np.flatnonzero(before >= n - 1)
        # a gram's context is the one that begins with it: all but the last of a text's shorter grams
        context = shorter[np.flatnonzero(before[before >= n - 2] < np.repeat(sizes, np.maximum(0, sizes - n + 2)) - 1)]
        seen = own > 1
        longer = np.full(len(at), np.log(backoff)) + logs[at]
        longer[seen] = np.log((own[seen] - 1) / (context[seen] - 1))
        logs[at] = longer
        shorter = own
    return np.add.reduceat(np.append(logs, 0.0), ends - sizes) * (sizes > 0) if len(sizes) else np.empty(0)


def with_lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score; the corpus is ``docs`` itself."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about a word in six bytes, and eight bytes for an n-gram of each order
    bits = max(0, (size * order * 9 // 6 // bucket_bytes).bit_length())

    def sharded(batches):
        """Rows of a task in shards that its number and their order tell apart."""
        ids, texts, held, made = [], [], 0, 0

        def shard():
            packed = zstandard.ZstdCompressor(3).compress(pickle.dumps((ids, texts)))
            number = TaskContext.get().partitionId() << 32 | made
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed], pa.binary())], names=["shard", "documents"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= shard_bytes:
                    yield shard()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield shard()

    def unpacked(packed: bytes) -> tuple[list, list]:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))

    def explode(shards: pa.Table) -> pa.Table:
        rows = []
        for shard, packed in zip(*(shards[c].to_pylist() for c in ("shard", "documents")), strict=True):
            words, sizes = hashed(unpacked(packed)[1])
            for n in range(1, order + 1):
                kinds, counts = np.unique(occurrences(words, sizes, n), return_counts=True)
                edges = cuts(kinds, bits)
                for bucket in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[bucket], edges[bucket + 1])
                    rows.append((bucket, shard, n, planes(np.diff(kinds[part], prepend=np.uint64(0))), small(counts[part])))
            # the number of all words is looked up as the gram of no words
            rows.append((0, shard, 0, planes(np.zeros(1, np.uint64)), small(np.array([len(words)]))))
            del words, sizes, kinds, counts
        common.give_back()
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "shard", "n", "grams", "counts"])

    def count_and_join(exploded: pa.Table) -> pa.Table:
        """One bucket: its part of the count table, made of all shards' grams and joined to each of them."""
        ns, rows = np.array(exploded["n"].to_pylist()), []
        for n in np.unique(ns).tolist():
            own = exploded.filter(pa.array(ns == n))
            asked = [np.cumsum(from_planes(g, np.uint64), dtype=np.uint64) for g in own["grams"].to_pylist()]
            borders = np.cumsum([0, *map(len, asked)])
            table, place = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(place, np.concatenate([from_small(c) for c in own["counts"].to_pylist()]), len(table)).astype(np.uint64)
            joined = counts[place]
            rows += [(shard, n, bucket, small(joined[a:b])) for shard, bucket, a, b in zip(own["shard"].to_pylist(), own["bucket"].to_pylist(), borders[:-1], borders[1:], strict=True)]
        common.give_back()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["shard", "n", "bucket", "counts"])

    def add_up(shards: pa.Table, joined: pa.Table) -> pa.Table:
        found = [[], [], []]
        for packed in shards["documents"].to_pylist():
            ids, texts = unpacked(packed)
            words, sizes = hashed(texts)
            del texts

            def parts(n: int) -> list[np.ndarray]:
                own = joined.filter(pc.equal(joined["n"], n)).sort_by("bucket")
                return [from_small(c.as_py()) for c in own["counts"]]

            def count(n: int) -> np.ndarray:
                kinds, place = np.unique(occurrences(words, sizes, n), return_inverse=True)  # noqa: B023
                del kinds
                return np.concatenate([np.empty(0, np.uint8), *parts(n)])[place].astype(np.float64)  # noqa: B023

            total = int(parts(0)[0][0])
            found[0] += ids
            found[1] += sizes.tolist()
            found[2] += scores(words, sizes, count, total, order, backoff).tolist()
        common.give_back()
        return pa.table([pa.array(c, t) for c, t in zip(found, [pa.int64(), pa.int64(), pa.float64()], strict=True)], names=["doc_id", "n_words", "log_score"])

    # both uses read one exchange of the shards
    shards = common.mapped(docs, sharded, "shard long, documents binary")
    exploded = shards.groupBy("shard").applyInArrow(explode, "bucket long, shard long, n int, grams binary, counts binary")
    joined = exploded.groupBy("bucket").applyInArrow(count_and_join, "shard long, n int, bucket long, counts binary")
    scored = shards.groupBy("shard").cogroup(joined.groupBy("shard")).applyInArrow(add_up, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_lm_scores(common.documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


QUERIES = {"op8_lm_scores": op8_lm_scores}
ORACLE_SQL = {
    "op8_lm_scores": r"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    u AS (SELECT r, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev, CASE WHEN i > 2 THEN w[i - 2] END AS prior FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    one AS (SELECT word, count(*) AS c FROM u GROUP BY word),
    two AS (SELECT prev, word, count(*) AS c FROM u WHERE prev IS NOT NULL GROUP BY prev, word),
    three AS (SELECT prior, prev, word, count(*) AS c FROM u WHERE prior IS NOT NULL GROUP BY prior, prev, word),
    s AS (
        SELECT u.r, CASE WHEN three.c > 1 THEN ln((three.c - 1) / (context.c - 1))
                         ELSE CASE WHEN three.c IS NOT NULL THEN ln(CAST(0.4 AS DOUBLE)) ELSE 0 END
                            + CASE WHEN two.c > 1 THEN ln((two.c - 1) / (p.c - 1))
                                   ELSE CASE WHEN two.c IS NOT NULL THEN ln(CAST(0.4 AS DOUBLE)) ELSE 0 END + ln(one.c / (SELECT count(*) FROM u)) END END AS x
        FROM u JOIN one ON u.word = one.word LEFT JOIN two ON u.prev = two.prev AND u.word = two.word LEFT JOIN one p ON u.prev = p.word
             LEFT JOIN three ON u.prior = three.prior AND u.prev = three.prev AND u.word = three.word LEFT JOIN two context ON u.prior = context.prev AND u.prev = context.word),
    t AS (SELECT r, sum(x) AS log_score FROM s GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(log_score, 0), 4) AS log_score,
           round(CASE WHEN len(w) > 0 THEN log_score / len(w) END, 6) AS mean_log_score
    FROM d LEFT JOIN t USING (r)
    """
}
