"""Benchmark decontamination (operator 10): suffix arrays over the training text, searched by test suffixes.

The documents of a task form shards of about ``SHARD_BYTES``. A shard numbers its words by the
benchmark's vocabulary (0: a word that no item has, or a border between documents) and sorts its
suffixes by their first ``WINDOW`` words; suffixes whose first pairs of words no item has can't be found
by any search and are left out of the array. Every suffix of every test item is then binary-searched;
where its window occurs, the match is followed word by word to its end. That gives the longest verbatim
matches with their places, of which everything else is made: the words that they cover are the hit
ones, the items they belong to are the items of the document, and documents over the limit go.

No text is shuffled. The benchmark is searched for in blocks of at most about ``BLOCK_BYTES``, one at a
time: the driver collects a block, sends it to the executors, and drops it after its pass over all
documents. With one block the pass appends its columns. With more, each pass writes what it found,
narrow rows of the documents with matches only, and the spans of all blocks are united by document. So
neither driver nor workers hold more than a block, however large the benchmark is.

Rule: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a window is 13 consecutive
words of an item, or the whole item if it has fewer but not none; a document word inside any
occurrence of a window is hit; a document with a hit word and 20 * hits >= words is contaminated.

Defined results: null or wordless texts have no words, no hits and aren't contaminated; null or
wordless items have no windows; ids of items that occur several times count once; items without an id
hit as the empty id; an empty benchmark hits nothing; matches never span two documents; of equally
long matches of a document the first place in it, then the smallest item stays; columns named like
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

WINDOW = 13
#: Hit words times this at least as many as words: contaminated.
LIMIT = 20
#: Text of the benchmark that is searched for at a time, and of the documents that a shard takes.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 12 << 20
#: Hashed pairs of words, as a power of two, and matches that are followed at a time.
PAIR_BITS, FOLLOWED = 22, 1 << 20

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def keys_of(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first ``WINDOW`` words of suffixes as byte strings that sort like them; nothing follows a 0."""
    if not len(starts):
        return np.empty(0, f"S{4 * WINDOW}")
    padded = np.append(numbers, np.zeros(WINDOW, np.int64))
    found = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]
    found = np.where(np.cumsum(found == 0, axis=1) > 0, 0, found).astype(">u4")
    return np.ascontiguousarray(found).view(f"S{4 * WINDOW}").ravel()


class TestSet:
    """One block of the benchmark: its words in a row, a 0 between items, and the suffixes to search for."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        numbers, owner, place, size = [0], [-1], [0], [0]
        for name, text in sorted(set(items), key=repr):
            if found := words(text):
                own = min(WINDOW, len(found))
                numbers += [*(self.ids.setdefault(w, len(self.ids) + 1) for w in found), 0]
                owner += [*[len(self.names)] * len(found), -1]
                place += range(len(found) + 1)
                # a window starts here, or no match of its size can
                size += [*[own] * (len(found) - own + 1), *[0] * own]
                self.names.append(name)
        self.numbers, self.owner, self.place = (np.array(x, np.int64) for x in (numbers, owner, place))
        sizes = np.array(size, np.int64)
        self.suffixes = np.flatnonzero(sizes > 0)
        self.size = sizes[self.suffixes]
        self.keys = keys_of(self.numbers, self.suffixes)
        # the greatest key that begins with the window
        ends = self.keys.view(np.uint8).reshape(-1, 4 * WINDOW).copy()
        ends[np.arange(4 * WINDOW)[None] >= 4 * self.size[:, None]] = 255
        self.ends = np.ascontiguousarray(ends).view(f"S{4 * WINDOW}").ravel() if len(ends) else self.keys
        self.shortest = int(self.size.min()) if len(self.size) else 0
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[pair_slots(self.numbers[:-1], self.numbers[1:])[(self.numbers[:-1] > 0) & (self.numbers[1:] > 0)]] = True
        self.single = np.zeros(len(self.ids) + 1, bool)
        self.single[self.numbers[self.suffixes[self.size == 1]]] = True


class Shard:
    """The suffix array of some documents' words."""

    def __init__(self, test: TestSet, numbers: np.ndarray) -> None:
        self.test, self.numbers, n = test, numbers, len(numbers)
        chained = (numbers[:-1] > 0) & (numbers[1:] > 0) & test.pairs[pair_slots(numbers[:-1], numbers[1:])]
        chained = np.append(chained, False)
        ends = np.where(chained, n, np.arange(n))
        run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)
        at = np.flatnonzero(run >= test.shortest - 1) if test.shortest > 1 else np.flatnonzero(chained | test.single[numbers])
        keys = keys_of(numbers, at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], at[order]

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the test set, place in the shard, words) of every longest verbatim match.

        Matches that begin a word earlier in both are parts of another one and left out.
        """
        test, numbers = self.test, self.numbers
        low, high = np.searchsorted(self.keys, test.keys, "left"), np.searchsorted(self.keys, test.ends, "right")
        found = np.flatnonzero(high > low)
        many = high[found] - low[found]
        # as many suffixes at a time as have a bounded number of occurrences together
        for part in np.split(found, np.flatnonzero(np.diff(np.cumsum(many) // FOLLOWED)) + 1) if len(found) else ():
            n = high[part] - low[part]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here = self.starts[np.repeat(low[part], n) + inside]
            there, length = np.repeat(test.suffixes[part], n), np.repeat(test.size[part], n)
            before = np.where(here > 0, numbers[here - 1], 0)
            first = (before == 0) | (before != test.numbers[there - 1])
            here, there, length = here[first], there[first], length[first]
            on = np.arange(len(here))
            while len(on):
                a, b = here[on] + length[on], there[on] + length[on]
                fits = a < len(numbers)
                fits[fits] &= (numbers[a[fits]] == test.numbers[b[fits]]) & (numbers[a[fits]] > 0)
                on = on[fits]
                length[on] += 1
            yield there, here, length


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without overlap that cover the same words."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def numbered_words(test: TestSet, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts by number, a 0 after each text, and where each text starts, with the end."""
    get, numbers, starts = test.ids.get, [], [0]
    for text in texts:
        numbers += [get(w, 0) for w in words(text)]
        numbers.append(0)
        starts.append(len(numbers))
    return np.array(numbers, np.int64), np.array(starts, np.int64)


#: No match: no spans, no items, and the longest match as (words, item, word of the item, word of the document).
NOTHING = ([], [], 0, None, None, None)


def searched(test: TestSet, texts: list[str | None]) -> list[tuple]:
    """For each text: its number of words, hit spans (start, end, start, ...), items and longest match."""
    numbers, starts = numbered_words(test, texts)
    sizes = (np.diff(starts) - 1).tolist()
    out = [(n, *NOTHING) for n in sizes]
    if not len(numbers) or not len(test.suffixes):
        return out
    shard = Shard(test, numbers)
    found = list(shard.matches()) if len(shard.keys) else []
    if not found:
        return out
    there, here, length = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(starts, here, "right") - 1
    order = np.lexsort((test.owner[there], here, -length, doc))
    there, here, length, doc = there[order], here[order], length[order], doc[order]
    cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, item, at = int(doc[a]), int(test.owner[there[a]]), here[a:b] - starts[doc[a]]
        spans = np.stack(united(at, at + length[a:b]), axis=1).ravel().tolist()
        items = sorted({test.names[k] for k in set(test.owner[there[a:b]].tolist())})
        out[own] = (sizes[own], spans, items, int(length[a]), test.names[item], int(test.place[there[a]]), int(at[0]))
    return out


FIELDS = [
    common.field("n_words", T.LongType()),
    common.field("hit_spans", T.ArrayType(T.LongType())),
    common.field("hit_items", T.ArrayType(T.StringType())),
    common.field("longest_match", T.LongType()),
    common.field("longest_item", T.StringType()),
    common.field("longest_item_word", T.LongType()),
    common.field("longest_doc_word", T.LongType()),
]
RESULTS = ["n_words", "n_hit", "hit_items", "contaminated", *[f.name for f in FIELDS[3:]]]


def block_count(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct items with their block, and how many blocks there are."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))), n


def sent(spark: SparkSession, items: DataFrame, block: int):
    """One block's items, on their way to the executors."""
    return spark.sparkContext.broadcast([tuple(r) for r in items.where(F.col("block") == block).select("name", "text").collect()])


def found_in(docs: DataFrame, block, text: str) -> DataFrame:
    """Appends ``FIELDS``: what one block hits."""

    def make():
        test = TestSet(block.value)
        return lambda texts: list(zip(*searched(test, texts), strict=True)) or [[]] * len(FIELDS)

    return common.map_text(docs, make, FIELDS, text, SHARD_BYTES)


def covered(spans: Column) -> Column:
    """How many words the spans (start, end), in ascending order, cover together."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    more = lambda s, x: F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["to"]))
    return F.aggregate(spans, nothing, lambda s, x: F.struct((s["n"] + more(s, x)).alias("n"), F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["n"])


def with_hits(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Appends n_words, n_hit, hit_items (sorted ids), contaminated and the longest match with its places."""
    spark = docs.sparkSession
    items, n = block_count(benchmark, item_id, item_text, block_bytes)
    # the text may be one of the columns that results replace
    plain, (text,) = common.numbered(docs, doc_text)
    names = dict(zip(plain.columns, docs.columns, strict=True))
    pairs = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2, F.lit(2)), lambda k: F.struct(F.get(s, k).alias("start"), F.get(s, k + 1).alias("end")))
    if n == 1:
        made = found_in(plain, sent(spark, items, 0), text)
        made = made.withColumn("_spans", F.when(F.size("hit_spans") > 0, pairs(F.col("hit_spans"))))
    else:
        rows, (text,) = common.located(docs, doc_text)
        passes = []
        for k in range(n):
            block = sent(spark, items, k)
            own = found_in(rows.select("_file", "_row", text), block, text).drop(text)
            passes.append(common.staged(own if k == 0 else own.where(F.size("hit_spans") > 0), "block-hits"))
            block.destroy()
        every = passes[0]
        for more in passes[1:]:
            every = every.unionByName(more)
        best = F.min(F.struct((-F.col("longest_match")).alias("n"), F.col("longest_doc_word").alias("d"), F.col("longest_item").alias("i"), F.col("longest_item_word").alias("w"))).alias("_best")
        spans = F.flatten(F.collect_list(F.when(F.size("hit_spans") > 0, pairs(F.col("hit_spans")))))
        # a document's row for each block at most
        one = every.groupBy("_file", "_row").agg(F.max("n_words").alias("n_words"), F.array_sort(spans).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"), best)
        one = one.select("*", (-F.col("_best.n")).alias("longest_match"), F.col("_best.i").alias("longest_item"), F.col("_best.w").alias("longest_item_word"), F.col("_best.d").alias("longest_doc_word"))
        made = rows.join(one, ["_file", "_row"])
    n_hit = F.coalesce(covered(F.col("_spans")), F.lit(0).cast("long"))
    made = made.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (LIMIT * F.col("n_hit") >= F.col("n_words")))
    kept = [F.col(c).alias(names[c]) for c in plain.columns if names[c].lower() not in RESULTS]
    return made.select(*kept, *RESULTS)


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every test suffix over all shards, with its place.

    One row for each (item, word it starts at) with a match of a window or more; among equally long ones
    the smallest (document, word) stays.
    """
    spark = docs.sparkSession
    items, n = block_count(benchmark, "item_id", "text", block_bytes)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    names = ["item_id", "item_word", "doc_id", "doc_word", "n_words"]

    def searching(block):
        def run(batches):
            test = TestSet(block.value)
            for batch in batches:
                ids, held = (batch.column(k).to_pylist() for k in (0, 1))
                numbers, starts = numbered_words(test, held)
                shard = Shard(test, numbers)
                for there, here, length in shard.matches() if len(shard.keys) else ():
                    # the suffixes inside a match have its rest as their match
                    inside = np.maximum(1, length - WINDOW + 1)
                    step = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
                    there, here, length = (np.repeat(x, inside) for x in (there, here, length))
                    there, here, length = there + step, here + step, length - step
                    doc = np.searchsorted(starts, here, "right") - 1
                    columns = [[test.names[k] for k in test.owner[there]], test.place[there], [ids[k] for k in doc], here - starts[doc], length]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4], strict=True)], names=names)

        return run

    # as in the passes of ``with_hits``
    passes = []
    for k in range(n):
        block = sent(spark, items, k)
        passes.append(common.staged(common.mapped(texts, searching(block), "item_id string, item_word long, doc_id long, doc_word long, n_words long"), "matches"))
        block.destroy()
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("doc"), (-F.col("doc_word")).alias("word")))
    return found.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", (-F.col("b.doc")).alias("doc_id"), (-F.col("b.word")).alias("doc_word"), "b.n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``."""
    plain, (own,) = common.numbered(docs, text)
    marked = with_hits(plain, benchmark, doc_text=own, **options)
    return marked.where(~F.col("contaminated")).select(plain.columns).toDF(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL = {
    "op10_decontamination": r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (
        SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
    found AS (SELECT DISTINCT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
    hits AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(joined, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """
}
