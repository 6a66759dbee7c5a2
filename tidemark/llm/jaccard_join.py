"""N-gram Jaccard join (operator 6): a token-group matrix over groups of similar documents.

Documents are sets of hashed 5-word shingles; two link when |x & y| / |x | y| >= 0.75. The result is the
component of every document, and no link between different components goes unseen:

1. Documents with one and the same set form a class; its smallest id stands for it.
2. Classes that share a min-hash are compared with the smallest of them and a few others, if their
   sketches agree. What the stars that hold connect is a group: similar documents.
3. The token-group matrix has a column for each group, the union of its members' tokens. A query x can
   only link into a group that holds ceil(0.75 |x|) of its tokens, hence one of any |x| - ceil(0.75 |x|)
   + 1 of them; so queries and groups enter the matrix with the first tokens of an order common to all
   documents: by hash, after which come the tokens that very many groups have, rarest first. (Which
   tokens these are changes the work, never the result.) Sets that link share a known number of first
   tokens, not just one; groups that share fewer are never opened. Pairs that only frequent tokens
   could bring up are made only if both begin with enough of them and the parities of their sets don't
   show that they differ too much, so families of documents that are alike but don't link stay cheap.
4. Groups are split into blocks of about ``BLOCK`` members. A query meets the block's token union first;
   if its overlap is below the bound the whole block is passed over, otherwise the block is opened and
   the query compared with each member. One link connects the two groups, which ends their comparison.
   Large groups first try a few members against each other; what is still apart is then compared in full.
5. Components of the links are found by star contraction.

Scale: tokens travel as packed blobs dealt by a hash of the token, one entry for each (token, group) and
task, so copies of one text add nothing; texts are shuffled only for documents that must be compared, in
slices of bounded size. Side tables are broadcast only up to a counted size. The table of frequent
tokens has at most ``FREQUENT`` entries.

Defined results: texts without words have n_shingles 0 and link with nothing, their component is their
own id; a null id has a null component; rows that share an id are one node, linked by any of their
texts; repeated rows get one result each.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.components import connected
from tidemark.llm.shingles import overlap, shingle_set

#: The similarity, as a fraction.
OVER, UNDER = 3, 4
#: Min-hashes of a sketch, those that are grouped by, how many must agree for a comparison, and the centres of stars.
SKETCH, SEEDS, AGREE, LEADERS = 8, 4, 4, 4
BLOCK, SLICE, FIRST_TRY = 64, 256, 8
#: Groups that hold a token, from which it counts as frequent, and the most tokens that do.
HOT, FREQUENT = 8, 1 << 20
#: Tokens of a bucket of the matrix, and tokens that a task holds before it sends them.
BUCKET_TOKENS, HELD_TOKENS = 400_000, 100_000
#: Pairs that a task adds up before it sends them.
HELD_PAIRS = 100_000
#: Groups of a token that are paired in one place; those of a token with more are dealt over a triangle of cells.
CELL = 2048
#: Where the numbers of cells begin, after those of buckets.
CELLS = 1 << 60

MULTIPLIERS = (np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
#: What a token brings to the matrix: a group, its least and most sizes, how many frequent tokens it
#: begins with (``MANY`` for groups of several documents), and whether the token is one of them.
ENTRY = np.dtype([("token", "<u8"), ("group", "<i8"), ("least", "<i4"), ("most", "<i4"), ("held", "<i4"), ("late", "u1")])
MANY = 1 << 30
#: Frequent tokens come with the parities of their set's tokens in so many places as well.
PLACES = 1024
LATE = np.dtype([*ENTRY.descr, ("bits", "<u8", (PLACES // 64,))])
#: How many more groups of a task have a token.
MORE = np.dtype([("token", "<u8"), ("n", "<u4")])
REMIX = np.uint64(0xC2B2AE3D27D4EB4F)


def least_overlap(n: int) -> int:
    return -(-OVER * n // UNDER)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sets link; sets whose sizes rule it out aren't compared."""
    if UNDER * min(len(x), len(y)) < OVER * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and its min-hashes."""

    def make():
        def run(texts: list) -> list[list]:
            sizes, digests, mins = [], [], []
            for text in texts:
                tokens = shingle_set(text)
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                mins.append([int((tokens * m).min().view(np.int64)) for m in MULTIPLIERS] if len(tokens) else None)
            return [sizes, digests, mins]

        return run

    fields = [common.field("n_shingles", T.LongType()), common.field("digest", T.BinaryType()), common.field("mins", T.ArrayType(T.LongType()))]
    return common.map_text(docs.select("doc_id", "text"), make, fields).drop("text")


def star_pairs(classes: DataFrame) -> DataFrame:
    """(g, node): one of a few classes picked for each min-hash, and another whose sketch agrees with its."""
    keyed = classes.select("node", F.posexplode(F.slice("mins", 1, SEEDS)).alias("k", "key"))
    picks = [F.min("node"), *[F.min_by("node", F.xxhash64("node", F.lit(salt))) for salt in range(1, LEADERS)]]
    leaders = keyed.groupBy("k", "key").agg(F.array_distinct(F.array(*picks)).alias("g"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = keyed.join(leaders.select("k", "key", F.explode("g").alias("g")), ["k", "key"]).where("g <> node")
    pairs = pairs.select(F.least("g", "node").alias("g"), F.greatest("g", "node").alias("node")).distinct()
    own = classes.select("node", "n", "mins")
    lead = classes.select(F.col("node").alias("g"), F.col("n").alias("gn"), F.col("mins").alias("gmins"))
    agree = F.aggregate(F.zip_with("mins", "gmins", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = UNDER * F.least("n", "gn") >= OVER * F.greatest("n", "gn")
    return pairs.join(own, "node").join(lead, "g").where(close & (agree >= AGREE)).select("g", "node")


def opened(docs: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """(a, b): groups and the groups of queries that link into them.

    ``members`` (g, block, slice, node) and ``queries`` (g, block, slice, node, own): each slice of a
    block holds a bounded number of both.
    """
    keys = ["g", "block", "slice"]
    members, queries = common.staged(members, "members"), common.staged(queries, "queries")
    ids = common.staged(members.select("node").unionByName(queries.select("node")).distinct(), "nodes")
    side = common.lookup_side(ids, ids.count())
    texts = common.staged(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(side, "node", "left_semi"), "texts")
    rows = (
        members.join(texts, "node")
        .select(*keys, F.lit(0).alias("role"), F.lit(None).cast("long").alias("own"), "text")
        .unionByName(queries.join(texts, "node").select(*keys, F.lit(1).alias("role"), "own", "text"))
    )
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "role")

    def run(batches):
        at, sets, union, linked = None, [], None, set()
        for batch in batches:
            found = []
            g, block, part, role, own, text = (c.to_pylist() for c in batch.columns)
            for k in range(len(g)):
                if (g[k], block[k], part[k]) != at:
                    at, sets, union, linked = (g[k], block[k], part[k]), [], None, set()
                if role[k] == 0:
                    sets.append(shingle_set(text[k]))
                    union = None
                    continue
                if own[k] in linked or not sets:
                    continue
                query = shingle_set(text[k])
                if len(sets) > 1:
                    union = np.unique(np.concatenate(sets)) if union is None else union
                    if overlap(query, union) < least_overlap(len(query)):
                        continue
                if any(similar(query, s) for s in sets):
                    linked.add(own[k])
                    found.append((g[k], own[k]))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return common.staged(common.mapped(ordered, run, "a long, b long"), "found")


def blobs(docs: DataFrame, roles: DataFrame, bits: int, first, entries: bool) -> DataFrame:
    """Tokens of the documents in packed blobs, dealt by a hash: (bucket, entries, late).

    ``first()`` gives a function from a set to the tokens it sends, how many of them, the last, are
    frequent, and over how many slices each frequent one's groups are dealt. With ``entries`` every
    member of a group sends its tokens, each with the group's facts (see ``ENTRY``); without, one member
    of each group sends the upper 32 bits of its tokens within the bucket, each once for all that a task
    holds, and how many more there were of those that several groups have.
    """

    def packed(held: list, facts: list, parities: list):
        tokens, late = np.concatenate(held) * REMIX, np.empty(0, LATE)
        if entries:
            rows = np.zeros(len(tokens), ENTRY)
            rows["token"] = tokens
            sizes = [len(h) for h in held]
            for k, name in enumerate(ENTRY.names[1:-1]):
                rows[name] = np.repeat(np.array([f[k] for f in facts], ENTRY[name]), sizes)
            rows["late"] = np.concatenate([np.arange(n) >= n - f[-1] for n, f in zip(sizes, facts, strict=True)])
            at = np.flatnonzero(rows["late"])
            late = np.zeros(len(at), LATE)
            for name in ENTRY.names:
                late[name] = rows[name][at]
            late["bits"] = np.array(parities, "<u8")[np.repeat(np.arange(len(held)), sizes)[at]]
            slices = np.concatenate([f[-2] for f in facts])[at]
            rows, late = distinct_entries(rows[rows["late"] == 0]), in_cells(late, slices)
        else:
            rows, n = np.unique(tokens, return_counts=True)
            late = np.zeros(int((n > 1).sum()), MORE)
            late["token"], late["n"] = rows[n > 1], n[n > 1] - 1
        sent = rows if entries else (rows >> np.uint64(32 - bits)).astype(np.uint32)
        parts = {}
        if entries:
            # very frequent tokens: a bucket for each cell
            late, cells = late
            order = np.argsort(cells, kind="stable")
            late, cells = late[order], cells[order]
            edges = [*np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist(), len(cells)] if len(cells) else [0]
            dealt, late = late, np.empty(0, LATE)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if cells[start] < 0:
                    late = distinct_entries(dealt[start:end])
                else:
                    parts[int(cells[start])] = [b"", distinct_entries(dealt[start:end]).tobytes()]
        for k, (own, what) in enumerate(((rows["token"] if entries else rows, sent), (late["token"], late))):
            bucket = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(own)] if len(own) else [0]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                parts.setdefault(int(bucket[start]), [b"", b""])[k] = what[start:end].tobytes()
        columns = [pa.array(list(parts), pa.int64()), *[pa.array([v[k] for v in parts.values()], pa.binary()) for k in (0, 1)]]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "entries", "late"])

    def run(batches):
        pick, held, facts, parities, n = first(), [], [], [], 0
        for batch in batches:
            for doc, text, group, skip, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                single = group is None
                group = doc if single else group
                if skip or doc is None or not (entries or group == doc):
                    continue
                tokens = shingle_set(text)
                if not len(tokens):
                    continue
                chosen, late, slices = pick(tokens)
                held.append(chosen)
                # a group's facts hold for all its members, so that they don't depend on who sends a token
                facts.append((group, len(tokens), len(tokens), late, slices, late) if single else (group, least, most, MANY, slices, late))
                parities.append(parity(tokens) if single and late else NO_PARITY)
                n += len(chosen)
                if n >= HELD_TOKENS:
                    yield packed(held, facts, parities)
                    held, facts, parities, n = [], [], [], 0
        if n:
            yield packed(held, facts, parities)

    placed = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(roles, "node", "left").select("node", "text", "comp", "skip", "least", "most")
    return common.mapped(placed, run, "bucket long, entries binary, late binary")


def in_cells(late: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries with the bucket of each (-1: that of the token's hash).

    The groups of a token with s > 1 slices are dealt by hash, and slice x goes to the cells (x, y) for
    all y: two groups of one slice are paired in (x, x), others in the cell of both. A cell has about
    2 ``CELL`` groups at most, however many have the token; its number's last bit tells the two kinds apart.
    """
    kept, cells = [late[slices <= 1]], [np.full(int((slices <= 1).sum()), -1, np.int64)]
    for s in np.unique(slices[slices > 1]).tolist():
        own = late[slices == s]
        x = slice_of(own, s)
        for y in range(s):
            low, high = np.minimum(x, y).astype(np.uint64), np.maximum(x, y).astype(np.uint64)
            mixed = (own["token"] ^ (low << np.uint64(32)) ^ high) * REMIX >> np.uint64(8)
            kept.append(own)
            cells.append(CELLS + 2 * mixed.astype(np.int64) + (low != high))
    return np.concatenate(kept), np.concatenate(cells)


def slice_of(entries: np.ndarray, slices: np.ndarray | int) -> np.ndarray:
    mixed = entries["group"].astype(np.uint64) * REMIX >> np.uint64(33)
    return (mixed % np.asarray(slices, np.uint64)).astype(np.int64)


NO_PARITY = np.zeros(PLACES // 64, "<u8")


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each place, as bits. Two sets differ in at least as many tokens as
    their parities differ in bits."""
    odd = np.bincount((tokens & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1
    return np.packbits(odd.astype(bool)).view("<u8")


def distinct_entries(rows: np.ndarray) -> np.ndarray:
    """One entry for each token and group, in their order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["group"], rows["token"]))]
    return rows[np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["group"][1:] != rows["group"][:-1]))]


def by_bucket(batches):
    """(bucket, its blobs) of rows that come ordered by bucket."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for bucket, own in groupby(rows, lambda r: r[0]):
        own = list(own)
        yield bucket, b"".join(r[1] for r in own), b"".join(r[2] for r in own)


def frequent(docs: DataFrame, roles: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (bucket and 32 bits) that many groups have, ascending, and how many do.

    Tasks add up before they send, so a token that very many groups have brings an entry for each task.
    """

    def first():
        return lambda tokens: (tokens, 0, None)

    def count(batches):
        for bucket, tokens, more in by_bucket(batches):
            kinds, n = np.unique(np.frombuffer(tokens, np.uint32), return_counts=True)
            more = np.frombuffer(more, MORE)
            np.add.at(n, np.searchsorted(kinds, (more["token"] >> np.uint64(32 - bits)).astype(np.uint32)), more["n"])
            many = n >= HOT
            yield pa.RecordBatch.from_arrays([pa.array(kinds[many].astype(np.int64) | (bucket << 32), pa.int64()), pa.array(n[many], pa.int64())], names=["token", "n"])

    dealt = blobs(docs, roles, bits, first, False).repartition("bucket").sortWithinPartitions("bucket")
    top = common.mapped(dealt, count, "token long, n long").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = (np.asarray(top[c].to_numpy(), np.int64) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First tokens that groups share at least if they link, from the least and most sizes of both.

    Sets that link have 3/7 of their summed sizes in common. All but those in both beginnings are in the
    rest of the set whose beginning ends first, which has ceil(0.75 n) - 1 tokens. So for n_x <= n_y at
    least 3 (n_x + n_y) / 7 - 0.75 n_y common tokens are in both beginnings, where n_y is n_x / 0.75 at
    most. That grows with n_x; it falls with n_y by 9/28 a token, but rounded up it also rises in between,
    so the least is taken over the last sizes of the range (roundings are worth less than two tokens, which
    seven sizes outweigh). Sizes that rule a link out give more than can be shared.
    """

    def one(x, y):
        small, least = x["least"].astype(np.int64), y["least"].astype(np.int64)
        large = np.minimum(y["most"].astype(np.int64), small * UNDER // OVER)
        tried = (np.maximum(large - k, np.minimum(least, large)) for k in range(8))
        return np.minimum.reduce([-(-(small + n) * OVER // (OVER + UNDER)) - least_overlap(n) + 1 for n in tried])

    apart = (UNDER * a["most"].astype(np.int64) < OVER * b["least"]) | (UNDER * b["most"].astype(np.int64) < OVER * a["least"])
    return np.where(apart, 2 * MANY, np.maximum(1, np.minimum(one(a, b), one(b, a))))


def offered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of entries a token brings up, and how many shared tokens they must collect.

    Frequent tokens alone can make a pair only if both sets begin with enough of them. Where they can't,
    frequent tokens bring nothing up and all that could be shared is allowed for. Nor do they bring up
    documents whose parities show that they differ in more than a seventh of their summed sizes, which
    no sets that link do.
    """
    need, free = least_shared(a, b), np.minimum(a["held"], b["held"]).astype(np.int64)
    alone = free >= need
    some = need < 2 * MANY
    if "bits" in a.dtype.names:
        some &= alone
        left = np.flatnonzero(some & (a["held"] < MANY) & (b["held"] < MANY))
        for k in range(0, len(left), 1 << 16):
            part = left[k : k + (1 << 16)]
            differ = np.bitwise_count(a["bits"][part] ^ b["bits"][part]).sum(1, dtype=np.int64)
            some[part] = (OVER + UNDER) * differ <= a["most"][part].astype(np.int64) + b["most"][part]
    return some, np.where(alone, need, need - free)


def candidates(docs: DataFrame, roles: DataFrame, bits: int, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(a, b), a < b: groups that share as many first tokens of their members as a link needs."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, counts))

    def first():
        keys, n = sent.value
        seen = np.zeros(1 << 22, bool)
        seen[keys & ((1 << 22) - 1)] = True

        def pick(tokens: np.ndarray) -> tuple[np.ndarray, int]:
            size = len(tokens) - least_overlap(len(tokens)) + 1
            none = np.zeros(size, np.int64)
            if not len(keys):
                return tokens[:size], 0, none
            own = ((tokens * REMIX) >> np.uint64(32 - bits)).astype(np.int64)
            maybe = np.flatnonzero(seen[own & ((1 << 22) - 1)])
            at = np.minimum(np.searchsorted(keys, own[maybe]), len(keys) - 1)
            hit = keys[at] == own[maybe]
            if not hit.any():
                return tokens[:size], 0, none
            late = np.zeros(len(tokens), np.int64)
            late[maybe[hit]] = n[at[hit]]
            order = np.argsort(late, kind="stable")[:size]
            return tokens[order], int((late[order] > 0).sum()), -(-late[order] // CELL)

        return pick

    def counted(held: list):
        a, b, need = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        n = np.diff(np.append(at, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a[at], b[at], n, need[at])], names=["a", "b", "n", "need"])

    def pairs(batches):
        held, n, (keys, numbers) = [], 0, sent.value
        for bucket, *parts in by_bucket(batches):
            for blob, kind in zip(parts, (ENTRY, LATE), strict=True):
                rows = distinct_entries(np.frombuffer(blob, kind))
                rows = rows[can_pair(rows)]
                if bucket >= CELLS and len(rows):
                    at = np.searchsorted(keys, (rows["token"] >> np.uint64(32 - bits)).astype(np.int64))
                    part = slice_of(rows, -(-numbers[at] // CELL))
                starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1])) if len(rows) else np.empty(0, np.int64)
                sizes = np.diff(np.append(starts, len(rows)))
                for size in np.unique(sizes[sizes > 1]).tolist():
                    own = starts[sizes == size]
                    for at in range(1, size):
                        # a token's groups come in ascending order; the later one at a distance of ``at``
                        for k in range(0, len(own), step := max(1, HELD_PAIRS // 10 // (size - at))):
                            place = (own[k : k + step, None] + np.arange(size - at)[None]).ravel()
                            a, b = rows[place], rows[place + at]
                            some, need = offered(a, b)
                            if bucket >= CELLS:
                                some &= (part[place] != part[place + at]) == (bucket & 1 == 1)
                            held.append((a["group"][some], b["group"][some], need[some]))
                            n += int(some.sum())
                            if n >= HELD_PAIRS:
                                yield counted(held)
                                held, n = [], 0
        if n:
            yield counted(held)

    dealt = blobs(docs, roles, bits, first, True).repartition("bucket").sortWithinPartitions("bucket")
    found = common.mapped(dealt, pairs, "a long, b long, n long, need long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    return found.where("n >= need").select("a", "b")


def can_pair(rows: np.ndarray) -> np.ndarray:
    """Entries of frequent tokens that some entry of their token could be paired with.

    Among documents that are groups of their own, one that begins with too few frequent tokens for any
    partner's size pairs with none of them; it stays only if its token has a larger group.
    """
    if not len(rows):
        return np.empty(0, bool)
    new = np.append(True, rows["token"][1:] != rows["token"][:-1])
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    least, most = np.minimum.reduceat(rows["least"], starts)[run], np.maximum.reduceat(rows["most"], starts)[run]
    large = np.logical_or.reduceat(rows["held"] >= MANY, starts)[run]
    any_size = rows.copy()
    any_size["least"], any_size["most"] = least, most
    return (rows["late"] == 0) | large | (rows["held"] >= least_shared(rows, any_size))


def compared(docs: DataFrame, pairs: DataFrame, members: DataFrame, quick: bool) -> DataFrame:
    """Links between the groups of ``pairs`` (g, gsize, own, size); ``quick`` tries some members only."""
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / FIRST_TRY)) == 0
    queries = pairs.join(members.select(F.col("comp").alias("own"), "node"), "own")
    queries = queries.where(spread) if quick else queries
    queries = common.staged(queries.select("g", "gsize", "own", "node"), "asked")
    slices = common.staged(queries.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")), "slices")
    slices = common.lookup_side(slices, slices.count())
    blocks = F.ceil(F.col("gsize") / BLOCK)
    placed = queries.join(slices, "g").select("g", "own", "node", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("block"), F.pmod(F.xxhash64("node"), "slices").alias("slice"))
    places = placed.select("g", "block", "slice").distinct()
    sized = members.join(pairs.select(F.col("g").alias("comp"), "gsize").distinct(), "comp")
    dealt = sized.select(F.col("comp").alias("g"), "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    return opened(docs, dealt.join(places, ["g", "block"]).select("g", "block", "slice", "node"), placed.select("g", "block", "slice", "node", "own"))


def group_links(docs: DataFrame, members: DataFrame, roles: DataFrame, tokens: int) -> DataFrame:
    """(a, b): links between different groups, found through the matrix."""
    bits = max(0, (max(1, tokens) // BUCKET_TOKENS).bit_length())
    hot, counts = frequent(docs, roles, bits)
    stats = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    side = lambda name: stats.select(F.col("comp").alias(name), F.col("size").alias(f"{name}_size"))
    bigger = F.col("a_size") >= F.col("b_size")
    pick = lambda x, y: F.when(bigger, F.col(x)).otherwise(F.col(y))
    pairs = candidates(docs, roles, bits, hot, counts).join(side("a"), "a").join(side("b"), "b")
    pairs = common.staged(pairs.select(pick("a", "b").alias("g"), pick("a_size", "b_size").alias("gsize"), pick("b", "a").alias("own"), pick("b_size", "a_size").alias("size")), "pairs")
    links = compared(docs, pairs, members, quick=True)
    rest = pairs.where(F.col("size") > FIRST_TRY)
    if rest.limit(1).count():
        label = connected(links)
        rest = rest.join(label.select(F.col("node").alias("g"), F.col("label").alias("x")), "g", "left").join(label.select(F.col("node").alias("own"), F.col("label").alias("y")), "own", "left")
        rest = common.staged(rest.where(~F.coalesce(F.col("x"), F.col("g")).eqNullSafe(F.coalesce(F.col("y"), F.col("own")))).select(pairs.columns), "rest")
        if rest.limit(1).count():
            links = links.unionByName(compared(docs, rest, members, quick=False))
    return links


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select("doc_id", "text")
    found = common.staged(signatures(docs).withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")
    real = found.where("digest is not null and doc_id is not null")
    classes = common.staged(real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("mins").alias("mins")), "classes")
    copied = classes.where("copies > 1").select("digest", F.col("node").alias("first"))
    first_of = common.lookup_side(copied, copied.count())
    with common.clearing(docs.sparkSession) as own:
        final = common.kept(own, joined_classes(docs, real, classes, first_of))
    rows = found.join(first_of, "digest", "left").withColumn("node", F.coalesce("first", "doc_id"))
    rows = rows.join(common.lookup_side(final, final.count()), "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("final", "node").alias("component_id"))


def joined_classes(docs: DataFrame, real: DataFrame, classes: DataFrame, first_of: DataFrame) -> DataFrame:
    """(node, final): classes whose component has a smaller id than theirs."""
    # groups: stars around the smallest class of a min-hash
    stars = star_pairs(classes).withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))
    stars = common.staged(stars, "stars")
    many = common.staged(stars.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")), "slices")
    many = common.lookup_side(many, many.count())
    placed = stars.join(many, "g").select("g", F.lit(0).alias("block"), (F.col("slice") % F.col("slices")).alias("slice"), "node", F.col("node").alias("own"))
    links = opened(docs, placed.select("g", "block", "slice", F.col("g").alias("node")).distinct(), placed)
    label = common.staged(connected(links), "groups")

    # every document that isn't a group of its own; copies of a class stay out
    kept_sizes = classes.select("node", "n").join(label, "node").groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    copies = real.join(first_of, "digest").where("doc_id <> first").select(F.col("doc_id").alias("node"), F.lit(None).cast("long").alias("comp"), F.lit(1).alias("skip"), *[F.lit(None).cast("long").alias(c) for c in ("least", "most")])
    kept = label.join(kept_sizes, "label").select("node", F.col("label").alias("comp"), F.lit(0).alias("skip"), "least", "most")
    roles = copies.unionByName(kept).groupBy("node").agg(F.max("comp").alias("comp"), F.min("skip").alias("skip"), F.max("least").alias("least"), F.max("most").alias("most"))
    roles = common.staged(roles, "roles")
    members = common.staged(classes.select("node", "n").join(label, "node", "left").select("node", "n", F.coalesce("label", "node").alias("comp")), "members")
    tokens = real.agg(F.sum("n_shingles")).first()[0] or 0
    more = group_links(docs, members, common.lookup_side(roles, roles.count()), tokens)

    joined = connected(more).select(F.col("node").alias("comp"), F.col("label").alias("final"))
    final = members.join(joined, "comp", "left").select("node", F.coalesce("final", "comp").alias("final")).where("node <> final")
    return common.staged(final, "final")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows whose id is the smallest of their component, with the columns of ``docs``."""
    gone = component_ids(docs).where("component_id <> doc_id").select("doc_id").distinct()
    gone = common.staged(gone.withColumnRenamed("doc_id", "gone"), "gone")
    plain, (doc_id,) = common.numbered(docs, "doc_id")
    left = plain.join(common.lookup_side(gone, gone.count()), plain[doc_id].cast("long") == F.col("gone"), "left_anti")
    return left.toDF(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(common.documents(spark, sf_dir))


QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
