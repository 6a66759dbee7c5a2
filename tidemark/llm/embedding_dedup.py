"""Embedding near-dedup (operator 11): randomised-rotation binary codes decide which pairs are computed exactly.

A unit vector o is rotated by a random orthogonal matrix and kept as the signs of its coordinates with the
correction factor f = <o', o>, where o' is the unit vector of the signs. <o', q> / f estimates <o, q> for any q
without bias and is off by more than EPSILON x sqrt((1 - f^2) / (f^2 (d - 1))) with a vanishing chance. A pair
whose upper bound lies below the threshold is never computed; all others are, in double precision.

Which pairs are estimated: vectors meet in buckets, whose keys are disjoint pieces of the signs of further
rotations. A vector is in the four buckets that its two least certain signs allow in each table. The number of
signs follows the number of rows, so a bucket holds about one vector by chance at every size; the number of
tables follows from that, so that a pair just at the threshold meets with chance ``RECALL``. This is measured,
not assumed: ``match_rate`` draws pairs. Buckets of very many different balls are dealt by further signs.

Groups of copies never become pairs. Every vector looks at the first vector of each of its buckets and, if
one is within half the threshold's angle, joins the ball around the first of them. By the triangle inequality
all vectors of a ball are linked. Balls then meet instead of vectors: from the exact angle of two centres and
the radii, either all of their pairs are linked, or none, or the balls are opened and compared slice by slice,
where links are counted and not emitted.

Scale: everything is joined by id or key; rows are ids, codes of a few words and a factor; a hot centre or
bucket is on one side of joins whose other side the adaptive planner splits. Opening two balls costs the
product of their sizes in multiplications, for slices that the tasks get in pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor
do vectors of different lengths; rows that repeat an id are vectors of their own; the component of vectors whose
ids are all null is null, and they are kept. An empty table gives an empty result. Only the id and the vector
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import connected

THRESHOLD = 0.95
#: Width of the confidence bounds, in the estimate's own unit.
EPSILON = 3.0
#: Width of the bound on differing signs, in standard deviations.
SIGMAS = 4.0
#: Chance that a pair at the threshold meets in some bucket, for each level of buckets.
RECALL = 0.98
SEED = 11
#: Different balls of a bucket above which it is dealt by further signs; levels of that.
HOT, LEVELS = 1024, 4
#: About so many vectors are a slice of an opened ball.
SLICE = 256
#: Angles are taken to be known to this.
SLACK = 1e-7


def width(dims: int) -> int:
    return max(64, -(-dims // 64) * 64)


@lru_cache(maxsize=64)
def rotation(dims: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix for vectors of ``dims`` components, which are padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, number]).standard_normal((width(dims), width(dims))))
    return (q * np.sign(np.diag(r)))[:, :dims]


@lru_cache(maxsize=256)
def match_rate(bits: int, cosine: float, dims: int, draws: int = 8192) -> float:
    """The chance that two vectors with this cosine share a bucket of one table, from drawn pairs."""
    d = width(dims)
    rng = np.random.default_rng([SEED, bits, d])
    a, z = rng.standard_normal((2, draws, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(1)[:, None] * a
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.linalg.norm(z, axis=1)[:, None]
    pad = -(-bits // d)
    if pad > 1:
        a, b = (np.concatenate([x, *(x @ rotation(d, 1000 + k).T for k in range(pad - 1))], 1) for x in (a, b))
    open_a, open_b = (np.argsort(np.abs(x[:, :bits]), 1)[:, :2] for x in (a, b))
    differ = (a[:, :bits] > 0) != (b[:, :bits] > 0)
    np.put_along_axis(differ, open_a, False, 1)
    np.put_along_axis(differ, open_b, False, 1)
    return float((~differ.any(1)).mean())


def layout(rows: int, cosine: float, dims: int, recall: float = RECALL) -> tuple[int, int]:
    """Signs of a key and number of tables for so many rows."""
    bits = min(60, max(4, math.ceil(math.log2(max(rows, 2))) + 2))
    rate = min(match_rate(bits, cosine, dims), 0.999)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(rate, 1e-6))))


def by_length(raw: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors in double precision) for each length of vectors."""
    values = raw.to_pylist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        found = np.frombuffer(b"".join([values[k] for k in at]), kind).reshape(len(at), -1).astype(np.float64)
        found /= np.abs(found).max(1)[:, None]
        yield at, found / np.linalg.norm(found, axis=1)[:, None]


def lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.reshape(-1)))


def coded(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """(v, vec_id, raw, code, factor) of every row, v numbers the rows; raw is null where nothing can be linked."""
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("v"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            whole = [None if not x.is_valid or not len(x) or x.values.null_count else x.values.to_numpy(zero_copy_only=False) for x in e]
            fine = [x is not None and bool(np.isfinite(x).all()) and bool(x.any()) for x in whole]
            raw = pa.array([x.astype(kind).tobytes() if ok else None for x, ok in zip(whole, fine, strict=True)], pa.binary())
            codes, factors = [None] * len(whole), np.zeros(len(whole))
            held = np.flatnonzero(fine)
            for at, unit in by_length(raw.filter(pa.array(fine)), kind):
                turned = unit @ rotation(unit.shape[1], 0).T
                packed = np.packbits(turned > 0, axis=1, bitorder="little").view("<i8")
                for k, code in zip(held[at], packed, strict=True):
                    codes[k] = code
                factors[held[at]] = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("vec_id"), raw, pa.array(codes, pa.list_(pa.int64())), pa.array(factors)], names=["v", "vec_id", "raw", "code", "factor"])

    return common.mapped(rows, run, "v long, vec_id long, raw binary, code array<bigint>, factor double"), kind


def estimates(code: np.ndarray, factor: np.ndarray, query: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors with raw ones, row by row, and their confidence bounds."""
    d = width(query.shape[1])
    signs = np.unpackbits(np.ascontiguousarray(code, "<i8").view(np.uint8), axis=1, bitorder="little") * 2.0 - 1
    found = (signs * (query @ rotation(query.shape[1], 0).T)).sum(1) / (math.sqrt(d) * factor)
    return found, epsilon * np.sqrt(np.maximum(0, 1 - factor * factor) / (factor * factor * (d - 1)))


def keyed(rows: DataFrame, kind: str, bits: int, tables: int, level: int, carried: list[str], within: str | None = None) -> DataFrame:
    """Rows (key, carried columns): the four buckets of each table that a vector is in. ``within``: a key that is dealt further."""
    extra = [within] if within else []
    # numbers of rotations that no other level uses
    first = 1 + level * 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for at, unit in by_length(part.column("raw"), kind):
                    dims, need = unit.shape[1], bits * tables
                    turned = np.concatenate([unit @ rotation(dims, first + k).T for k in range(-(-need // width(dims)))], 1)[:, :need].reshape(len(at), tables, bits)
                    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                    signs = ((turned > 0) * weights).sum(2, dtype=np.uint64)
                    open_ = weights[np.argpartition(np.abs(turned), 1, axis=2)[:, :, :2]]
                    a, b = open_[:, :, 0], open_[:, :, 1]
                    keys = np.stack([signs, signs ^ a, signs ^ b, signs ^ a ^ b], 2)
                    salt = np.array([hash((level, dims, t)) & 0xFFFFFFFFFFFF for t in range(tables)], np.uint64)
                    keys = keys * np.uint64(0x9E3779B97F4A7C15) + salt[None, :, None] * np.uint64(0xC2B2AE3D27D4EB4F)
                    if within:
                        keys ^= part.column(within).take(pa.array(at)).to_numpy().astype(np.uint64)[:, None, None] * np.uint64(0x165667B19E3779F9)
                    keys ^= keys >> np.uint64(29)
                    keys *= np.uint64(0xBF58476D1CE4E5B9)
                    keys ^= keys >> np.uint64(32)
                    each = pa.array(np.repeat(at, 4 * tables))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(part.column(c).take(each) for c in carried)], names=["key", *carried])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return common.mapped(rows.select("raw", *extra, *[c for c in carried if c not in extra]), run, ", ".join(["key long", *(f"{c} {kinds[c]}" for c in carried)]))


def differing(a: str, b: str, words: int) -> Column:
    """Number of signs in which two codes differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(words)), F.lit(0))


def most_differing(angle: float, dims: int) -> int:
    """Signs in which the codes of vectors at this angle differ at most, but for a vanishing chance."""
    d, p = width(dims), min(angle / math.pi, 0.5)
    return math.floor(d * p + SIGMAS * math.sqrt(d * p * (1 - p)))


def estimated(pairs: DataFrame, kind: str, kept: list[str]) -> DataFrame:
    """The pairs (raw, other_code, other_factor, most, ...) whose angle can be ``most`` at all, by the confidence bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            for at, unit in by_length(batch.column("raw"), kind):
                codes = batch.column("other_code").take(pa.array(at)).to_pylist()
                same = np.fromiter((64 * len(c) == width(unit.shape[1]) for c in codes), bool, len(codes))
                if same.any():
                    at, unit = at[same], unit[same]
                    found, bound = estimates(np.array([c for c, s in zip(codes, same, strict=True) if s], np.int64), batch.column("other_factor").to_numpy()[at], unit)
                    fine[at] = found + bound >= np.cos(np.minimum(batch.column("most").to_numpy()[at], math.pi))
            yield batch.filter(pa.array(fine)).select(kept)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return common.mapped(pairs, run, ", ".join(f"{c} {kinds[c]}" for c in kept))


def exact(pairs: DataFrame, kind: str, kept: list[str]) -> DataFrame:
    """With the exact cosine of ``raw`` and ``other_raw``; pairs of different lengths go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.full(batch.num_rows, np.nan)
            left, right = {}, {}
            for side, name in ((left, "raw"), (right, "other_raw")):
                for at, unit in by_length(batch.column(name), kind):
                    side[unit.shape[1]] = (at, unit)
            for dims, (at, unit) in left.items():
                if dims in right:
                    both, a, b = np.intersect1d(at, right[dims][0], assume_unique=True, return_indices=True)
                    cosine[both] = (unit[a] * right[dims][1][b]).sum(1)
            fine = pa.array(~np.isnan(cosine))
            yield batch.select(kept).append_column("cosine", pa.array(cosine)).filter(fine)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return common.mapped(pairs, run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "cosine double"]))


def angle(cosine: Column) -> Column:
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def leaders(vectors: DataFrame, keys: DataFrame, kind: str, reach: float, dims: int) -> DataFrame:
    """(v, ball, off, ball_code, ball_factor): the first vector that v meets first in a bucket and lies within ``reach``, and its angle."""
    first = keys.groupBy("key").agg(F.min(F.struct("v", "code", "factor")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("key", F.col("f.v").alias("ball"), F.col("f.code").alias("other_code"), F.col("f.factor").alias("other_factor"))
    near = differing("code", "other_code", width(dims) // 64) <= most_differing(reach, dims)
    met = keys.join(first, "key").where(F.col("v") > F.col("ball")).where(near).select("v", "ball", "other_code", "other_factor").distinct()
    pairs = met.join(vectors.select("v", "raw"), "v").withColumn("most", F.lit(reach))
    left = estimated(pairs, kind, ["v", "ball", "raw", "other_code", "other_factor"])
    found = exact(left.join(vectors.select(F.col("v").alias("ball"), F.col("raw").alias("other_raw")), "ball"), kind, ["v", "ball", "other_code", "other_factor"])
    found = found.withColumn("off", angle(F.col("cosine"))).where(F.col("off") <= reach)
    return found.groupBy("v").agg(F.min(F.struct("ball", "off", "other_code", "other_factor")).alias("b")).select("v", "b.ball", "b.off", F.col("b.other_code").alias("ball_code"), F.col("b.other_factor").alias("ball_factor"))


def met_balls(vectors: DataFrame, kind: str, rows: int, cosine: float, dims: int, hot: int = HOT) -> DataFrame:
    """Buckets of balls: (key, ball, size, radius, ball_code, ball_factor), once for each."""
    of = ["ball", "size", "radius", "ball_code", "ball_factor"]
    bits, tables = layout(rows, cosine, dims)
    found, source, within = None, vectors, None
    for level in range(LEVELS):
        keys = keyed(source, kind, bits, tables, level, ["v", *of], within)
        buckets = keys.select("key", *of).distinct()
        full = common.staged(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot")
        n, most = full.agg(F.count(F.lit(1)), F.max("n")).first()
        if not n or level == LEVELS - 1:
            return buckets if found is None else found.unionByName(buckets)
        full = common.lookup_side(full.select("key"), n)
        plain = buckets.join(full, "key", "left_anti")
        found = plain if found is None else found.unionByName(plain)
        # the vectors of full buckets, with further signs
        again = keys.join(full, "key").select("v", F.col("key").alias("within")).distinct()
        source = common.staged(again.join(vectors.select("v", "raw", *of), "v"), "full")
        bits, tables = layout(most, cosine, dims)
        within = "within"
    return found


def opened(pairs: DataFrame, vectors: DataFrame, kind: str, cosine: float, slice_rows: int = SLICE) -> DataFrame:
    """(a, b, v, n): for the vectors of two balls the number of links with the other ball's."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    members = vectors.join(wanted, "ball", "left_semi").select("ball", "v", "raw", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / slice_rows)).alias("slice"))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"ball": now[0], "ids": np.array(ids, "<i8").tobytes(), "rows": b"".join(rows)}], schema=pa.schema([("ball", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary())]))

        for batch in batches:
            for ball, v, raw, k in zip(*(batch.column(c).to_pylist() for c in ("ball", "v", "raw", "slice")), strict=True):
                if (ball, k) != now:
                    if ids:
                        yield pack()
                    now, ids, rows = (ball, k), [], []
                ids.append(v)
                rows.append(raw)
        if ids:
            yield pack()

    slices = common.mapped(members.repartition("ball", "slice").sortWithinPartitions("ball", "slice"), sliced, "ball long, ids binary, rows binary")
    slices = common.staged(slices, "slices")
    left = slices.select(F.col("ball").alias("a"), F.col("ids").alias("a_ids"), F.col("rows").alias("a_rows"))
    right = slices.select(F.col("ball").alias("b"), F.col("ids").alias("b_ids"), F.col("rows").alias("b_rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(rows: bytes, n: int) -> np.ndarray:
            found = np.frombuffer(rows, kind).reshape(n, -1).astype(np.float64)
            found /= np.abs(found).max(1)[:, None]
            return found / np.linalg.norm(found, axis=1)[:, None]

        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["b_ids"], "<i8")
                linked = unit(row["a_rows"], len(a)) @ unit(row["b_rows"], len(b)).T >= cosine
                v, n = np.concatenate([a, b]), np.concatenate([linked.sum(1), linked.sum(0)])
                held = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(held.sum()), row[c])) for c in ("a", "b")] + [pa.array(v[held]), pa.array(n[held])], names=["a", "b", "v", "n"])

    return common.mapped(pairs.select("a", "b").join(left, "a").join(right, "b"), compare, "a long, b long, v long, n long")


def with_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = THRESHOLD, hot: int = HOT, slice_rows: int = SLICE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    every, kind = coded(vectors, vec_id, embedding)
    every = common.staged(every, "codes")
    fine = every.where("raw is not null")
    rows, dims = fine.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("raw")), F.lit(0)) / int(kind[-1])).first()
    dims, limit = max(1, int(dims)), math.acos(cosine)
    reach = limit / 2 - SLACK

    bits, tables = layout(rows, cosine, dims)
    led = common.staged(leaders(fine, keyed(fine, kind, bits, tables, 0, ["v", "code", "factor"]), kind, reach, dims), "leaders")
    own = fine.select("v", "vec_id").join(led.select("v", "ball", "off"), "v", "left").select("v", "vec_id", F.coalesce("ball", "v").alias("ball"), F.coalesce("off", F.lit(0.0)).alias("off"))
    sizes = own.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), F.max("off").alias("radius"), F.min("vec_id").alias("least"))
    dealt = own.join(sizes, "ball").select("v", "ball", "size", "radius", "least")
    balls = fine.join(dealt, "v").join(led.select("v", "ball_code", "ball_factor"), "v", "left")
    balls = common.staged(balls.select("v", "vec_id", "raw", "ball", "size", "radius", "least", F.coalesce("ball_code", "code").alias("ball_code"), F.coalesce("ball_factor", "factor").alias("ball_factor")), "balls")

    # balls that meet, by the bound on differing signs, then by estimates, then exactly
    met = met_balls(balls, kind, rows, cosine, dims, hot)
    other = met.select("key", *[F.col(c).alias(f"other_{c.removeprefix('ball_')}") for c in ("ball", "size", "radius", "ball_code", "ball_factor")])
    several = (F.col("size") > 1).cast("int") + (F.col("other_size") > 1).cast("int")
    most = F.element_at(F.array(*[F.lit(most_differing(limit + k * reach, dims)) for k in range(3)]), several + 1)
    pairs = met.join(other, "key").where("ball < other_ball").where(differing("ball_code", "other_code", width(dims) // 64) <= most)
    ends = ["ball", "size", "radius", "other_ball", "other_size", "other_radius"]
    pairs = pairs.select(*ends, "other_code", "other_factor").distinct().withColumn("most", limit + F.col("radius") + F.col("other_radius") + SLACK)
    pairs = estimated(pairs.join(fine.select(F.col("v").alias("ball"), "raw"), "ball"), kind, [*ends, "raw"])
    pairs = exact(pairs.join(fine.select(F.col("v").alias("other_ball"), F.col("raw").alias("other_raw")), "other_ball"), kind, ends)
    reached = F.col("radius") + F.col("other_radius")
    all_linked = F.when(reached == 0, F.col("cosine") >= cosine).otherwise(angle(F.col("cosine")) + reached <= limit - SLACK)
    none_linked = F.when(reached == 0, F.col("cosine") < cosine).otherwise(angle(F.col("cosine")) - reached > limit + SLACK)
    pairs = common.staged(pairs.where(~none_linked).select(F.col("ball").alias("a"), F.col("other_ball").alias("b"), "size", "other_size", all_linked.alias("all_linked")), "met")

    whole = pairs.where("all_linked")
    counted = common.staged(opened(pairs.where("NOT all_linked"), balls, kind, cosine, slice_rows), "opened")
    labels = connected(whole.select("a", "b").unionByName(counted.select("a", "b").distinct()))
    least = sizes_of(balls).join(labels.withColumnRenamed("node", "ball"), "ball")
    least = least.select("ball", F.expr("label")).join(least.groupBy("label").agg(F.min("least").alias("component")), "label").select("ball", "component")
    more = whole.select(F.inline(F.array(F.struct(F.col("a").alias("ball"), F.col("other_size").alias("n")), F.struct(F.col("b").alias("ball"), F.col("size").alias("n"))))).groupBy("ball").agg(F.sum("n").alias("whole"))
    single = counted.groupBy("v").agg(F.sum("n").alias("single"))
    found = balls.select("v", "vec_id", "ball", "size", "least").join(single, "v", "left").join(more, "ball", "left").join(least, "ball", "left")
    links = F.col("size") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))
    found = found.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    alone = every.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def sizes_of(balls: DataFrame) -> DataFrame:
    return balls.groupBy("ball").agg(F.min("least").alias("least"))


def without_near_copies(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """The rows of ``vectors`` whose id is the smallest of their component, with all columns."""
    plain, (own, e) = common.numbered(vectors, vec_id, embedding)
    keep = with_links(plain, own, e, **options).where("kept").select(F.col("vec_id").alias("_kept")).distinct()
    return plain.join(keep, F.col(own).cast("long").eqNullSafe(F.col("_kept")), "left_semi").toDF(*vectors.columns)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_links(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op11_embedding_dedup": op11_embedding_dedup}
#: All pairs; a pair near the threshold may be missing from the query with a chance of 1 - RECALL.
ORACLE_SQL = {
    "op11_embedding_dedup": """
    WITH RECURSIVE sound AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM sound a, sound b
        WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
    """
}
