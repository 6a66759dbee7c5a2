"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on narrow rows; a node with very many links is
aggregated before the shuffle and its join can be split by the adaptive planner. State between rounds
is written to the shared folder. Nothing goes to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node that links reach.

    Self links and links with a null end are ignored; an empty table gives an empty result.
    """
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = common.staged(stars, "links")
    before = None
    for _ in range(ROUNDS):
        # large star: every larger neighbour goes to the smallest one
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, goes to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = stars
        stars = common.staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        common.delete(links.sparkSession, last.staged_at)
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
