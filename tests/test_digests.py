"""Digests of tables as trees, and numbers within few large groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests, stats
from tidemark.operators import curation


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def values(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "v string").repartition(3)


def test_one_leaf_is_the_digest_of_all_sorted_values(spark):
    rows = ["b", "a", "b", "é"]
    assert tuple(digests.multiset(values(spark, rows), "v", "|").first()) == (sha("|".join(sorted(rows))), 4)
    assert digests.levels(100_000) == 0 and digests.levels(100_001) == 1 and digests.levels(10**11) == 5


def test_a_tree_tells_what_rows_there_are_and_how_often(spark):
    rows = [f"r{k}" for k in range(300)] + ["hot"] * 200
    get = lambda x: digests.multiset(values(spark, x), "v", leaf=20).first()
    whole = get(rows)
    assert whole == get(rows[::-1]) and whole.n_rows == 500
    assert len({whole.digest, get(rows[1:]).digest, get(rows[:-1]).digest, get([*rows[:-1], "hit"]).digest, get([*rows, "r1"]).digest}) == 5
    depth, counts = digests.levels(500, 20), {v: rows.count(v) for v in rows}
    nodes = {}
    for v, n in sorted(counts.items()):
        nodes.setdefault(sha(v)[:depth], []).append(f"{v}\x1e{n}")
    nodes = {p: sha("".join(x)) for p, x in nodes.items()}
    for level in range(depth - 1, -1, -1):
        above = {}
        for p, h in sorted(nodes.items()):
            above.setdefault(p[:level], []).append(p + h)
        nodes = {p: sha("".join(x)) for p, x in above.items()}
    assert nodes == {"": whole.digest}


def test_digests_in_a_row_are_those_of_one_text_at_any_size(spark):
    rows = ["b", "a", "b", "é", "", "hot\n", *(f"r{k}" for k in range(300)), *["hot"] * 200]
    for separator, piece in (("", 8192), ("\n", 16), ("é", 1)):
        assert tuple(digests.in_a_row(values(spark, rows), "v", separator, piece).first()) == (sha(separator.join(sorted(rows, key=str.encode))), 506)
    assert tuple(digests.in_a_row(values(spark, rows).where("false"), "v").first()) == (sha(""), 0)


def test_fingerprint_and_batch_key_have_no_size_at_which_they_change(spark):
    n = digests.LEAF + 50_000
    rows = spark.range(n).select(F.concat(F.lit("T"), F.col("id") % 3).alias("ticker"), F.col("id").cast("string").alias("url"))
    lines = [(f"T{k % 3}", str(k)) for k in range(n)]
    assert tuple(curation.fingerprint(rows, ["ticker", "url"]).first()) == (sha("".join(sorted(sha("\x1f".join(x)) for x in lines))), n)
    found = curation.batch_digest(rows.unionByName(rows.limit(5))).first()
    assert (found.batch_key, found.n_rows) == (sha("\n".join(sorted("\t".join(x) for x in lines))), n + 5)


@pytest.mark.parametrize("leaf", [1000, 7, 2])
def test_ordered_digests_depend_on_the_order(spark, leaf):
    rows = [(k, f"v{k % 5}") for k in range(50)]
    get = lambda x: digests.ordered(spark.createDataFrame(x, "k long, v string").repartition(4), ["k"], "v", leaf).first()
    whole = get(rows)
    assert whole == get(rows[::-1]) and whole.n_rows == 50
    assert whole.digest != get([(k, rows[k ^ 1][1]) for k, _ in rows]).digest
    parts = [v for _, v in rows]
    while len(parts) > leaf:
        parts = [sha("".join(parts[a : a + leaf])) for a in range(0, len(parts), leaf)]
    assert whole.digest == sha("".join(parts))


def test_numbers_within_groups_with_a_null_one(spark):
    rows = spark.createDataFrame([(k, None if k % 4 == 0 else f"g{k % 4}", (k * 7) % 11) for k in range(40)], "k long, g string, x long").repartition(5)
    found = stats.numbered_within(rows, [F.col("x"), F.col("k")], "n", F.col("g")).collect()
    assert found[0].__fields__ == ["k", "g", "x", "n"]
    for g in {r.g for r in found}:
        own = sorted((r for r in found if r.g == g), key=lambda r: (r.x, r.k))
        assert [r.n for r in own] == list(range(1, len(own) + 1))
