import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import importance as im

ITEMS = [("a", "w1 w2 w3 w4 w5 w6 w7"), ("b", None), ("c", "w1 w2 w3 the quick brown fox")]


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute(docs, items, least=20, percent=5):
    raw, target = (Counter(b for *_, t in rows for b in features(t)[1]) for rows in (docs, items))
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    out = []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    may = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranks = [(*x[:4], k + 1 if k < percent * len(may) // 100 else None) for k, x in enumerate(may)]
    return sorted(ranks + [(*x[:4], None) for x in out if not x[4]], key=repr)


def found(docs, items, percent=5, **sizes):
    gain = im.gains(im.bucket_counts(docs), im.bucket_counts(items))
    return cases.rows(im.resampled(im.weighted(docs, gain), F.col("n_words") >= 20, percent, **sizes), "doc_id", "n_features", "weight", "score", "rank")


DOCS = cases.EDGE + [(100 + i, t) for i, t in cases.family(4, bases=40, vocabulary=200)] + [(50, "w" * 70 + " " + "w1 w2 " * 30), (51, "A-b_C 7é " * 9)]
DOCS += [DOCS[40]] * 3


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_equals_brute_force(spark, percent):
    docs, items = spark.createDataFrame(DOCS, cases.DOCS).repartition(6), spark.createDataFrame(ITEMS, "item_id string, text string")
    expected = brute(DOCS, ITEMS, percent=percent)
    assert found(docs, items, percent) == expected
    # many runs, blocks and ranges
    assert found(docs, items, percent, range_rows=5, run_rows=7, block_rows=3) == expected
    clashing = docs.selectExpr("*", "'own' as Score", "'own' as weight", "'own' as range", "'own' as id", "'own' as text_in", "'own' as down")
    assert found(clashing, items, percent, range_rows=5) == expected


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, cases.DOCS), spark.createDataFrame([], "item_id string, text string")
    assert found(docs, items) == brute(DOCS, [])
    assert found(cases.empty(spark), items) == []


def test_crcs_of_runs_are_put_together():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcz019é漢") for _ in range(rng.randint(1, 20))) for _ in range(300)]
    for more in ([], ["x" * 65], ["y" * 64]):
        text = " ".join(words + more)
        n, buckets = im.Runs().of(text.encode())
        assert (n, np.concatenate(buckets).tolist()) == features(text)


def test_tournament_merges_sources_that_join_late():
    rng = random.Random(2)
    for _ in range(30):
        runs = [sorted((rng.randrange(40), k) for _ in range(rng.randrange(9))) for k in range(rng.randrange(1, 20))]
        tree, out = im.Tournament(), []
        for run in sorted((r for r in runs if r), key=lambda r: r[0]):
            while tree.least() is not None and tree.least() < run[0]:
                out.append(tree.pop())
            tree.join(iter(run))
        while tree.least() is not None:
            out.append(tree.pop())
        assert out == sorted(x for r in runs for x in r)


def test_ranges_follow_the_order_when_one_score_holds_most_rows(spark):
    rows = [(i, 1, 7 if i % 10 else i, 7 if i % 10 else i, True) for i in range(3000)] + [(None, 1, 7, 7, True)] * 2
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, may boolean").repartition(7)
    got = im.resampled(scored, F.col("may"), 60, range_rows=40, run_rows=100, block_rows=9)
    order = sorted(rows, key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    draws = 60 * len(rows) // 100
    assert sorted((r["rank"], r.doc_id) for r in got.where("rank is not null").collect()) == [(k + 1, x[0]) for k, x in enumerate(order[:draws])]
    assert got.count() == len(rows)
    edges = im.Edges([7] * 9 + [100], [500, 1000, 2000])
    packed = np.array([(-x[3], int(x[0] is None), x[0] or 0, 1, 1) for x in order], im._PACKED)
    at = edges.of(packed)
    assert (np.diff(at) >= 0).all() and np.bincount(at).max() < 1100
