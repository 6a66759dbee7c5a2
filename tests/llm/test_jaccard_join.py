import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from tidemark.llm import common, jaccard_join, shingles
from tidemark.llm.components import connected


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows):
    own = [(i, sets(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(own):
        for j, y in own[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(sets(t)), None if i is None else root(i)) for i, t in rows), key=repr)


def found(docs):
    return cases.rows(jaccard_join.component_ids(docs), "doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = cases.family(seed, bases=25)
    assert found(spark.createDataFrame(rows, cases.DOCS)) == brute(rows)


@pytest.mark.parametrize("cell", [2, 5, 2048])
def test_small_buckets_blocks_and_many_frequent_tokens(spark, monkeypatch, cell):
    for name, value in (("BUCKET_TOKENS", 50), ("BLOCK", 2), ("SLICE", 3), ("FIRST_TRY", 1), ("HOT", 2), ("HELD_TOKENS", 40), ("AGREE", 8), ("CELL", cell)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = cases.family(11, bases=14, most=14)
    assert found(spark.createDataFrame(rows, cases.DOCS)) == brute(rows)


def test_groups_of_mixed_sizes_need_no_more_than_their_members(spark, monkeypatch):
    # x links with y alone (0.75 exactly, 10 shared first tokens); y and z are a group that stars don't join to x
    monkeypatch.setattr(jaccard_join, "AGREE", 8)
    passage = [f"p4x{k}" for k in range(91)]
    x, y = ([*passage, *(f"{name}{k}" for k in range(n))] for name, n in (("x", 13), ("y", 16)))
    others = [[*passage, *(f"o{k}w{j}" for j in range(300))] for k in range(jaccard_join.HOT)]
    rows = list(enumerate(" ".join(words) for words in (x, y, [*y, "y16"], *others)))
    assert {i for i, _, c in brute(rows) if c == 0} == {0, 1, 2}
    assert found(spark.createDataFrame(rows, cases.DOCS)) == brute(rows)


def test_least_shared_is_the_least_over_all_sizes():
    def pair(x, y):
        return -(-3 * (x + y) // 7) - -(-3 * max(x, y) // 4) + 1

    rng = random.Random(0)
    for _ in range(5000):
        x, y = rng.randint(1, 150), rng.randint(1, 150)
        xs, ys = range(x, x + rng.choice([1, 2, 12])), range(y, y + rng.choice([1, 2, 12]))
        fitting = [pair(i, j) for i in xs for j in ys if 4 * min(i, j) >= 3 * max(i, j)]
        a, b = (np.array([(0, 0, own[0], own[-1], 0, 0)], jaccard_join.ENTRY) for own in (xs, ys))
        if fitting:
            assert jaccard_join.least_shared(a, b)[0] == max(1, min(fitting))


def test_edge_cases(spark):
    assert found(cases.edge(spark)) == brute(cases.EDGE)
    assert found(cases.empty(spark)) == []
    assert found(cases.edge(spark, extra=True)) == brute(cases.EDGE)


def test_small_tables_equal_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = jaccard_join.op6_ngram_jaccard(spark, tiny)
    assert cases.rows(got, "doc_id", "n_shingles", "component_id") == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = cases.family(5)
    left = jaccard_join.one_of_each(spark.createDataFrame(rows, cases.DOCS))
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute(rows)})
    clashing = spark.createDataFrame([(1, "a b c", "x", 5), (2, "a b c", "y", 6), (None, "a b c", "z", 1)], "doc_id long, text string, _gone string, gone long")
    left = jaccard_join.one_of_each(clashing)
    assert left.columns == clashing.columns and cases.rows(left, "_gone") == [("x",), ("z",)]


def test_cells_pair_every_two_groups_of_a_token_once():
    rng = np.random.default_rng(3)
    late = np.zeros(60, jaccard_join.LATE)
    late["token"], late["group"] = 77, rng.permutation(1000)[:60]
    entries, cells = jaccard_join.in_cells(late, np.full(60, 4))
    part, seen = jaccard_join.slice_of(entries, 4), []
    for cell in set(cells.tolist()):
        own = np.flatnonzero(cells == cell)
        seen += [tuple(sorted((entries["group"][i], entries["group"][j]))) for i in own for j in own if i < j and (part[i] != part[j]) == (cell & 1 == 1)]
    groups = sorted(late["group"].tolist())
    assert sorted(seen) == [(a, b) for k, a in enumerate(groups) for b in groups[k + 1 :]]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50, 0, -1)] + [(7, 7), (100, None), (200, 201)], "a long, b long")
    assert cases.rows(connected(links)) == sorted([(k, 1) for k in range(1, 52)] + [(200, 200), (201, 200)], key=repr)


def test_rare_words_are_hashed_and_not_remembered():
    words = [f"w{k}x" for k in range(30_000)]
    assert shingles.word_hashes(" ".join(words).upper()).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    known = {w.encode() for w in words}
    assert not any(known & (m.keys() | m.older.keys()) for m in common.Memory.every)
    text = "a b c d e a b c d e f"
    assert shingles.shingle_set(text).tolist() == sorted(set(shingles.grams(shingles.word_hashes(text), 5).tolist())) and len(shingles.shingle_set(text)) == 6
    assert len(shingles.shingle_set("")) == len(shingles.shingle_set(None)) == 0
