import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    """(n_links, component_id, kept) by id, from all pairs."""
    sound = [(i, np.array(e, float)) for i, e in rows if e is not None and len(e) and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    links = {i: set() for i, _ in rows}
    for dims in {len(e) for _, e in sound}:
        ids = [i for i, e in sound if len(e) == dims]
        unit = np.stack([e / np.abs(e).max() for _, e in sound if len(e) == dims])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for k, j in zip(*np.nonzero(unit @ unit.T >= cosine), strict=True):
            if k != j:
                links[ids[k]].add(ids[j])
    least = {}
    for i in sorted(links):
        todo = [i] if i not in least else []
        while todo:
            j = todo.pop()
            if j not in least:
                least[j] = i
                todo += links[j]
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


def found(vectors, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.with_links(vectors, **options).collect()}


def planted(n=900, dims=64, seed=5):
    """Random vectors, groups of near copies of several widths and chains of them."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = [unit(rng.standard_normal(dims)) * rng.uniform(0.1, 9) for _ in range(n)]
    for size, noise in ((150, 0.10), (60, 0.2), (40, 0.3), (2, 0.05), (2, 0.3), (3, 0.25), (30, 0.0)):
        base = unit(rng.standard_normal(dims))
        out += [base + noise * unit(rng.standard_normal(dims)) for _ in range(size)]
    at = unit(rng.standard_normal(dims))
    for _ in range(12):
        at = unit(at + 0.28 * unit(rng.standard_normal(dims)))
        out.append(at)
    order = rng.permutation(len(out))
    return [(k, np.float32(out[j]).tolist()) for k, j in enumerate(order)]


@pytest.mark.parametrize(("hot", "slice_rows"), [(ed.HOT, ed.SLICE), (3, 16)])
def test_finds_the_links_that_all_pairs_have(spark, hot, slice_rows):
    rows = planted()
    expected, got = brute(rows), found(spark.createDataFrame(rows, SCHEMA).repartition(5), hot=hot, slice_rows=slice_rows)
    assert got.keys() == expected.keys()
    n, m = (sum(x[0] for x in y.values()) for y in (expected, got))
    assert 0.97 * n <= m <= n and all(got[i][0] <= expected[i][0] for i in got)
    assert sum(got[i] == expected[i] for i in got) >= 0.97 * len(got)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, e), (8, [1e-30, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (11, [3.0, 0.1, 0.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as v", "'own' as raw", "'own' as kept", "0 as label", "'own' as ball")
    assert found(vectors) == brute(rows) == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)}, 7: (2, 7, True), 8: (2, 7, False), 11: (2, 7, False)}
    kept = ed.without_near_copies(vectors)
    assert kept.columns == vectors.columns and sorted(r.vec_id for r in kept.select("vec_id").collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert found(vectors.where("false")) == {}


def test_repeated_and_missing_ids(spark):
    rows = [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [2.0, 4.0]), (None, [-1.0, 2.0]), (9, [-1.0, -2.0])]
    got = sorted((tuple(r) for r in ed.with_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True), (9, 0, 9, True)], key=repr)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    a, z = rng.standard_normal((2, 6000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    for cosine in (0.0, 0.5, 0.9, 0.97):
        turned = a @ ed.rotation(64, 0).T
        code, factor = np.packbits(turned > 0, axis=1, bitorder="little").view("<i8"), np.abs(turned).sum(1) / 8
        got, bound = ed.estimates(code, factor, cosine * a + math.sqrt(1 - cosine**2) * z)
        assert abs((got - cosine).mean()) < 0.005
        assert (np.abs(got - cosine) <= bound).mean() > 0.997


def test_tables_are_enough_for_the_recall():
    for rows in (1000, 10**6, 10**10):
        bits, tables = ed.layout(rows, 0.95, 64)
        assert 2**bits >= 4 * rows and 1 - (1 - ed.match_rate(bits, 0.95, 64)) ** tables >= ed.RECALL


def test_a_group_of_copies_makes_few_balls_and_no_pairs(spark):
    rng = np.random.default_rng(1)
    sizes = []
    for n in (400, 1600):
        base = rng.standard_normal(64)
        rows = [(k, (base / np.linalg.norm(base) + 0.1 * (x := rng.standard_normal(64)) / np.linalg.norm(x)).tolist()) for k in range(n)]
        every, kind = ed.coded(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
        bits, tables = ed.layout(n, 0.95, 64)
        led = ed.leaders(every, ed.keyed(every, kind, bits, tables, 0, ["v", "code", "factor"]), kind, math.acos(0.95) / 2, 64)
        sizes.append((led.select("ball").distinct().count(), led.agg(F.count("v")).first()[0]))
        assert sizes[-1][1] > 0.95 * n
    assert sizes[1][0] < 3 * sizes[0][0] and sizes[1][0] < 80
