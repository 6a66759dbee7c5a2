import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Filters applied one after the other, for every order."""
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), i is not None and i > first.get(t, i))) if x}

    parts = {}
    for i, t, s in docs:
        parts.setdefault(s or "", []).append((fails(i, t), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shares = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shares[f] += len(gone)
                failing = [r for r in rows if f in r[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shares[f])
    return out


def found(docs, labels):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in fa.audit(docs, labels).collect()}


DOC_ROWS = [
    *[(i, t, "web" if (i or 0) % 2 else None) for i, t in cases.EDGE],
    *[(100 + k, t, ("web", "book", "")[k % 3]) for k, (_, t) in enumerate(cases.family(2, vocabulary=300))],
    *[(200 + k, "SHOUTING " * (k + 40) + ("#" if k % 2 else ""), "book") for k in range(6)],
    # copies over parts, a row that repeats its id, copies without an id
    (300, "copy of a text", "web"), (301, "copy of a text", "book"), (299, "copy of a text", "book"), (299, "copy of a text", "book"), (None, "copy of a text", "web"), (None, "copy of nothing", "web"), (None, "copy of nothing", "web"),
]
LABEL_ROWS = [(i, i % 2, i % 3 % 2) for i in range(2, 340, 3)] + [(301, None, None), (301, 1, 0), (None, 1, 1), (9999, 1, 1)]


def test_equals_filters_applied_in_every_order(spark):
    docs, labels = spark.createDataFrame(DOC_ROWS, DOCS).repartition(5), spark.createDataFrame(LABEL_ROWS, LABELS)
    assert found(docs, labels) == brute(DOC_ROWS, LABEL_ROWS)
    clashing = docs.selectExpr("*", *[f"'own' as {c}" for c in ("digest", "own", "salt", "good", "toxic", "part", "n", "fails", "step", "kept")])
    assert found(clashing, labels.withColumn("_id", F.lit("own"))) == brute(DOC_ROWS, LABEL_ROWS)


def test_dividends_share_out_all_that_is_removed(spark):
    docs, labels = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(LABEL_ROWS, LABELS)
    removed = Counter(s or "" for *_, s in DOC_ROWS)
    rows = [r for r in fa.audit(docs, labels).collect() if r.filter_order == "ABCDE"]
    for part, n in removed.items():
        own = sorted((r for r in rows if r.part == part), key=lambda r: r.step)
        assert sum(r.shapley for r in own) == 120 * (n - own[-1].kept)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame([], LABELS)
    assert found(docs, labels) == brute(DOC_ROWS, [])
    assert fa.audit(docs.where("false"), labels).collect() == []


@pytest.mark.parametrize("copies", [2000])
def test_a_text_of_most_rows_sends_few_rows(spark, copies):
    docs = spark.range(copies).selectExpr("id as doc_id", "if(id % 4 = 0, concat('text ', id), 'one text') as text", "'web' as source")
    rows = fa.labelled(fa.flagged(docs), spark.createDataFrame([], LABELS))
    kinds = fa.failure_counts(rows)
    assert kinds.agg(F.sum("n")).first()[0] == copies
    assert kinds.where("fails >= 16").agg(F.sum("n")).first()[0] == copies * 3 // 4 - 1
