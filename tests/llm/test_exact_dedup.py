import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import common, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for own in groups.values():
        best = min(own)[2]
        out += [(doc_id, best, len(own)) for _, _, doc_id in own]
    return sorted(out, key=repr)


def test_edge_cases(spark):
    found = exact_dedup.exact_duplicates(cases.edge(spark))
    assert cases.rows(found, "doc_id", "keep_id", "group_size") == brute(cases.EDGE)
    kept = [r.doc_id for r in found.where("kept").collect()]
    assert sorted(kept, key=repr) == sorted({k for _, k, _ in brute(cases.EDGE)}, key=repr)
    assert exact_dedup.exact_duplicates(cases.empty(spark)).collect() == []


def test_only_one_of_repeated_rows_stays_and_columns_are_kept(spark):
    docs = cases.edge(spark, extra=True)
    for name in ("_text", "_points", "_id", "_file", "_row", "_metadata", "_c0", "_best"):
        docs = docs.withColumn(name, F.lit("own"))
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns and {tuple(r[-8:]) for r in left.collect()} == {("own",) * 8}
    assert sorted([r.doc_id for r in left.collect() if r.doc_id]) == [3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_a_weak_digest_is_found_out_by_the_bytes(spark):
    rows = cases.family(bases=15) + [(900, "a b"), (901, "ab"), (902, "a  b")]
    docs = spark.createDataFrame(rows, cases.DOCS)
    weak = exact_dedup.exact_duplicates(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    assert cases.rows(weak, "doc_id", "keep_id", "group_size") == brute(rows)


def test_several_micro_batches_and_a_second_stream_over_the_same_state(spark):
    rows = [(k, f"text {k % 7}") for k in range(60)]
    docs = spark.createDataFrame(rows, cases.DOCS).repartition(6)
    assert cases.rows(exact_dedup.exact_duplicates(docs, files_per_batch=1), "doc_id", "keep_id", "group_size") == brute(rows)
    arrivals, state = common.scratch(spark, "arrivals"), common.scratch(spark, "state")
    more = spark.range(10).select(F.lit("d").alias("_digest"), F.col("id").alias("_points"), F.col("id").alias("_id"), F.lit("f").alias("_file"), F.col("id").alias("_row"))
    for times in (1, 2):
        more.write.mode("append").parquet(arrivals)
        exact_dedup.absorb(spark, arrivals, state)
        held = exact_dedup.held(spark, state).first()
        assert (held["_n"], held["_best"]["_points"]) == (10 * times, 9)


def test_a_later_stream_is_checked_against_the_texts_of_the_state(spark):
    state, weak = common.scratch(spark, "kept-state"), lambda t: F.substring(F.sha2(t, 256), 1, 1)
    first = [(k, f"text {k}") for k in range(40)]
    exact_dedup.exact_duplicates(spark.createDataFrame(first, cases.DOCS), state=state).collect()
    again = exact_dedup.exact_duplicates(spark.createDataFrame([(100, "text 3"), (101, "new"), (102, "te xt 7")], cases.DOCS), state=state)
    assert cases.rows(again, "doc_id", "keep_id", "group_size", "kept") == [(100, 3, 2, False), (101, 101, 1, True), (102, 102, 2, True)]
    state = common.scratch(spark, "weak-state")
    exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a longer text")], cases.DOCS), state=state, digest=weak).collect()
    other = next(t for t in (f"t{k}" for k in range(500)) if hashlib.sha256(t.encode()).hexdigest()[0] == hashlib.sha256(b"alongertext").hexdigest()[0])
    clash = exact_dedup.exact_duplicates(spark.createDataFrame([(2, other), (3, "along er text")], cases.DOCS), state=state, digest=weak)
    assert cases.rows(clash, "doc_id", "keep_id", "group_size") == [(2, 2, 1), (3, 1, 2)]


def test_the_plan_has_no_python(spark, tiny):
    plan = exact_dedup.op2_exact_dedup(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
