import math
import re
from collections import Counter

import duckdb
import pytest

from tests.llm import cases
from tidemark.llm import lm_scores


def brute(rows, order, backoff=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    counts = Counter(tuple(d[k : k + n]) for d in docs for n in range(1, order + 1) for k in range(len(d) - n + 1))
    total = sum(map(len, docs))

    def s(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return (counts[gram] - 1) / (counts[gram[:-1]] - 1) if counts[gram] > 1 else backoff * s(gram[1:])

    return sorted(((i, len(d), round(sum(math.log(s(tuple(d[max(0, k - order + 1) : k + 1]))) for k in range(len(d))), 6)) for (i, _), d in zip(rows, docs)), key=repr)


def found(docs, **options):
    return sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_scores.with_lm_scores(docs, **options).collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-9, abs=1e-5) for x, y in zip(a, b))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = cases.family(order, vocabulary=60)
    docs = spark.createDataFrame(rows, cases.DOCS)
    assert close(found(docs, order=order), brute(rows, order))
    assert close(found(docs, order=order, shard_bytes=2000, bucket_bytes=3000), brute(rows, order))


def test_edge_cases(spark):
    rows = [(i, t) for i, t in cases.EDGE if t is None or len(t) < 100] + [(20, "long " + "word other " * 20_000)]
    docs = spark.createDataFrame(rows, cases.DOCS).selectExpr("*", "'own' as shard", "'own' as n_words", "'own' as documents", "'own' as bucket")
    assert close(found(docs), brute(rows, 3))
    assert {r.mean_log_score for r in lm_scores.with_lm_scores(docs).where("n_words = 0").collect()} == {None}
    assert lm_scores.with_lm_scores(cases.empty(spark)).collect() == []


def test_the_query_equals_its_sql(spark, tmp_path):
    rows = cases.family(5, vocabulary=40) + [(900, None), (901, ""), (902, "one"), (903, "one two")]
    spark.createDataFrame(rows, cases.DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.sql(lm_scores.ORACLE_SQL["op8_lm_scores"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in lm_scores.op8_lm_scores(spark, str(tmp_path)).collect()]
    assert close(sorted(x[:3] for x in own), sorted(x[:3] for x in got)) and len(got) == len(rows)
