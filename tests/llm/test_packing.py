import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm import cases
from tidemark.llm import bpe_vocab, packing


def brute(sizes, row):
    rows = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in rows if r[0] >= sizes[k]]
        best = min(fits, key=lambda r: r[0]) if fits else None
        if best is None:
            rows.append(best := [row])
        best[0] -= sizes[k]
    return sorted(r[0] for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing_leaves_the_room_that_brute_force_leaves(seed):
    rng = random.Random(seed)
    row = rng.choice([1, 7, 64, 2048])
    sizes = [rng.randint(1, row) for _ in range(rng.randint(0, 400))]
    packed = packing.best_fit_decreasing(sizes, row)
    assert sorted(k for r in packed for k in r) == list(range(len(sizes)))
    assert sorted(row - sum(sizes[k] for k in r) for r in packed) == brute(sizes, row)


@pytest.mark.parametrize("row, buffer", [(2048, 8192), (16, 5)])
def test_round_trip(spark, tiny, tmp_path, row, buffer):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").limit(60)
    packing.write_packed(docs, str(tmp_path / "packed"), row=row, buffer=buffer)
    rows = spark.read.parquet(str(tmp_path / "packed"))
    for r in rows.collect():
        assert len(r.ids) == 2 * row and r.cu_seqlens[0] == 0 and r.resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] == r.n_tokens <= row
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :]) <= {packing.PAD}
    parts = defaultdict(list)
    for r in packing.unpacked(rows).collect():
        parts[r.doc_id].append((r.offset, r.ids))
    encode = packing.encoding(bpe_vocab.read(public_tokenizers.path(packing.VOCABULARY))).encode_ordinary
    for r in docs.collect():
        assert b"".join(ids for _, ids in sorted(parts[r.doc_id])) == np.array(encode(r.text), "<u2").tobytes()


def test_edge_cases(spark):
    rows = packing.packed(cases.edge(spark, extra=True), row=64)
    ids = [i for r in rows.collect() for i in r.doc_ids]
    assert set(ids) == {i for i, t in cases.EDGE if t}
    assert packing.packed(cases.empty(spark)).collect() == []


def test_task_splits_change_nothing(spark, tmp_path):
    rows = [(k % 7, f"text {k % 5} " * (1 + k % 40)) for k in range(300)]
    spark.createDataFrame(rows, cases.DOCS).repartition(6).write.parquet(f"{tmp_path}/in")
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for most in ("1000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            found.append(cases.rows(packing.packed(spark.read.parquet(f"{tmp_path}/in"), row=64, buffer=50), "ids", "doc_ids", "doc_offsets"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1]
