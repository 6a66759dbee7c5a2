"""Snapshots that readers never find missing, upserts that touch few buckets, and the ledger of prepared batches."""

import hashlib
import os

import pytest

from tidemark.sources import ledger, snapshots

SCHEMA = "k long, v string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(spark, path, number=None):
    return sorted((r.k, r.v) for r in snapshots.read(spark, path, number).collect())


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_upserts_make_snapshots_and_write_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.replace(spark.range(200).selectExpr("id as k", "concat('v', id) as v"), path, ["k"], 16) == 1
    before = files(path)
    assert snapshots.upsert(table(spark, (3, "new"), (777, "more"), (4, None)), path) == 2
    written = files(path) - before
    assert 1 <= len({os.path.dirname(f) for f in written}) <= 3 and before <= files(path)
    expected = sorted([(k, f"v{k}") for k in range(200) if k not in (3, 4)] + [(3, "new"), (777, "more")])
    assert [x for x in content(spark, path) if x[0] != 4] == expected and (4, None) in snapshots.read(spark, path).collect()
    # the reader of the first snapshot still has it
    assert content(spark, path, 1) == sorted((k, f"v{k}") for k in range(200))
    assert snapshots.expire(spark, path, 1) and snapshots.numbers(spark, path) == [2]
    assert [x for x in content(spark, path) if x[0] != 4] == expected
    with pytest.raises(KeyError):
        snapshots.read(spark, path, 1)


def test_a_table_is_replaced_by_rows_of_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace(table(spark, (1, "a"), (2, "b")), path, ["k"])
    snapshots.replace(snapshots.read(spark, path).where("k = 2"), path, ["k"])
    assert content(spark, path) == [(2, "b")]
    snapshots.replace(snapshots.read(spark, path).where("false"), path, ["k"])
    assert content(spark, path) == [] and snapshots.read(spark, path).columns == ["k", "v"]
    snapshots.upsert(table(spark, (9, "z")), path)
    assert content(spark, path) == [(9, "z")]


@pytest.mark.parametrize("step", ["write_data", "commit", "rename"])
def test_a_crash_at_any_step_leaves_the_snapshot_before(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    snapshots.replace(table(spark, (1, "a")), path, ["k"])
    real, seen = getattr(snapshots, step, None), []

    def killed(*given):
        if step == "write_data":
            real(*given)
        seen.append(content(spark, path))
        raise KeyboardInterrupt

    if step == "rename":
        # the manifest is written, the rename never comes
        def unrenamed(spark_, path_, made):
            (tmp_path / "t" / "snapshots" / ".draft.tmp").write_text("{half")
            killed()

        monkeypatch.setattr(snapshots, "commit", unrenamed)
    else:
        monkeypatch.setattr(snapshots, step, killed)
    with pytest.raises(KeyboardInterrupt):
        snapshots.upsert(table(spark, (1, "b")), path)
    monkeypatch.undo()
    assert seen == [[(1, "a")]] and content(spark, path) == [(1, "a")]
    snapshots.upsert(table(spark, (1, "c")), path)
    assert content(spark, path) == [(1, "c")]


def test_of_two_writers_the_second_fails_and_can_try_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(table(spark, (1, "a")), path, ["k"])
    real = snapshots.write_data

    def overtaken(*given):
        monkeypatch.setattr(snapshots, "write_data", real)
        snapshots.upsert(table(spark, (2, "first")), path)
        return real(*given)

    monkeypatch.setattr(snapshots, "write_data", overtaken)
    with pytest.raises(snapshots.Conflict):
        snapshots.upsert(table(spark, (3, "second")), path)
    assert content(spark, path) == [(1, "a"), (2, "first")]
    snapshots.upsert(table(spark, (3, "second")), path)
    assert content(spark, path) == [(1, "a"), (2, "first"), (3, "second")]


def test_what_is_no_table_of_keys_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in (table(spark, (1, "a"), (1, "b")), table(spark, (None, "a"))):
        with pytest.raises(ValueError, match="a key is"):
            snapshots.replace(rows, path, ["k"])
    snapshots.replace(table(spark, (1, "a")), path, ["k"])
    with pytest.raises(ValueError, match="columns differ"):
        snapshots.upsert(spark.createDataFrame([(1, 2)], "k long, v long"), path)
    with pytest.raises(ValueError):
        snapshots.expire(spark, path, 0)


def test_articles_are_flushed_in_parts(spark, tmp_path):
    path, schema = str(tmp_path / "a"), "url string, article_id string, published_at string, title string, body string"
    first = spark.createDataFrame([(f"u{k}", str(k), None if k % 2 else "2024", "t", "b") for k in range(20)], schema)
    made = snapshots.upsert_articles(first, path, flush=8)
    assert made == [2, 3, 4] and snapshots.read(spark, path).count() == 20
    snapshots.upsert_articles(spark.createDataFrame([("u1", "1", "2025", "later", "b"), ("u99", "99", None, None, None)], schema), path)
    rows = {r.url: r for r in snapshots.read(spark, path).collect()}
    assert len(rows) == 21 and not rows["u1"].parse_failed and rows["u1"].title == "later" and rows["u3"].parse_failed and rows["u99"].parse_failed


def test_digests_are_those_of_the_bytes_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PIECE", 7)
    folder = tmp_path / "d"
    (folder / "sub").mkdir(parents=True)
    parts = {"b.bin": bytes(range(256)) * 9, "a": b"", "sub/c": b"xyz"}
    for name, data in parts.items():
        (folder / name).write_bytes(data)
    expected = hashlib.sha256(b"".join(n.encode() + parts[n] for n in sorted(parts))).hexdigest()
    assert ledger.digest(f"file://{folder}") == (expected, 3, 256 * 9 + 3)
    rows = spark.createDataFrame([(str(folder),), (f"{folder}/b.bin",), (f"{tmp_path}/none",), (None,)], "output string")
    found = {r.output: (r.sha256, r.files) for r in ledger.digests(rows).collect()}
    assert found == {str(folder): (expected, 3), f"{folder}/b.bin": (hashlib.sha256(parts["b.bin"]).hexdigest(), 1), f"{tmp_path}/none": (None, 0)}


def test_only_batches_whose_output_stands_have_happened(spark, tmp_path, monkeypatch):
    place, book = str(tmp_path), f"{tmp_path}/ledger"
    assert ledger.committed(spark, book).collect() == []
    for k in range(3):
        ledger.publish(table(spark, (k, "x")), f"{place}/{k}", book, f"batch-{k}", {"n": k})
    with pytest.raises(FileExistsError):
        ledger.publish(table(spark, (9, "x")), f"{place}/0", book, "batch-9", {})

    # killed between the record and the rename: prepared, but nothing stands
    real = ledger.prepare

    def killed(*given):
        real(*given)
        raise KeyboardInterrupt

    monkeypatch.setattr(ledger, "prepare", killed)
    with pytest.raises(KeyboardInterrupt):
        ledger.publish(table(spark, (5, "x")), f"{place}/5", book, "batch-5", {"n": 5})
    monkeypatch.undo()
    (tmp_path / "1" / "part-extra.parquet").write_bytes(b"changed")
    (tmp_path / "ledger" / "torn.json").write_text('{"key": "batch-2", "outp')
    (tmp_path / "ledger" / "empty.json").write_text('{"key": "batch-7"}\n')
    assert {r.key for r in ledger.records(spark, book).collect()} == {"batch-0", "batch-1", "batch-2", "batch-5"}
    assert {r.key for r in ledger.committed(spark, book).collect()} == {"batch-0", "batch-2"}
    logged = spark.createDataFrame([("batch-0",)], "key string")
    assert [(r.key, r.data) for r in ledger.committed(spark, book, logged).collect()] == [("batch-2", '{"n": 2}')]
    # the batch comes again after the crash, and counts once
    ledger.publish(table(spark, (5, "x")), f"{place}/5", book, "batch-5", {"n": 5})
    assert [r.key for r in ledger.committed(spark, book, logged).orderBy("key").collect()] == ["batch-2", "batch-5"]
