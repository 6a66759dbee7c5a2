"""Stored files told from their footers."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.sources import verify

GOOD = {"session_date": pa.array([0, 1], pa.timestamp("us")), "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.0, 2.0], "volume": [5, 6], "ticker": ["AAA", "AAA"]}


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({k: v for k, v in (GOOD | columns).items() if v is not None}), path)


def told(spark, folder, **options):
    return {r.named: (r.files, r.rows, r.problems, r.ok) for r in verify.verified(spark, str(folder), verify.PRICE_COLUMNS, True, **options).collect()}


def test_each_table_gets_what_is_wrong_with_it(spark, tmp_path):
    put(tmp_path / "AAA.parquet")
    put(tmp_path / "OLD.parquet", ticker=None)
    put(tmp_path / "BBB.parquet", ticker=["BBB", "CCC"])
    put(tmp_path / "NULLS.parquet", ticker=pa.array([None, "NULLS"]))
    put(tmp_path / "TEXT.parquet", ticker=["TEXT"] * 2, close=["1", "2"], volume=None)
    put(tmp_path / "PARTS.parquet" / "part-0.parquet", ticker=["PARTS"] * 2)
    put(tmp_path / "PARTS.parquet" / "part-1.parquet", **{k: (v.slice(0, 0) if isinstance(v, pa.Array) else pa.array([], pa.array(v).type)) for k, v in GOOD.items()})
    put(tmp_path / "EMPTY.parquet", **{k: (v.slice(0, 0) if isinstance(v, pa.Array) else pa.array([], pa.array(v).type)) for k, v in GOOD.items()})
    put(tmp_path / "_hidden.parquet", ticker=["x", "y"])
    (tmp_path / "BROKEN.parquet").write_bytes(b"PAR1 no table PAR1")
    (tmp_path / "notes.txt").write_text("no table")
    assert told(spark, tmp_path, expected=("AAA", "GONE")) == {
        "AAA": (1, 2, [], True),
        "OLD": (1, 2, ["no ticker column"], True),
        "BBB": (1, 2, ["ticker is not the file's"], False),
        "NULLS": (1, 2, [], True),
        "TEXT": (1, 2, ["close is no number but text", "volume missing"], False),
        "PARTS": (2, 2, [], True),
        "EMPTY": (1, 0, ["empty"], False),
        "BROKEN": (1, 0, ["unreadable"], False),
        "GONE": (0, 0, ["missing"], False),
    }
    with pytest.raises(FileNotFoundError):
        told(spark, tmp_path / "none")


def test_rows_are_never_read(spark, tmp_path, monkeypatch):
    put(tmp_path / "AAA.parquet")
    found = verify.footer(f"file://{tmp_path}/AAA.parquet")
    assert (found["rows"], found["ticker_low"], found["ticker_high"], found["ticker_nulls"], found["error"]) == (2, "AAA", "AAA", 0, None)
    assert {c["name"]: c["kind"] for c in found["columns"]}["session_date"] == "time"
    # a file whose data pages are spoilt still has its footer
    data = bytearray((tmp_path / "AAA.parquet").read_bytes())
    data[4:60] = b"\0" * 56
    (tmp_path / "AAA.parquet").write_bytes(data)
    assert verify.footer(f"file://{tmp_path}/AAA.parquet")["rows"] == 2


def test_an_empty_folder_has_no_tables(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert told(spark, tmp_path / "x") == {} and told(spark, tmp_path / "x", expected=("A",)) == {"A": (0, 0, ["missing"], False)}
