"""The ledger of output batches: what is about to be put in place is recorded durably first, and recovery
counts a batch only if the recorded digest is that of what stands at its place now.

A record is one small file, written under another name and renamed, so that half a record is never read. Files
and folders are digested in pieces: a file's digest is that of its bytes; a folder's goes over its files in the
order of their relative names, each name before its bytes. One task digests one output, whatever its size,
with one piece in memory.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import file_system

PIECE = 1 << 20
SCHEMA = "key string, output string, output_sha256 string, prepared_at string, data string"


def file_names(system: fs.FileSystem, path: str) -> list[tuple[str, str]]:
    """(relative name, path) of the files under a folder, in order of their names."""
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((posixpath.relpath(f.path, path), f.path) for f in found if f.type == fs.FileType.File)


def digest(uri: str) -> tuple[str | None, int, int]:
    """(sha256, files, bytes) of a file or a folder; no digest if there is nothing."""
    system, path = fs.FileSystem.from_uri(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.NotFound:
        return None, 0, 0
    whole, size = hashlib.sha256(), 0
    parts = [("", path)] if kind == fs.FileType.File else file_names(system, path)
    for name, place in parts:
        whole.update(name.encode())
        with system.open_input_stream(place) as stream:
            while piece := stream.read(PIECE):
                whole.update(piece)
                size += len(piece)
    return whole.hexdigest(), len(parts), size


def digests(outputs: DataFrame, column: str = "output") -> DataFrame:
    """(output, sha256, files, bytes) of each place that is named; sha256 is null where nothing is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = digest(uri)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([found[0]], pa.string()), pa.array([found[1]]), pa.array([found[2]])], names=["output", "sha256", "files", "bytes"])

    places = outputs.select(F.col(column).alias("output")).where("output is not null").distinct()
    return places.mapInArrow(run, "output string, sha256 string, files bigint, bytes bigint")


def prepare(spark: SparkSession, ledger: str, key: str, output: str, sha256: str, data: dict) -> str:
    """Records that ``output`` is about to become what has this digest. Durable when it returns; must be called before the output is put in place."""
    record = {"key": key, "output": output, "output_sha256": sha256, "prepared_at": datetime.now(timezone.utc).isoformat(), "data": json.dumps(data, sort_keys=True)}
    name = uuid.uuid4().hex
    system, target = file_system(spark, f"{ledger}/{name}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/.{name}.tmp")
    out = system.create(draft, False)
    try:
        out.write(bytearray((json.dumps(record) + "\n").encode()))
        out.hsync()
    finally:
        out.close()
    if not system.rename(draft, target):
        raise OSError(f"could not record {key}")
    return name


def records(spark: SparkSession, ledger: str) -> DataFrame:
    """What was prepared; records that can't be read, or lack a key, a place or a digest, are passed over."""
    system, place = file_system(spark, ledger)
    if not system.exists(place):
        return spark.createDataFrame([], SCHEMA)
    lines = spark.read.text(ledger).select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return lines.where("key is not null and output is not null and output_sha256 is not null")


def committed(spark: SparkSession, ledger: str, logged: DataFrame | None = None) -> DataFrame:
    """(key, output, prepared_at, data) of the batches that happened and, with ``logged`` keys, aren't logged yet.

    A batch happened if what stands at its place has the digest that was recorded: one whose rename never
    came, or that a later batch has replaced, doesn't count.
    """
    found = records(spark, ledger)
    if logged is not None:
        found = found.join(logged.select("key").distinct(), "key", "left_anti")
    now = digests(found).select("output", F.col("sha256").alias("output_sha256"))
    rows = found.join(now, ["output", "output_sha256"], "left_semi")
    # a batch that was prepared again after a crash counts once
    return rows.groupBy("key").agg(F.max_by(F.struct("output", "prepared_at", "data"), "prepared_at").alias("r")).select("key", "r.*")


def publish(rows: DataFrame, output: str, ledger: str, key: str, data: dict) -> str:
    """Writes a batch beside its place, records its digest, then puts it in place; returns the digest.

    A batch's place is its own: one that is taken raises. A crash before the record leaves nothing that counts; one after it leaves a record without its output,
    which doesn't count either. Once the output stands, recovery finds the batch even if nobody logged it.
    """
    spark = rows.sparkSession
    system, target = file_system(spark, output)
    if system.exists(target):
        raise FileExistsError(output)
    draft = f"{output}.{uuid.uuid4().hex}.tmp"
    rows.write.parquet(draft)
    sha256 = digests(spark.createDataFrame([(draft,)], "output string")).first()["sha256"]
    prepare(spark, ledger, key, output, sha256, data)
    if not system.rename(file_system(spark, draft)[1], target):
        raise OSError(f"could not put {output} in place")
    return sha256
