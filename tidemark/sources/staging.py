"""Derived relations that many queries share: written once to the shared folder, then read back.

A relation is made for one set of input files: the table's name holds a digest of the files' names,
sizes and times, so changed input makes a new one. The folder is that of ``spark.checkpoint.dir``, which
driver and executors share; a temporary one only in local mode. Reading a table back cuts the lineage
and survives lost executors.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files under the paths."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
        found += [f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def once(spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The relation ``name`` over the input files of ``paths``, made by ``make`` if this application hasn't yet."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_tables"):
        context._tidemark_tables = {}
    key = (name, state_of(spark, paths))
    if key not in context._tidemark_tables:
        made, path = make(), f"{shared_dir(spark)}/{name}-{key[1]}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        context._tidemark_tables[key] = (path, made.schema)
    path, schema = context._tidemark_tables[key]
    return spark.read.schema(schema).parquet(path)


#: Folders that ``staged`` made in a thread, by the blocks of ``clearing`` that are open there.
OPEN = threading.local()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(OPEN, "blocks", []):
        made.append(path)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what ``staged`` wrote within it, in this thread, and is still on the list it gives."""
    made: list[str] = []
    OPEN.blocks = [*getattr(OPEN, "blocks", []), made]
    try:
        yield made
    finally:
        OPEN.blocks = [b for b in OPEN.blocks if b is not made]
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
