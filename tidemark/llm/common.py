"""Shared plumbing of the corpus operators: the shared folder, checked broadcasts and Arrow maps.

Conventions that hold for every operator here:

* A null text counts as the empty text unless the operator says otherwise.
* ``doc_id`` and ``text`` are looked up by name; every other column is carried or pruned.
* A column of the input that has the name of a computed column is replaced by it.
"""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import sys
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of ids, or of similarly narrow rows, up to which a side may be broadcast (about 32 MB).
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch. Executors hold batches outside the heap, in memory that the system
#: hardly gets back, and workers hold two at a time.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


#: Bytes that a task's memory of computed values may hold.
MEMORY_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where it is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for own in getattr(spark.sparkContext, "_tidemark_stages", ()):
        own.append(path)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the scratch folders that were made within it and are still on the list it gives.

    What leaves the block must not read them but for those that are taken off the list (``kept``).
    """
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_stages"):
        context._tidemark_stages = []
    own: list[str] = []
    context._tidemark_stages.append(own)
    try:
        yield own
    finally:
        context._tidemark_stages = [x for x in context._tidemark_stages if x is not own]
        for path in own:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(made: list[str], table: DataFrame) -> DataFrame:
    """``table``, a staged one, whose folder is taken off the list of those to be deleted."""
    made.remove(table.staged_at)
    return table


class Memory(dict):
    """Values of ``compute`` by key, remembered up to about ``most`` bytes; for use in one task.

    At half of that the values become the older generation; of those, the ones in use come back.
    """

    every: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, compute: Callable, most: int = MEMORY_BYTES) -> None:
        super().__init__()
        self.compute, self.most, self.held, self.older = compute, most, 0, {}
        Memory.every.add(self)

    __hash__ = object.__hash__

    def __missing__(self, key: Hashable):
        found = self.older.pop(key, None)
        if found is None:
            found = self.compute(key)
        size = sys.getsizeof(key) + sys.getsizeof(found) + 100
        if size < self.most >> 8:
            self.held += size
            if 2 * self.held > self.most:
                self.older = dict(self)
                self.clear()
                self.held = size
            self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.held, self.older = 0, {}


def give_back() -> None:
    """At the end of a task: forgets what was remembered and gives free memory back to the system."""
    for memory in list(Memory.every):
        memory.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it decides for itself


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds what Python holds."""
    for key, most in BATCH_LIMITS.items():
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(path)
    context._tidemark_shipped = True


def lookup_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; otherwise Spark shuffles the join."""
    return F.broadcast(df) if rows <= limit else df


def map_text(docs: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], uses: str = "text", gather: int = 0) -> DataFrame:
    """Appends computed columns to each row in Arrow batches.

    ``make()`` runs once in each task and returns a function from the values of ``uses`` (a list) to one
    list for each of ``fields``. With ``gather`` it gets batches together up to about so many bytes.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    frame = docs if uses.lower() not in new else docs.withColumnRenamed(uses, uses := f"_{uses}_in")
    schema = T.StructType(kept + fields)
    names, targets = [f.name for f in kept], [(f.name, to_arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, held, size = make(), [], 0

        def computed() -> Iterator[pa.RecordBatch]:
            found, at = compute([t for b in held for t in b.column(b.schema.get_field_index(uses)).to_pylist()]), 0
            for batch in held:
                arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
                arrays += [pa.array(v[at : at + batch.num_rows], t) for v, (_, t) in zip(found, targets, strict=True)]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in targets])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= gather:
                yield from computed()
                held, size = [], 0
        if held:
            yield from computed()

    return mapped(frame, run, schema)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """What ``fit`` makes of the rows of a sample, whose size a parameter bounds.

    One task does it, with the threads that Spark gives to a task: the driver's linear algebra would
    take all cores of its machine for matrices that are too small for that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = mapped(sample.repartition(1), run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([])


def locator() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def located(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows with neutral column names and their content locator, and the new names of ``names``.

    Rows that aren't read from Parquet files are first written to some.
    """
    plain = [f"_c{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, plain, strict=True))
    try:
        found = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *locator())
    except AnalysisException:
        # a column of the input may hide the files' own metadata
        kept = [own[c] if c.lower() == "_metadata" else c for c in docs.columns]
        found = staged(docs.toDF(*kept), "located").toDF(*kept)
        found = found.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(kept, plain, strict=True)], *locator())
    return found, [own[n] for n in names]


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with neutral column names, which clash with no result, and the new names of ``names``."""
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), [own[n] for n in names]


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return simple[type(kind)]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def fold(df: DataFrame, column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null ids go to fold 0."""
    return F.coalesce(F.pmod(F.crc32(df[column].cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)
