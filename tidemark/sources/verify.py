"""Verification of stored files without reading their rows: one row for each Parquet file, from its footer.

A file's footer has its schema, its number of rows and, for each column of each row group, the least and the
greatest value and the number of nulls. That tells an empty file, a missing or mistyped column and a ticker that
isn't the file's, for any amount of data. What footers can't tell (finite values, unique sessions) is asked of
the rows by ``quality``; ``report`` puts both together.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import NAMED_FILE, file_system, require_path

PRICE_COLUMNS = {"session_date": "time", "open": "number", "high": "number", "low": "number", "close": "number", "volume": "number"}
ARTICLE_COLUMNS = {"url": "text", "published_at": "any", "title": "text", "body": "text"}
LISTING_COLUMNS = {"ticker": "text", "url": "text", "list_date": "any"}
FOOTERS = "path string, named string, rows bigint, row_groups int, bytes bigint, columns array<struct<name:string,kind:string>>, ticker_low string, ticker_high string, ticker_nulls bigint, error string"


def kind(of: pa.DataType) -> str:
    if pa.types.is_integer(of) or pa.types.is_floating(of) or pa.types.is_decimal(of):
        return "number"
    if pa.types.is_temporal(of):
        return "time"
    return "text" if pa.types.is_string(of) or pa.types.is_large_string(of) else "other"


def footer(uri: str) -> dict:
    """What the footer of one file says; ``error`` if it has none that can be read."""
    found = {"rows": None, "row_groups": None, "bytes": None, "columns": None, "ticker_low": None, "ticker_high": None, "ticker_nulls": None, "error": None}
    try:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            found["bytes"] = file.size()
            meta = pq.ParquetFile(file).metadata
    except (OSError, pa.ArrowException) as error:
        return found | {"error": type(error).__name__}
    schema = meta.schema.to_arrow_schema()
    found |= {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": [{"name": f.name, "kind": kind(f.type)} for f in schema]}
    if "ticker" in schema.names and kind(schema.field("ticker").type) == "text":
        at = next(k for k in range(meta.num_columns) if meta.schema.column(k).path == "ticker")
        known = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(at).statistics) is not None and s.has_min_max]
        nulls = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        if known:
            found |= {"ticker_low": min(s.min for s in known), "ticker_high": max(s.max for s in known)}
        found["ticker_nulls"] = sum(s.null_count for s in nulls if s is not None and s.has_null_count)
    return found


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the Parquet files under a folder, at any depth; hidden ones aren't data. Only names go through the driver."""
    system, place = file_system(spark, require_path(spark, folder))
    walk, paths = system.listFiles(place, True), []
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName().endswith(".parquet") and path.getName()[0] not in "._":
            paths.append((path.toString(),))
    return spark.createDataFrame(paths, "path string")


def footers(files: DataFrame) -> DataFrame:
    """A row for each file: what it is named after, and what its footer says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [footer(uri) for uri in batch.column("path").to_pylist()]
            types = {"rows": pa.int64(), "row_groups": pa.int32(), "bytes": pa.int64(), "columns": pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())])), "ticker_low": pa.string(), "ticker_high": pa.string(), "ticker_nulls": pa.int64(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("named"), *(pa.array([r[k] for r in rows], t) for k, t in types.items())], names=["path", "named", *types])

    # the outermost name that ends in .parquet: a table may be a file or a folder of parts
    named = F.regexp_extract("path", NAMED_FILE, 1)
    return files.select("path", named.alias("named")).mapInArrow(run, FOOTERS)


def problems(found: DataFrame, needed: dict[str, str], by_ticker: bool = False) -> DataFrame:
    """(path, named, rows, problems): what is wrong with each file, an empty list if nothing is."""
    kinds = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"], c["kind"])))
    checks = [
        F.when(F.col("error").isNotNull(), F.lit("unreadable")),
        F.when(F.col("rows") == 0, F.lit("empty")),
    ]
    for name, want in needed.items():
        has = F.try_element_at(kinds, F.lit(name))
        checks.append(F.when(F.col("columns").isNotNull() & has.isNull(), F.lit(f"{name} missing")))
        if want != "any":
            checks.append(F.when(has != want, F.concat(F.lit(f"{name} is no {want} but "), has)))
    if by_ticker:
        has = F.try_element_at(kinds, F.lit("ticker"))
        checks.append(F.when(F.col("columns").isNotNull() & has.isNull(), F.lit("no ticker column")))
        checks.append(F.when((F.col("ticker_low") != F.col("named")) | (F.col("ticker_high") != F.col("named")), F.lit("ticker is not the file's")))
    return found.select("path", "named", "rows", F.array_compact(F.array(*checks)).alias("problems"))


#: What is told but doesn't make a file invalid.
TOLERATED = ("no ticker column",)


def verified(spark: SparkSession, folder: str, needed: dict[str, str], by_ticker: bool = False, expected: tuple[str, ...] = ()) -> DataFrame:
    """(named, files, rows, problems, ok) of the tables under a folder, and of expected ones that aren't there."""
    every = problems(footers(stored_files(spark, folder)), needed, by_ticker)
    # of a table of parts, an empty part is no empty table
    tables = every.groupBy("named").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("_p"))
    told = tables.select("named", "files", "rows", F.when(F.col("rows") > 0, F.array_remove("_p", "empty")).otherwise(F.col("_p")).alias("problems"))
    if expected:
        wanted = spark.createDataFrame([(n,) for n in expected], "named string").join(told, "named", "left_anti")
        told = told.unionByName(wanted.select("named", F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("rows"), F.array(F.lit("missing")).alias("problems")))
    return told.withColumn("ok", F.forall("problems", lambda p: p.isin(*TOLERATED)))
