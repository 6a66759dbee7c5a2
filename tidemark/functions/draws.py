"""Draws that depend on their keys only, the same in every partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts) -> Column:
    """A number in [0, 2^32) from the text of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw(modulus, *parts) -> Column:
    return key_hash(*parts) % modulus


def uniform(*parts) -> Column:
    """In (0, 1), never an end."""
    return (key_hash(*parts) + 0.5) / float(1 << 32)


def sql_hash(*parts: str) -> str:
    """The same number in DuckDB's SQL."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"(({sql_hash(*parts)} + 0.5) / 4294967296.0)"
