"""A catalog of queries with their SQL twins, and the rounding both sides share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import finite

#: Decimal places of doubles in results: sums of doubles depend on their order beyond these.
PLACES = 8


def sql_round(x: Column, places: int = PLACES) -> Column:
    """A double scaled, rounded half away from zero and scaled back, as in SQL; Spark's own ``round`` takes the shortest decimal that names the double."""
    scale = 10.0**places
    found = F.round(x * scale, 0) / scale
    return F.when(finite(found), found).otherwise(x)


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, ctes: tuple[str, ...] = (), doubles: str = "", recursive: bool = False, places: int = PLACES):
        """Registers the function under its name. ``doubles``: columns that both sides round."""
        names = doubles.split()

        def register(run: Callable[[SparkSession, str], DataFrame]):
            def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
                return run(spark, sf_dir).withColumns({c: sql_round(F.col(c).cast("double"), places) + F.lit(0.0) for c in names}) if names else run(spark, sf_dir)

            self.queries[run.__name__] = rounded
            if sql is not None:
                body = sql.strip()
                if names:
                    body = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}' for c in names)}) FROM ({body})"
                found = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + body
                # a column of ours has the name of a keyword
                self.sql[run.__name__] = re.sub(r'(?<!")\bwindow\b(?!")', '"window"', found)
            return run

        return register
