"""Sessions, cutoffs and the forward as-of join of news to the session that can first know them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import local_time, stored_time
from tidemark.schemas import MAPPED, STATUSES, ZONE, refuse, require_columns

CUTOFF, OPEN = "15:00", "09:00"
MAX_ROLL_DAYS = 12
#: Rows of a calendar that is broadcast to the news.
BROADCAST_ROWS = 1_000_000


def seconds(clock: str) -> int:
    """Seconds of the day of "HH:MM"."""
    hours, minutes = clock.split(":")
    if not (0 <= int(hours) < 24 and 0 <= int(minutes) < 60):
        raise ValueError(f"no time of day: {clock!r}")
    return int(hours) * 3600 + int(minutes) * 60


def to_local(rows: DataFrame, column: str, zone: str = ZONE) -> Column:
    """The column as wall time in the study's zone: instants are converted, wall times are taken as they
    are, and of texts those with an offset are converted and the others taken as they are."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return local_time(F.col(column), zone)
    if isinstance(kind, T.StringType):
        return stored_time(F.col(column), zone)
    return F.col(column).cast("timestamp_ntz")


def session_as_of(session: Column, cutoff: str = CUTOFF) -> Column:
    """The instant a session's information is cut off, as local wall time."""
    return session.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds(cutoff)))


def trading_sessions(prices: DataFrame, time: str = "time") -> DataFrame:
    """The calendar is data: the distinct (ticker, session_date) of the price rows; a repeated session raises."""
    require_columns(prices, "ticker", time)
    dated = prices.select("ticker", F.to_date(time).alias("session_date"))
    refuse(dated.groupBy("ticker", "session_date").count().where("count > 1"), "repeated session")
    return dated


def effective_date(published: Column, cutoff: str = CUTOFF) -> Column:
    """The local date, or the next one if the clock is past the cutoff; parts of a second don't count."""
    clock = F.hour(published) * 3600 + F.minute(published) * 60 + F.floor(F.second(published))
    return F.date_add(F.to_date(published), F.when(clock > seconds(cutoff), 1).otherwise(0))


def few(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``limit`` rows; otherwise Spark shuffles the join."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def session_days(sessions: DataFrame, max_roll_days: int) -> DataFrame:
    """(ticker, effective, session): each day that rolls to a session, at most ``max_roll_days`` before it.

    Made from the calendar alone, so that news are read once, where they are mapped.
    """
    days = sessions.where("session_date is not null").select("ticker", F.col("session_date").alias("session")).distinct()
    before = F.lag("session").over(Window.partitionBy("ticker").orderBy("session"))
    first = F.greatest(F.date_add(before, 1), F.date_sub("session", max_roll_days))
    spans = days.withColumn("_first", first).where(F.col("_first") <= F.col("session"))
    return spans.select("ticker", F.explode(F.sequence("_first", "session")).alias("effective"), "session")


def align_forward(news: DataFrame, sessions: DataFrame, cutoff: str = CUTOFF, max_roll_days: int = MAX_ROLL_DAYS, published: str = "published") -> DataFrame:
    """Adds observation_date, as_of and mapping_status to every row of ``news``.

    ``published`` is local wall time (null: unparseable). Precedence: invalid, no_calendar, unmapped,
    stale (rolled more than ``max_roll_days`` days from the effective date), then same_session if the
    session is the local date, else next_session.
    """
    require_columns(news, "ticker", published)
    dated = news.withColumn("_effective", effective_date(F.col(published), cutoff))
    days = few(session_days(sessions, max_roll_days).withColumnRenamed("ticker", "_t"))
    ends = few(sessions.groupBy(F.col("ticker").alias("_e")).agg(F.max("session_date").alias("last")))
    found = dated.join(days, F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("_effective") == F.col("effective")), "left")
    found = found.join(ends, F.col("ticker").eqNullSafe(F.col("_e")), "left")
    status = (
        F.when(F.col("_effective").isNull(), "invalid")
        .when(F.col("last").isNull(), "no_calendar")
        .when(F.col("_effective") > F.col("last"), "unmapped")
        .when(F.col("session").isNull(), "stale")
        .when(F.col("session") == F.to_date(published), "same_session")
        .otherwise("next_session")
    )
    mapped = status.isin(*MAPPED)
    return found.select(
        *news.columns,
        F.when(mapped, F.col("session")).alias("observation_date"),
        F.when(mapped, session_as_of(F.col("session"), cutoff)).alias("as_of"),
        status.alias("mapping_status"),
    )


def between_sessions(news: DataFrame, first: date, last: date, max_roll_days: int = MAX_ROLL_DAYS, published: str = "published") -> DataFrame:
    """The news that can be mapped to sessions from ``first`` to ``last``, chosen before they are joined with anything.

    An effective date is the local date or the next one, and rolls ``max_roll_days`` days at most.
    """
    since, until = first - timedelta(days=max_roll_days + 1), last + timedelta(days=1)
    wall = F.col(published).cast("timestamp_ntz")
    return news.where((wall >= F.lit(since).cast("timestamp_ntz")) & (wall < F.lit(until).cast("timestamp_ntz")))


def alignment_report(aligned: DataFrame) -> DataFrame:
    """One row: rows, mapped, dropped and the number of rows of each status, zeros included."""
    of = lambda s: F.count_if(F.col("mapping_status") == s)
    mapped = F.count_if(F.col("mapping_status").isin(*MAPPED))
    return aligned.agg(F.count(F.lit(1)).alias("n_rows"), mapped.alias("n_mapped"), (F.count(F.lit(1)) - mapped).alias("n_dropped"), *[of(s).alias(s) for s in STATUSES])


def last_known(facts: DataFrame, at: DataFrame, value: str, day: str = "session_date", on: str = "observation_date") -> DataFrame:
    """Backward as-of: for each (ticker, ``on``) the value of the last day up to it.

    Requests and facts are ordered together once for each ticker, so no request meets all facts.
    """
    known = F.struct(F.col(day).alias("d"), F.col(value).alias("v"))
    both = at.select("ticker", F.col(on).alias("_on"), F.lit(None).cast(known_type(facts, day, value)).alias("_f"), F.lit(1).alias("_asks")).distinct().unionByName(
        facts.select("ticker", F.col(day).alias("_on"), known.alias("_f"), F.lit(0).alias("_asks"))
    )
    past = Window.partitionBy("ticker").orderBy("_on", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_f", ignorenulls=True).over(past)).where("_asks = 1")
    return found.select("ticker", F.col("_on").alias(on), F.col("_f.v").alias(f"last_{value}"), F.col("_f.d").alias(f"last_{day}"))


def known_type(facts: DataFrame, day: str, value: str) -> T.StructType:
    return T.StructType([T.StructField("d", facts.schema[day].dataType), T.StructField("v", facts.schema[value].dataType)])
