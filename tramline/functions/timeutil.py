"""Time buckets, second differences, calendar fields and lenient casts, all as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
#: Bucket origins: DuckDB's time_bucket, PostgreSQL's date_bin as it is called, and the epoch.
MONDAY, MILLENNIUM = "2000-01-03 00:00:00", "2000-01-01 00:00:00"


def ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since the epoch; a fraction is cut off."""
    return F.timestamp_diff("SECOND", ntz(EPOCH), time)


def plus_seconds(time: Column, seconds: Column | int) -> Column:
    return F.timestamp_add("SECOND", seconds if isinstance(seconds, Column) else F.lit(seconds), time)


def bucket(time: Column, seconds: int, origin: str = MILLENNIUM) -> Column:
    """Start of the bucket of time; buckets are seconds wide and one starts at origin."""
    since = F.timestamp_diff("SECOND", ntz(origin), time)
    # Times before the origin with a fraction of a second round down too.
    below = F.when(F.timestamp_add("SECOND", since, ntz(origin)) > time, since - 1).otherwise(since)
    return F.timestamp_add("SECOND", F.floor(below / seconds).cast("long") * seconds, ntz(origin))


def second_diff(start: Column, end: Column) -> Column:
    """Second boundaries between two times."""
    return epoch_seconds(end) - epoch_seconds(start)


def day_of_week(time: Column, iso: bool = False) -> Column:
    """0 for Sunday to 6; iso: 1 for Monday to 7."""
    return F.weekday(time) + 1 if iso else F.dayofweek(time) - 1


def lenient_int(text: Column) -> Column:
    """Text to int by way of double, half away from zero; null if it is no number."""
    return F.round(text.try_cast("double")).try_cast("int")


def truncated_int(text: Column) -> Column:
    """Text to int by way of double, cut off."""
    return F.when(~F.lower(text).isin("true", "false"), text.try_cast("double")).try_cast("int")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
