"""Data-quality checks as aggregates over the tables: one row for each date and check, and statuses made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Worst last; a status is the worst of its parts.
STATUSES = ("fresh", "stale", "missing", "error")


def age_seconds(latest: Column, now: Column) -> Column:
    """Whole seconds from latest to now, 0 at least; null without a latest time."""
    return F.when(latest.isNotNull(), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", latest, now)))


def freshness(latest: Column, rows: Column, now: Column, limit: int) -> Column:
    """fresh, stale (older than limit seconds) or missing (no time, or no rows)."""
    return F.when(latest.isNull() | (rows == 0), "missing").when(age_seconds(latest, now) > limit, "stale").otherwise("fresh")


def check_rows(df: DataFrame, keys: list[str], checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, check and status: passed where the column is true, else the status named beside it."""
    statuses = [F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise(bad).alias("status")) for name, (ok, bad) in checks.items()]
    return df.select(*keys, F.explode(F.array(*statuses)).alias("c")).select(*keys, "c.*")


def every_date(df: DataFrame, day: str = "service_date") -> DataFrame:
    """All dates from the first to the last of df, those without rows too."""
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(F.explode(F.sequence("first", "last")).alias("service_date"))


def position_checks(df: DataFrame, dates: DataFrame, now: Column, least_rows: int, most_age: int) -> DataFrame:
    """Per date that should be there: enough rows, its files, vehicles and partition, a latest time, and how old that is."""
    read = df.select("service_date", "vehicle_id", "time", F.input_file_name().alias("file"))
    daily = read.groupBy("service_date").agg(F.count("*").alias("n"), F.countDistinct("vehicle_id").alias("vehicles"), F.max("time").alias("latest"), F.countDistinct("file").alias("files"))
    return check_rows(dates.join(daily, "service_date", "left"), ["service_date"], {
        "rows": (F.col("n") >= least_rows, "failed"), "files": (F.col("files") > 0, "failed"), "vehicles": (F.col("vehicles") > 0, "failed"), "partition": (F.col("n").isNotNull(), "failed"),
        "max_time": (F.col("latest").isNotNull(), "failed"), "freshness": (age_seconds(F.col("latest"), now) <= most_age, "warning"),
    })


def feature_checks(features: DataFrame, files: DataFrame, dates: DataFrame, least_rows: int) -> DataFrame:
    """Per date that should be there: its partition, enough rows, bytes of its files (service_date, length), any label."""
    daily = features.groupBy("service_date").agg(F.count("*").alias("n"), F.count("target_delay").alias("labelled"))
    sizes = files.groupBy("service_date").agg(F.sum("length").alias("bytes"))
    return check_rows(dates.join(daily, "service_date", "left").join(sizes, "service_date", "left"), ["service_date"], {
        "partition": (F.col("n").isNotNull(), "failed"), "rows": (F.col("n") >= least_rows, "failed"), "bytes": (F.col("bytes") > 0, "failed"), "labelled": (F.col("labelled") > 0, "warning"),
    })


def alert_checks(alerts: DataFrame, runs: DataFrame, now: Column, most_age: int, source_latest: Column, lag: int, required: list[str], strict: bool = False) -> DataFrame:
    """Alerts of each of runs (service_date): any rows, else a warning and nothing more (failed if strict); columns, a latest time, freshness.

    Stale alerts only warn if the source is stale itself and they follow it.
    """
    daily = alerts.groupBy("service_date").agg(F.count("*").alias("n"), F.max("position_time").alias("latest"))
    found = runs.join(daily, "service_date", "left").withColumn("source", source_latest)
    some = found.filter("n > 0")
    fresh = age_seconds(F.col("latest"), now) <= most_age
    follows = (age_seconds(F.col("source"), now) > most_age) & (age_seconds(F.col("latest"), F.col("source")) <= lag)
    complete = F.lit(not set(required) - set(alerts.columns))
    any_rows = check_rows(found, ["service_date"], {"rows": (F.col("n") > 0, "failed" if strict else "warning")})
    rest = check_rows(some, ["service_date"], {"columns": (complete, "failed"), "latest_time": (F.col("latest").isNotNull(), "failed")})
    status = F.when(F.coalesce(fresh, F.lit(False)), "passed").when(F.coalesce(follows, F.lit(False)), "warning").otherwise("failed")
    return any_rows.unionByName(rest).unionByName(some.select("service_date", F.lit("freshness").alias("check"), status.alias("status")))


def report(history: DataFrame) -> DataFrame:
    """Checks by status and the verdict: a row for each date, and one without a date for all."""
    n = lambda s: F.count_if(F.col("status") == s)
    verdict = F.when(n("failed") > 0, "failed").when(n("warning") > 0, "warning").otherwise("passed")
    return history.rollup("service_date").agg(n("passed").alias("passed"), n("warning").alias("warnings"), n("failed").alias("failed"), verdict.alias("verdict"))


def alert_status(rows: Column, latest: Column, made: Column, error: Column, now: Column, limit: int) -> Column:
    """Of a scoring run: error, missing (no rows), stale (made no one knows when or too long ago, or rows without a time) or fresh."""
    old = made.isNull() | (age_seconds(made, now) > limit) | latest.isNull()
    return F.when(error.isNotNull(), "error").when(F.coalesce(rows, F.lit(0)) == 0, "missing").when(old, "stale").otherwise("fresh")


def worst(df: DataFrame, keys: list[str]) -> DataFrame:
    """The worst status of each key: error, missing, stale, fresh."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return df.groupBy(*keys).agg(F.max_by("status", place).alias("status"))


def near_latest(df: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Rows and vehicles within seconds of the last time, and of now."""
    last = df.agg(F.max("time").alias("last"))
    each = df.crossJoin(F.broadcast(last))
    near, recent = F.col("time") >= F.timestamp_add("SECOND", F.lit(-seconds), F.col("last")), F.col("time") >= F.timestamp_add("SECOND", F.lit(-seconds), now)
    return each.agg(
        F.count("*").alias("rows"), F.max("last").alias("latest"), F.count_if(near).alias("near_rows"), F.countDistinct(F.when(near, F.col("vehicle_id"))).alias("near_vehicles"),
        F.count_if(recent).alias("recent_rows"), F.countDistinct(F.when(recent, F.col("vehicle_id"))).alias("recent_vehicles"),
    )
