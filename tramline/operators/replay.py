"""Replay: time windows, optional filters, keyset pages, and which vehicles are shown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cursor = tuple[datetime, str]


def time_window(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Half open: start belongs to it, end doesn't."""
    if start is not None:
        df = df.filter(F.col("time") >= start)
    return df if end is None else df.filter(F.col("time") < end)


def optional(df: DataFrame, vehicle: str | None = None, mode: str | None = None) -> DataFrame:
    for name, value in (("vehicle_id", vehicle), ("mode", mode)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, size: int, after: Cursor | None = None) -> tuple[DataFrame, bool, Cursor | None, int | None]:
    """Rows in the order of time and vehicle behind the cursor; whether there are more; the cursor for those; the number of all rows.

    That number is counted for the first page only. The cursor's comparison is written out, so that its bound on time reaches the scan.
    """
    total = df.count() if after is None else None
    if after is not None:
        t, v = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col("time") >= t) & ((F.col("time") > t) | (F.col("vehicle_id") > v)))
    ordered = df.orderBy("time", "vehicle_id")
    keys = ordered.select("time", "vehicle_id").limit(size + 1).collect()  # a page of keys
    more = len(keys) > size
    cursor = (keys[size - 1]["time"], keys[size - 1]["vehicle_id"]) if more else None
    return ordered.limit(size), more, cursor, total


def vehicle_filter(points: DataFrame, mode: str | None = None, line: str | None = None, keep_interpolated: bool = True) -> DataFrame:
    """Points of a mode and of lines that contain a text; vehicles whose last point is an invalid gap are hidden."""
    last = points.groupBy("vehicle_id").agg(F.max_by("point_state", F.struct("time", "event_id")).alias("last_state"))
    shown = points.join(last.filter("last_state <> 'invalid_gap'"), "vehicle_id", "left_semi")
    if mode is not None:
        shown = shown.filter(F.col("mode") == mode)
    if line is not None:
        shown = shown.filter(F.lower("line").contains(line.lower()))
    return shown if keep_interpolated else shown.filter("point_state <> 'interpolated'")
