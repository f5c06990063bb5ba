"""Trajectories: segment classification, interpolation, replay paths, positions at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.functions.timeutil import plus_seconds
from tramline.operators.asof import asof_backward, asof_forward


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def classified(dt: Column, speed: Column, first: Column, max_gap: float, max_speed: float) -> dict[str, Column]:
    """point_state, confidence, interpolation_method and gap_reason of a point, from its step; the rules in their order."""
    reason = F.when(first, None).when(dt <= 0, "out_of_order").when(dt > max_gap, "dropout").when(speed > max_speed, "speed_violation")
    return {
        "gap_reason": reason,
        "point_state": F.when(reason.isNull(), "observed").otherwise("invalid_gap"),
        "confidence": F.when(reason.isNull(), "high").otherwise("low"),
        "interpolation_method": F.when(~first & reason.isNull(), "linear"),
    }


def segments(df: DataFrame, order: list[str], max_gap: float = 45.0, max_speed: float = 40.0) -> DataFrame:
    """Each point against the one that arrived before it (order), invalid or not."""
    w = Window.partitionBy("vehicle_id").orderBy(*order)
    before = df.withColumn("before", F.lag(F.struct("time", "lat", "lon")).over(w))
    dt = micros_between(F.col("before.time"), F.col("time")) / F.lit(1e6)
    distance = haversine_m(F.col("before.lat"), F.col("before.lon"), F.col("lat"), F.col("lon"))
    found = before.withColumns({"dt": dt, "distance": distance}).withColumn("step_speed", F.try_divide("distance", "dt"))
    return found.withColumns(classified(F.col("dt"), F.col("step_speed"), F.col("before").isNull(), max_gap, max_speed))


def interpolated(found: DataFrame, step: int = 1, shortest: float = 2.0, longest: float = 30.0) -> DataFrame:
    """Points every step seconds strictly inside valid segments of shortest to longest seconds, on the straight line."""
    last = F.ceil(F.col("dt").cast("long") / F.lit(step)).cast("int") - 1
    usable = (F.col("point_state") == "observed") & (F.col("dt") >= shortest) & (F.col("dt") <= longest) & (last >= 1)
    each = found.filter(usable).withColumn("k", F.explode(F.sequence(F.lit(1), last)))
    share = F.col("k") * step / F.col("dt")
    between = lambda c: F.col(f"before.{c}") + (F.col(c) - F.col(f"before.{c}")) * share
    return each.select(
        "event_id", "vehicle_id", plus_seconds(F.col("before.time"), (F.col("k") * step).cast("int")).alias("time"), between("lat").alias("lat"), between("lon").alias("lon"),
        F.lit("interpolated").alias("point_state"), F.lit("medium").alias("confidence"), F.lit("linear").alias("interpolation_method"), F.lit(None).cast("string").alias("gap_reason"),
        "route_id", "trip_id", "mode",
    )


POINTS = ["event_id", "vehicle_id", "time", "lat", "lon", "point_state", "confidence", "interpolation_method", "gap_reason", "route_id", "trip_id", "mode"]


def trajectory(found: DataFrame, step: int = 1, shortest: float = 2.0, longest: float = 30.0) -> DataFrame:
    """Observed and interpolated points."""
    return found.select(*POINTS).unionByName(interpolated(found, step, shortest, longest))


def display_line(route: Column, trip: Column) -> Column:
    """Route without its leading L, else the trip, else unknown."""
    bare = F.when(F.startswith(route, F.lit("L")), F.substring(route, 2, 1000)).otherwise(route)
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(trip, F.lit("")), F.lit("unknown"))


def replay_paths(points: DataFrame, start: Column, keep_interpolated: bool = True) -> DataFrame:
    """One row per vehicle: its path of [lon, lat, milliseconds since start] and the attributes of its last point."""
    shown = points.filter(F.col("point_state") != "invalid_gap")
    if not keep_interpolated:
        shown = shown.filter(F.col("point_state") != "interpolated")
    t = F.floor(micros_between(start, F.col("time")) / 1000).cast("long")
    return shown.groupBy("vehicle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("time").alias("at"), "lon", "lat", t.alias("t")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["t"].alias("t"))).alias("path"),
        F.max_by(F.struct(display_line(F.col("route_id"), F.col("trip_id")).alias("line"), "mode"), F.struct("time", "event_id")).alias("last"),
    ).select("vehicle_id", "path", "last.*")


def position_at(probes: DataFrame, points: DataFrame, probe_time: str, stale_after: int = 300) -> DataFrame:
    """Where each probed vehicle is at its time: on the line between the points around it.

    Before the path: its first point. Behind its end: its last point, stale, and nothing over stale_after seconds later.
    """
    t = F.col(probe_time)
    w = Window.partitionBy("vehicle_id").orderBy("time")
    # Each point with the next one; the segment that holds a probe is the last that began.
    path = points.select("vehicle_id", "time", "lat", "lon", F.lead(F.struct("time", "lat", "lon")).over(w).alias("next"))
    held = asof_backward(probes, path, ["vehicle_id"], t, F.col("time"), ["lat", "lon", "next"]).withColumnRenamed("match", "__held")
    ahead = asof_forward(held, path, ["vehicle_id"], t, F.col("time"), ["lat", "lon"])
    found = F.col("__held")
    past, whole = micros_between(found["__at"], t), micros_between(found["__at"], found["next"]["time"])
    share = F.when(whole > 0, past / whole).otherwise(F.lit(0.0))
    inside, gone = found["next"].isNotNull(), past > stale_after * 1_000_000

    def value(c: str) -> Column:
        between = found[c] + (found["next"][c] - found[c]) * share
        return F.when(found.isNull(), F.col("match")[c]).when(inside, between).when(~gone, found[c]).alias(c)

    stale = F.coalesce(found.isNotNull() & ~inside & (past > 0), F.lit(False))
    return ahead.select(*probes.columns, value("lat"), value("lon"), stale.alias("stale"))
