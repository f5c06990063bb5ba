"""Alert policy, persistence, cooldown, and vehicles beside an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_policy(df: DataFrame, run: str, threshold: float, floor: float, cap: int, ties: str = "vehicle_id") -> DataFrame:
    """Which raw alerts of a run become alerts: those at the floor or over it, the cap riskiest of them (cap <= 0: all)."""
    raw = F.col("risk") >= threshold
    eligible = raw & (F.col("risk") >= floor)
    place = F.row_number().over(Window.partitionBy(run, eligible).orderBy(F.desc("risk"), ties))
    rank = F.when(eligible, place)
    kept = eligible & (rank <= cap) if cap > 0 else eligible
    reason = F.when(~raw, "below_threshold").when(~eligible, "below_min_risk").when(kept, "selected").otherwise("suppressed_by_cap")
    return df.withColumns({"policy_raw": raw, "alert_rank": F.when(kept, rank), "alert": kept, "reason": reason})


def select_for_storage(df: DataFrame, run: str, cap: int, alert: str = "alert", ties: str = "vehicle_id") -> DataFrame:
    """All alerts, and the riskiest others up to cap rows of a run; cap <= 0 keeps all."""
    if cap <= 0:
        return df
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(alert), F.desc("risk"), ties))
    return df.withColumn("__place", place).filter((F.col("__place") <= cap) | F.col(alert)).drop("__place")


def cooldown(alerts: DataFrame, minutes: float, time: str = "position_time") -> DataFrame:
    """Alerts that come minutes or more after the last kept one of their vehicle. Rows without either are kept.

    An alert that comes minutes or more after the alert before it is kept whatever was kept before, so a vehicle's
    history falls into runs that don't depend on each other, and only a run is folded at once. Of alerts of one vehicle
    and time, the one with the least hash of its fields comes first.
    """
    if minutes <= 0:
        return alerts
    gap = F.lit(int(minutes * 60_000_000))
    known = F.col("vehicle_id").isNotNull() & F.col(time).isNotNull()
    row = F.struct(*alerts.columns)
    timed = alerts.filter(known).select(F.col("vehicle_id").alias("__vehicle"), F.unix_micros(F.col(time).cast("timestamp")).alias("__us"), F.xxhash64(*alerts.columns).alias("__tie"), row.alias("__row"))
    order = Window.partitionBy("__vehicle").orderBy("__us", "__tie")
    starts = F.coalesce(F.col("__us") - F.lag("__us").over(order) >= gap, F.lit(True)).cast("int")
    runs = timed.withColumn("__starts", starts).withColumn("__run", F.sum("__starts").over(order))
    each = runs.groupBy("__vehicle", "__run").agg(F.sort_array(F.collect_list(F.struct("__us", "__tie", "__row"))).alias("__all"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.slice("__all", 1, 0).alias("kept"))
    keep = lambda acc, x: F.when(acc["last"].isNull() | (x["__us"] - acc["last"] >= gap), F.struct(x["__us"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = each.select(F.explode(F.aggregate("__all", start, keep)["kept"]).alias("__one"))
    return kept.select("__one.__row.*").unionByName(alerts.filter(~known))


def volume(df: DataFrame, alert: str, time: str) -> DataFrame:
    """Alerts, their share, their vehicles, and how many come a day and an hour."""
    span = (F.max(F.unix_micros(F.col(time).cast("timestamp"))) - F.min(F.unix_micros(F.col(time).cast("timestamp")))) / F.lit(3.6e9)
    n = F.count_if(F.col(alert))
    return df.agg(
        n.alias("alerts"), (n / F.count("*")).alias("share"), F.countDistinct(F.when(F.col(alert), F.col("vehicle_id"))).alias("vehicles"),
        F.try_divide(n, span).alias("per_hour"), F.try_divide(n * 24, span).alias("per_day"),
    )


def stop_center(last: Column, following: Column) -> Column:
    """Mean of both stop numbers, else the one there is."""
    return F.when(last.isNotNull() & following.isNotNull(), (last + following) / F.lit(2.0)).otherwise(F.coalesce(last, following).cast("double"))


def on_route(df: DataFrame) -> DataFrame:
    """df with the route that vehicles are compared on and the place along it."""
    return df.withColumns({"route_key": F.coalesce("route_id", "line"), "center": stop_center(F.col("last_stop_sequence"), F.col("next_stop_sequence"))})


def propagation(df: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """Of every vehicle, the others of its run and route by band: how many, mean delay of those that have one, how many rise.

    Vehicles further along are downstream, those behind upstream, all others (those without a place too) the same. Sums
    by place are summed along the route, so no two vehicles are ever paired.
    """
    delay = F.col("delay").cast("double")
    rows = on_route(df).filter(F.col(run).isNotNull() & F.col("route_key").isNotNull()).withColumns({"finite": F.when(F.abs(delay) < float("inf"), delay), "rises": F.coalesce(F.col("delay_delta_1") > 0, F.lit(False)).cast("long")})
    sums = {"n": F.count("*"), "f": F.count("finite"), "s": F.coalesce(F.sum("finite"), F.lit(0.0)), "r": F.sum("rises")}
    cells = rows.groupBy(run, "route_key", "center").agg(*[c.alias(k) for k, c in sums.items()])
    route = Window.partitionBy(run, "route_key")
    before = route.orderBy("center").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the route has places
    placed = F.col("center").isNotNull()
    found = cells.select(
        run, "route_key", "center",
        *[F.when(placed, F.coalesce(F.sum(F.when(placed, F.col(k))).over(before), F.lit(0))).otherwise(0).alias(f"up_{k}") for k in sums],
        *[F.when(placed, F.col(k) + F.coalesce(F.sum(F.when(~placed, F.col(k))).over(route), F.lit(0))).otherwise(F.sum(k).over(route)).alias(f"same_{k}") for k in sums],
        *[F.sum(k).over(route).alias(f"all_{k}") for k in sums],
    )
    own = {"n": F.lit(1), "f": F.col("finite").isNotNull().cast("long"), "s": F.coalesce("finite", F.lit(0.0)), "r": F.col("rises")}
    cells_of = found.select(F.col(run).alias("__run"), F.col("route_key").alias("__route"), F.col("center").alias("__center"), *[c for c in found.columns if c not in (run, "route_key", "center")])
    each = rows.join(cells_of, (F.col(run) == F.col("__run")) & (F.col("route_key") == F.col("__route")) & F.col("center").eqNullSafe(F.col("__center")))

    def band(name: str, of: dict[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("band"), of["n"].alias("vehicles"), F.when(of["f"] > 0, of["s"] / of["f"]).alias("mean_delay"), of["r"].alias("rising"))

    up, same = ({k: F.col(f"{b}_{k}") for k in sums} for b in ("up", "same"))
    down = {k: F.col(f"all_{k}") - up[k] - same[k] for k in sums}
    bands = F.array(band("upstream", up), band("same", {k: same[k] - own[k] for k in sums}), band("downstream", down))
    return each.select(*keys, F.explode(bands).alias("b")).filter("b.vehicles > 0").select(*keys, "b.*")


def route_window(df: DataFrame, run: str, keys: list[str], size: int = 7, tie: str = "event_id") -> DataFrame:
    """Of every vehicle the size others of its run and route nearest in stop order, the riskier first on ties, with their place along the route.

    Those without a place come last. At each place of a route the nearest are the riskiest of so many places before and
    behind it; that list is made once for all vehicles there.
    """
    rows = on_route(df).filter(F.col(run).isNotNull() & F.col("route_key").isNotNull())
    here = Window.partitionBy(run, "route_key", "center").orderBy(F.desc("risk"), tie)
    other = F.struct((-F.col("risk")).alias("risk"), F.col(tie).alias("id"), "center", "vehicle_id")
    best = rows.withColumn("__nth", F.row_number().over(here)).filter(F.col("__nth") <= size + 1)
    cells = best.groupBy(run, "route_key", "center").agg(F.collect_list(other).alias("best"))
    route = Window.partitionBy(run, "route_key")
    near = route.orderBy("center").rowsBetween(-size - 1, size + 1)  # without a place comes first, and joins all lists
    lists = cells.select(
        run, "route_key", "center",
        F.when(F.col("center").isNull(), F.flatten(F.collect_list("best").over(route)))
        .otherwise(F.array_union(F.flatten(F.collect_list("best").over(near)), F.coalesce(F.first(F.when(F.col("center").isNull(), F.col("best")), ignorenulls=True).over(route), F.slice("best", 1, 0)))).alias("others"),
    )
    by_distance = F.transform("others", lambda x: F.struct(F.coalesce(F.abs(x["center"] - F.col("center")), F.lit(float("inf"))).alias("distance"), x["risk"].alias("risk"), x["id"].alias("id"), x["center"].alias("center"), x["vehicle_id"].alias("vehicle_id")))
    nearest = lists.select(F.col(run).alias("__run"), F.col("route_key").alias("__route"), F.col("center").alias("__center"), F.slice(F.array_sort(by_distance), 1, size + 1).alias("nearest"))
    each = rows.join(nearest, (F.col(run) == F.col("__run")) & (F.col("route_key") == F.col("__route")) & F.col("center").eqNullSafe(F.col("__center")))
    others = F.slice(F.filter("nearest", lambda x: x["id"] != F.col(tie)), 1, size)
    along = F.array_sort(F.transform(others, lambda x: F.struct(x["center"].alias("center"), x["id"].alias("id"), x["vehicle_id"].alias("vehicle_id"))))
    return each.select(*keys, F.posexplode(along).alias("__at", "o")).select(*keys, F.col("o.id").alias(f"other_{tie}"), F.col("o.vehicle_id").alias("other_vehicle_id"), F.col("o.center").alias("other_center"), (F.col("__at") + 1).alias("place"))


def with_alerts(vehicles: DataFrame, alerts: DataFrame, order: list[str], threshold: float) -> DataFrame:
    """Vehicles with the last of their alerts, and whether that is at the threshold."""
    last = alerts.groupBy("vehicle_id").agg(F.max_by(F.struct("risk", "event_id"), F.struct(*order)).alias("found"))
    return vehicles.join(last, "vehicle_id", "left").withColumn("threshold_alert", F.coalesce(F.col("found.risk") >= threshold, F.lit(False)))


