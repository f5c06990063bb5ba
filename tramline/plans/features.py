"""Sampling, lags, schedule, calendar, as-of and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.geo import PRAGUE, within
from tramline.functions.timeutil import EPOCH, MILLENNIUM, MONDAY, plus_seconds, second_diff
from tramline.operators import sampling as S
from tramline.operators.asof import nearest
from tramline.plans.base import query
from tramline.sources.fixtures import DAY, POS, positions, predictions
from tramline.sources.fixtures import PRED

BUCKET, HORIZON, TOLERANCE, THRESHOLD = 6 * 3600, DAY, 12 * 3600, 60
SAMPLED = ["time", "delay", "speed", "lat", "lon", "mode", "line", "route_id", "trip_id", "route_type", "last_stop_sequence", "next_stop_sequence", "origin_timestamp", "last_stop_arrival_time", "last_stop_departure_time", "next_stop_arrival_time", "next_stop_departure_time"]
BOUNDS = f"lat BETWEEN {PRAGUE[0]} AND {PRAGUE[1]} AND lon BETWEEN {PRAGUE[2]} AND {PRAGUE[3]}"


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with all that a feature needs, inside the bounds."""
    found = positions(spark, sf_dir).dropna(subset=["time", "vehicle_id", "lat", "lon", "delay"])
    return found.filter(within(F.col("lat"), F.col("lon")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_last_non_null(inside(spark, sf_dir), SAMPLED, BUCKET, MONDAY)


IN = POS + f", inb AS (SELECT * FROM pos WHERE {BOUNDS})"
SAMP = IN + ", samp AS (SELECT vehicle_id, time_bucket(INTERVAL 6 HOUR, time) AS bucket, " + ", ".join(f"arg_max({c}, time) AS {c}" for c in SAMPLED) + " FROM inb GROUP BY 1, 2)"
LAGS = SAMP + ", lagged AS (SELECT *, " + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("delay", "speed") for k in (1, 2, 3)) + ", lag(lat) OVER w AS lat_lag_1, lag(lon) OVER w AS lon_lag_1 FROM samp WINDOW w AS (PARTITION BY vehicle_id ORDER BY time))"
DELTAS = """delay - delay_lag_1 AS delay_delta_1, speed - speed_lag_1 AS speed_delta_1,
  (delay + delay_lag_1 + delay_lag_2) / 3.0::DOUBLE AS delay_mean_3, (speed + speed_lag_1 + speed_lag_2) / 3.0::DOUBLE AS speed_mean_3"""
# Whole seconds between two times count the seconds that begin in between.
_SECONDS = {
    "seconds_since_origin": ("origin_timestamp", "time"), "seconds_since_last_stop_arrival": ("last_stop_arrival_time", "time"), "seconds_since_last_stop_departure": ("last_stop_departure_time", "time"),
    "seconds_until_next_stop_arrival": ("time", "next_stop_arrival_time"), "seconds_until_next_stop_departure": ("time", "next_stop_departure_time"), "scheduled_next_stop_dwell_seconds": ("next_stop_arrival_time", "next_stop_departure_time"),
}
SCHEDULE = "next_stop_sequence - last_stop_sequence AS stop_sequence_gap, " + ", ".join(f"epoch_us({b}) // 1000000 - epoch_us({a}) // 1000000 AS {name}" for name, (a, b) in _SECONDS.items())
CALENDAR = "CAST(hour(time) AS INTEGER) AS hour_of_day, CAST(dayofweek(time) AS INTEGER) AS day_of_week, CAST(time AS DATE) AS service_date"
# The match of a row: the least time of its vehicle that is a day later at least, if it is no more than twelve hours later still.
TARGET = """, due AS (SELECT l.vehicle_id, l.time, min(s.time) AS found FROM lagged l JOIN samp s ON s.vehicle_id = l.vehicle_id AND s.time - l.time >= INTERVAL 1 DAY GROUP BY ALL HAVING epoch_us(min(s.time)) // 1000000 - epoch_us(l.time + INTERVAL 1 DAY) // 1000000 <= 43200),
joined AS (SELECT l.*, l.time + INTERVAL 1 DAY AS target_time, due.found AS future_time, s.delay AS target_delay
  FROM lagged l LEFT JOIN due ON due.vehicle_id = l.vehicle_id AND due.time = l.time LEFT JOIN samp s ON s.vehicle_id = due.vehicle_id AND s.time = due.found)"""
KEPT = "vehicle_id, time, delay, speed, lat, lon, mode, line, route_id, trip_id, route_type, last_stop_sequence, next_stop_sequence"
LAG_NAMES = "lat_lag_1, lon_lag_1, " + ", ".join(f"{c}_lag_{k}" for c in ("delay", "speed") for k in (1, 2, 3))
TARGETS = "target_time, future_time, target_delay, target_delay - delay AS target_delay_delta, date_diff('second', target_time, future_time) AS target_lookup_lag_seconds"
FEATURE_COLUMNS = [c.strip() for c in f"{KEPT}, {LAG_NAMES}".split(",")] + ["delay_delta_1", "speed_delta_1", "delay_mean_3", "speed_mean_3", "stop_sequence_gap", "seconds_since_origin", "seconds_since_last_stop_arrival", "seconds_since_last_stop_departure", "seconds_until_next_stop_arrival", "seconds_until_next_stop_departure", "scheduled_next_stop_dwell_seconds", "hour_of_day", "day_of_week", "service_date", "target_time", "future_time", "target_delay", "target_delay_delta", "target_lookup_lag_seconds"]
FEATURES = f"SELECT {KEPT}, {LAG_NAMES}, {DELTAS}, {SCHEDULE}, {CALENDAR}, {TARGETS} FROM joined"


def features_of(sampled: DataFrame, keep_unlabelled: bool = True, columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Lagged, scheduled and labelled feature rows from samples; columns, with vehicle_id, time and delay, are all that is carried along."""
    lagged = S.with_calendar(S.with_schedule(S.with_deltas(S.with_lags(sampled))))
    carried = [c for c in columns if c in lagged.columns]  # the as-of step packs rows, so that Spark drops no column there
    return S.with_target(lagged.select(*carried), HORIZON, TOLERANCE, keep_unlabelled).select(*columns)


@query(LAGS + TARGET + FEATURES)
def delay_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(samples(spark, sf_dir))


@query(LAGS + TARGET + FEATURES + " WHERE target_delay IS NOT NULL")
def delay_features_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(samples(spark, sf_dir), keep_unlabelled=False)


@query(SAMP + "SELECT * FROM samp")
def sample_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir)


_LAST = "SELECT vehicle_id, {b} AS bucket, time, delay, speed, lat, lon FROM inb QUALIFY row_number() OVER (PARTITION BY vehicle_id, {b} ORDER BY time DESC) = 1"


@query(IN + _LAST.format(b="time_bucket(INTERVAL 7 HOUR, time, TIMESTAMP '2000-01-01')"))
def sample_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_last_row(inside(spark, sf_dir), ["time", "delay", "speed", "lat", "lon"], 7 * 3600, MILLENNIUM)


@query(IN + _LAST.format(b="time_bucket(INTERVAL 7 HOUR, time, TIMESTAMP '1970-01-01')"))
def sample_last_row_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_last_row(inside(spark, sf_dir), ["time", "delay", "speed", "lat", "lon"], 7 * 3600, EPOCH)


@query(LAGS + f"SELECT vehicle_id, time, {LAG_NAMES} FROM lagged")
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_lags(samples(spark, sf_dir)).select("vehicle_id", "time", *[c.strip() for c in LAG_NAMES.split(",")])


@query(LAGS + f"SELECT vehicle_id, time, {DELTAS} FROM lagged")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_deltas(S.with_lags(samples(spark, sf_dir))).select("vehicle_id", "time", "delay_delta_1", "speed_delta_1", "delay_mean_3", "speed_mean_3")


@query(POS + f"SELECT event_id, {SCHEDULE} FROM pos")
def schedule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.with_schedule(positions(spark, sf_dir))
    return p.select("event_id", *[c for c in p.columns if c.startswith(("seconds_", "scheduled_", "stop_sequence"))])


@query(POS + f"SELECT event_id, {CALENDAR}, CAST(isodow(time) AS INTEGER) AS iso_day FROM pos")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).drop("service_date")
    iso = S.with_calendar(p, iso=True).withColumnRenamed("day_of_week", "iso_day").select("*")
    return iso.withColumn("day_of_week", F.dayofweek("time") - 1).select("event_id", "hour_of_day", "day_of_week", "service_date", "iso_day")


@query(POS + "SELECT event_id, vehicle_id, time, delay FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY time DESC, event_id DESC) = 1")
def latest_per_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_per_vehicle(positions(spark, sf_dir)).select("event_id", "vehicle_id", "time", "delay")


@query(POS + "SELECT vehicle_id, arg_max(delay, time) AS delay, arg_max(speed, time) AS speed, arg_max(line, time) AS line FROM pos GROUP BY 1")
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_values(positions(spark, sf_dir), ["delay", "speed", "line"])


@query(SAMP + """, probe AS (SELECT vehicle_id, time, delay, time + INTERVAL 1 DAY AS target_time FROM samp)
SELECT p.*, f.time AS future_time, f.delay AS target_delay FROM probe p ASOF LEFT JOIN samp f ON p.vehicle_id = f.vehicle_id AND p.target_time <= f.time""")
def asof_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.operators.asof import asof_forward

    s = samples(spark, sf_dir).select("vehicle_id", "time", "delay")
    found = asof_forward(s.withColumn("target_time", plus_seconds(F.col("time"), HORIZON)), s, ["vehicle_id"], F.col("target_time"), F.col("time"), ["delay"])
    return found.select("vehicle_id", "time", "delay", "target_time", F.col("match.__at").alias("future_time"), F.col("match.delay").alias("target_delay"))


NEAREST = PRED + """, cand AS (
  SELECT p.event_id, p.vehicle_id, p.position_time, p.delay, o.time AS found_time, o.delay AS found_delay,
         row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(o.time) - epoch_us(p.position_time + INTERVAL 1 DAY)), o.time) AS n
  FROM pred p JOIN pos o ON o.vehicle_id = p.vehicle_id AND o.time BETWEEN p.position_time + INTERVAL 18 HOUR AND p.position_time + INTERVAL 30 HOUR),
near AS (SELECT p.*, c.found_time, c.found_delay FROM pred p LEFT JOIN (SELECT * FROM cand WHERE n = 1) c USING (event_id))"""


def nearest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    o = positions(spark, sf_dir).select("vehicle_id", "time", F.col("delay").alias("found_delay"))
    found = nearest(p, o, ["vehicle_id"], plus_seconds(F.col("position_time"), DAY), F.col("time"), ["found_delay"], 6 * 3600)
    return found.select("*", F.col("match.__at").alias("found_time"), F.col("match.found_delay").alias("found_delay")).drop("match")


@query(NEAREST + "SELECT event_id, found_time, found_delay FROM near")
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_of(spark, sf_dir).select("event_id", "found_time", "found_delay")


@query(NEAREST + """SELECT event_id, found_delay - delay AS delta, found_delay IS NOT NULL AS is_labelled, CASE WHEN found_delay IS NOT NULL THEN found_delay - delay >= 60 END AS actual_increase
FROM near WHERE scored_at >= (SELECT max(scored_at) - 20 FROM pred) AND position_time <= (SELECT max(time) FROM pos) - INTERVAL 1 DAY""")
def prediction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent predictions that are old enough for their horizon, with what the delay became."""
    near = nearest_of(spark, sf_dir)
    bounds = predictions(spark, sf_dir).agg(F.max("scored_at").alias("last"), F.max("position_time").alias("newest"))
    old = near.crossJoin(F.broadcast(bounds)).filter((F.col("scored_at") >= F.date_sub("last", 20)) & (F.col("position_time") <= plus_seconds(F.col("newest"), -HORIZON)))
    delta = F.col("found_delay") - F.col("delay")
    return old.select("event_id", delta.alias("delta"), delta.isNotNull().alias("is_labelled"), (delta >= THRESHOLD).alias("actual_increase"))


@query(SAMP + "SELECT vehicle_id, time, date_diff('second', lag(time) OVER (PARTITION BY vehicle_id ORDER BY time), time) AS seconds FROM samp")
def sample_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("time").over(Window.partitionBy("vehicle_id").orderBy("time"))
    return samples(spark, sf_dir).select("vehicle_id", "time", second_diff(before, F.col("time")).alias("seconds"))
