"""Positions and predictions in the shape of the telemetry tables, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.timeutil import plus_seconds

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k, ts, user = F.get_json_object("props", "$.k").cast("int"), F.col("ts"), F.col("user_id")
    return e.select(
        "event_id",
        F.concat(F.lit("u"), user).alias("vehicle_id"),
        ts.alias("time"),
        ts.alias("ingest_ts"),
        ts.alias("observation_ts"),
        F.round("value").cast("int").alias("delay"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("speed"),
        (F.lit(49.85) + (F.col("event_id") * 7919 % 400) / F.lit(1000.0)).alias("lat"),
        (F.lit(14.15) + (F.col("event_id") * 104729 % 650) / F.lit(1000.0)).alias("lon"),
        F.col("event_type").alias("mode"),
        F.col("event_type").alias("line"),
        F.concat(F.lit("L"), user % 20).alias("route_id"),
        F.concat(F.lit("t"), user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("trip_id"),
        (user % 5).cast("int").alias("route_type"),
        (k % 30).alias("last_stop_sequence"),
        (k % 30 + 1).alias("next_stop_sequence"),
        plus_seconds(ts, -300).alias("origin_timestamp"),
        plus_seconds(ts, -60).alias("last_stop_arrival_time"),
        plus_seconds(ts, -45).alias("last_stop_departure_time"),
        plus_seconds(ts, 120).alias("next_stop_arrival_time"),
        plus_seconds(ts, 135).alias("next_stop_departure_time"),
        F.to_date("ts").alias("service_date"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row for each event; a run is a day."""
    risk = (F.col("event_id") * 6151 % 1000) / F.lit(999.0)
    return positions(spark, sf_dir).select(
        "event_id", F.col("service_date").alias("scored_at"), "vehicle_id", F.col("time").alias("position_time"), "delay", "line", "mode", "route_id",
        "last_stop_sequence", "next_stop_sequence", "lat", "lon", risk.alias("risk"), (risk >= 0.6).alias("raw_alert"), (F.col("delay") >= 60).alias("actual"),
    )


#: The same in DuckDB SQL, for oracles.
POS = """WITH pos AS (
  SELECT event_id, 'u' || user_id AS vehicle_id, ts AS time, ts AS ingest_ts, ts AS observation_ts, CAST(round(value) AS INTEGER) AS delay,
         CASE WHEN event_id % 7 <> 0 THEN value END AS speed, 49.85::DOUBLE + (event_id * 7919 % 400) / 1000.0::DOUBLE AS lat,
         14.15::DOUBLE + (event_id * 104729 % 650) / 1000.0::DOUBLE AS lon, event_type AS mode, event_type AS line, 'L' || (user_id % 20) AS route_id,
         't' || user_id || '-' || CAST(ts AS DATE) AS trip_id, CAST(user_id % 5 AS INTEGER) AS route_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 AS last_stop_sequence, CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 + 1 AS next_stop_sequence,
         ts - INTERVAL 300 SECOND AS origin_timestamp, ts - INTERVAL 60 SECOND AS last_stop_arrival_time, ts - INTERVAL 45 SECOND AS last_stop_departure_time,
         ts + INTERVAL 120 SECOND AS next_stop_arrival_time, ts + INTERVAL 135 SECOND AS next_stop_departure_time, CAST(ts AS DATE) AS service_date
  FROM events)"""
PRED = (
    POS
    + """, pred AS (
  SELECT event_id, service_date AS scored_at, vehicle_id, time AS position_time, delay, line, mode, route_id, last_stop_sequence, next_stop_sequence, lat, lon,
         (event_id * 6151 % 1000) / 999.0::DOUBLE AS risk, (event_id * 6151 % 1000) / 999.0::DOUBLE >= 0.6 AS raw_alert, delay >= 60 AS actual
  FROM pos)"""
)
