"""Bucket sampling per vehicle, latest rows, and lagged features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.timeutil import bucket, day_of_week, second_diff
from tramline.operators.asof import asof_forward_self


def sample_last_non_null(df: DataFrame, columns: list[str], seconds: int, origin: str, time: str = "time") -> DataFrame:
    """One row per vehicle and bucket: of every column its last value that isn't null."""
    at = F.col(time)
    return df.groupBy("vehicle_id", bucket(at, seconds, origin).alias("bucket")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def sample_last_row(df: DataFrame, columns: list[str], seconds: int, origin: str, time: str = "time") -> DataFrame:
    """One row per vehicle and bucket: its last row, nulls and all."""
    last = F.max_by(F.struct(*columns), F.col(time)).alias("row")
    return df.groupBy("vehicle_id", bucket(F.col(time), seconds, origin).alias("bucket")).agg(last).select("vehicle_id", "bucket", "row.*")


def latest_per_vehicle(df: DataFrame, time: str = "time", ties: str = "event_id") -> DataFrame:
    """The last row of every vehicle."""
    return df.groupBy("vehicle_id").agg(F.max_by(F.struct("*"), F.struct(time, ties)).alias("row")).select("row.*")


def latest_values(df: DataFrame, columns: list[str], time: str = "time") -> DataFrame:
    """Of every vehicle and column the last value that isn't null."""
    return df.groupBy("vehicle_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])


def with_lags(df: DataFrame, time: str = "time") -> DataFrame:
    w = Window.partitionBy("vehicle_id").orderBy(time)
    lags: dict[str, Column] = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in ("delay", "speed") for k in (1, 2, 3)}
    return df.withColumns(lags | {f"{c}_lag_1": F.lag(c, 1).over(w) for c in ("lat", "lon") if c in df.columns})


def with_deltas(df: DataFrame) -> DataFrame:
    """Deltas and means of three, null where an input is."""
    mean = lambda c: (F.col(c) + F.col(f"{c}_lag_1") + F.col(f"{c}_lag_2")) / F.lit(3.0)
    return df.withColumns({
        "delay_delta_1": F.col("delay") - F.col("delay_lag_1"), "speed_delta_1": F.col("speed") - F.col("speed_lag_1"),
        "delay_mean_3": mean("delay"), "speed_mean_3": mean("speed"),
    })


def with_schedule(df: DataFrame, time: str = "time") -> DataFrame:
    t = F.col(time)
    return df.withColumns({
        "stop_sequence_gap": F.col("next_stop_sequence") - F.col("last_stop_sequence"),
        "seconds_since_origin": second_diff(F.col("origin_timestamp"), t),
        "seconds_since_last_stop_arrival": second_diff(F.col("last_stop_arrival_time"), t),
        "seconds_since_last_stop_departure": second_diff(F.col("last_stop_departure_time"), t),
        "seconds_until_next_stop_arrival": second_diff(t, F.col("next_stop_arrival_time")),
        "seconds_until_next_stop_departure": second_diff(t, F.col("next_stop_departure_time")),
        "scheduled_next_stop_dwell_seconds": second_diff(F.col("next_stop_arrival_time"), F.col("next_stop_departure_time")),
    })


def with_calendar(df: DataFrame, time: str = "time", iso: bool = False) -> DataFrame:
    t = F.col(time)
    return df.withColumns({"hour_of_day": F.hour(t), "day_of_week": day_of_week(t, iso), "service_date": F.to_date(t)})


def with_target(df: DataFrame, horizon: int, tolerance: int, keep_unlabelled: bool = True, time: str = "time") -> DataFrame:
    """The first later sample at or after time + horizon; its columns are null if it is over tolerance seconds later still."""
    target = F.timestamp_add("SECOND", F.lit(horizon), F.col(time))
    rows = df.withColumn("target_time", target)
    found = asof_forward_self(rows, ["vehicle_id"], F.col("target_time"), F.col(time), ["delay"], tolerance, "left" if keep_unlabelled else "inner")
    return found.withColumns({
        "future_time": F.col("match.__at"), "target_delay": F.col("match.delay"),
        "target_delay_delta": F.col("match.delay") - F.col("delay"),
        "target_lookup_lag_seconds": second_diff(F.col("target_time"), F.col("match.__at")),
    }).drop("match")
