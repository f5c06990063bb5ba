"""Streams of vehicle positions: ingest, bucket sampling, trajectories and live trails by keyed state, batch scoring.

Where a vehicle's output depends on what came before, a processor keeps that in the state store; the same rules run in
batch over rows in arrival order, and give the same rows whatever the micro-batches are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tramline.functions.geo import PRAGUE
from tramline.sources.lake import parse_messages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EARTH_M = 6371000.0

#: Rows that the processors give out.
POINT = Row("vehicle_id", "us", "lat", "lon", "point_state", "gap_reason")
TRAIL = Row("vehicle_id", "points", "last_lon", "last_lat", "last_ms")
LIFE = Row("vehicle_id", "first_us", "last_us", "points", "last_lat", "last_lon")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there into Parquet files, exactly once for each checkpoint."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finish(query)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def ingest(spark: SparkSession, source: str, files_a_batch: int = 1) -> DataFrame:
    """Typed rows from a folder that messages land in, as JSON lines."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source))


def bucket_samples(stream: DataFrame, width: str, lateness: str, columns: list[str]) -> DataFrame:
    """The last row of each vehicle and bucket, once the watermark has passed the bucket's end."""
    last = F.max_by(F.struct("time", *columns), "time").alias("row")
    found = stream.withWatermark("time", lateness).groupBy(F.window("time", width), "vehicle_id").agg(last)
    return found.select("vehicle_id", F.col("window.start").alias("bucket"), "row.*")


def distance_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


class Segments(StatefulProcessor):
    """Classifies each point against the one that arrived before it, and adds points on the line between valid ones."""

    OUTPUT = "vehicle_id string, us long, lat double, lon double, point_state string, gap_reason string"

    def __init__(self, max_gap: float = 45.0, max_speed: float = 40.0, step: int = 1, shortest: float = 2.0, longest: float = 30.0) -> None:
        self.rules = (max_gap, max_speed, step, shortest, longest)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, lat double, lon double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        # One vehicle's part of a micro-batch, in the order of arrival.
        for row in sorted(rows, key=lambda r: r.arrival_seq):
            now = row.us, row.lat, row.lon
            for found in self.step(key[0], last, now):
                yield POINT(*found)
            last = now
        self.last.update(last)

    def step(self, vehicle: str, last: tuple | None, now: tuple[int, float, float]) -> Iterable[tuple]:
        max_gap, max_speed, step, shortest, longest = self.rules
        us, lat, lon = now
        if last is None:
            return [(vehicle, us, lat, lon, "observed", None)]
        dt = (us - last[0]) / 1e6
        reason = "out_of_order" if dt <= 0 else "dropout" if dt > max_gap else "speed_violation" if distance_m(last[1], last[2], lat, lon) / dt > max_speed else None
        out = []
        if reason is None and shortest <= dt <= longest:
            for k in range(1, math.ceil(int(dt) / step)):
                share = k * step / dt
                out.append((vehicle, last[0] + k * step * 1_000_000, last[1] + (lat - last[1]) * share, last[2] + (lon - last[2]) * share, "interpolated", None))
        return [*out, (vehicle, us, lat, lon, "observed" if reason is None else "invalid_gap", reason)]

    def close(self) -> None:
        pass


def trail_step(trail: list[tuple[float, float, int]], lat: float, lon: float, us: int, bounds: tuple = PRAGUE, most: int = 30) -> list[tuple[float, float, int]]:
    """The trail of a vehicle after a point: (lon, lat, milliseconds), the last ``most`` of them.

    Points outside the bounds are dropped; a jump of over 1500 m or 40 m/s starts a new trail; a move of under 1 m adds
    no point; time never runs back.
    """
    if not (bounds[0] <= lat <= bounds[1] and bounds[2] <= lon <= bounds[3]):
        return trail
    at = us // 1000
    if not trail:
        return [(lon, lat, at)]
    at = max(at, trail[-1][2] + 1)
    moved = distance_m(trail[-1][1], trail[-1][0], lat, lon)
    if moved > 1500 or moved / ((at - trail[-1][2]) / 1000) > 40:
        return [(lon, lat, at)]
    return trail if moved < 1 else [*trail, (lon, lat, at)][-most:]


class Trails(StatefulProcessor):
    """Each vehicle's trail so far; a vehicle that is silent for ttl_ms is forgotten."""

    OUTPUT = "vehicle_id string, points int, last_lon double, last_lat double, last_ms long"
    POINT = "lon double, lat double, ms long"

    def __init__(self, ttl_ms: int | None = 120_000) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trail = handle.getListState("trail", self.POINT, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        trail = [(float(a), float(b), int(c)) for a, b, c in self.trail.get()]
        for row in sorted(rows, key=lambda r: r.arrival_seq):
            trail = trail_step(trail, row.lat, row.lon, row.us)
        if trail:
            self.trail.put(trail)
            yield TRAIL(key[0], len(trail), *trail[-1])

    def close(self) -> None:
        pass


def trajectory_stream(stream: DataFrame, processor: Segments) -> DataFrame:
    """stream: vehicle_id, us, lat, lon, arrival_seq."""
    return stream.groupBy("vehicle_id").transformWithState(processor, Segments.OUTPUT, "Append", "None")


def trail_stream(stream: DataFrame, processor: Trails) -> DataFrame:
    mode = "ProcessingTime" if processor.ttl_ms else "None"
    return stream.groupBy("vehicle_id").transformWithState(processor, Trails.OUTPUT, "Update", mode)


def trails(points: DataFrame) -> DataFrame:
    """The trails after all points, in batch: a vehicle's points are folded in order of arrival."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        trail: list[tuple[float, float, int]] = []
        for us, lat, lon in rows.sort_values("arrival_seq")[["us", "lat", "lon"]].itertuples(index=False):
            trail = trail_step(trail, float(lat), float(lon), int(us))
        found = [(rows["vehicle_id"].iloc[0], len(trail), *trail[-1])] if trail else []
        return pd.DataFrame(found, columns=["vehicle_id", "points", "last_lon", "last_lat", "last_ms"])

    return points.groupBy("vehicle_id").applyInPandas(fold, Trails.OUTPUT)


def live_step(lives: list[tuple], us: int, lat: float, lon: float, ttl_us: int) -> list[tuple]:
    """The lives of a vehicle, (first, last, points, lat, lon), after a point: it joins all that it is less than ttl_us from."""
    near = [x for x in lives if x[0] - ttl_us < us < x[1] + ttl_us]
    last = max([(x[1], x[3], x[4]) for x in near] + [(us, lat, lon)])
    one = (min([us, *(x[0] for x in near)]), last[0], 1 + sum(x[2] for x in near), last[1], last[2])
    return sorted([*(x for x in lives if x not in near), one])


class Lives(StatefulProcessor):
    """The lives of each vehicle that haven't ended. A timer ends one once the watermark has passed its last point by ttl_ms.

    A vehicle has one timer, for the life that ends first; it ends all that the watermark has passed.
    """

    OUTPUT = "vehicle_id string, first_us long, last_us long, points long, last_lat double, last_lon double"
    LIFE = "first_us long, last_us long, points long, lat double, lon double"

    def __init__(self, ttl_ms: int = 120_000) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lives = handle.getListState("lives", self.LIFE)

    def _held(self) -> list[tuple]:
        return [(int(a), int(b), int(n), float(lat), float(lon)) for a, b, n, lat, lon in self.lives.get()]

    def _end(self, life: tuple) -> int:
        return -(-life[1] // 1000) + self.ttl_ms

    def _first_end(self, lives: list[tuple]) -> int | None:
        return min(map(self._end, lives), default=None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        lives = self._held()
        before = self._first_end(lives)
        for row in rows:
            lives = live_step(lives, row.us, row.lat, row.lon, 1000 * self.ttl_ms)
        self.lives.put(lives)
        after = self._first_end(lives)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now, lives = timerValues.getCurrentWatermarkInMs(), self._held()
        left = [x for x in lives if self._end(x) > now]
        if left:
            self.lives.put(left)
            self.handle.registerTimer(self._first_end(left))
        else:
            self.lives.clear()
        return iter([LIFE(key[0], *x) for x in lives if self._end(x) <= now])

    def close(self) -> None:
        pass


def expired(stream: DataFrame, ttl_ms: int, lateness: str) -> DataFrame:
    """Lives of vehicles that have ended: a vehicle lives while no two of its rows (vehicle_id, time, lat, lon) are ttl_ms or more apart.

    A life is given out, and its state dropped, by a timer; a vehicle that comes back lives anew.
    """
    timed = stream.withWatermark("time", lateness).select("vehicle_id", "time", F.unix_micros("time").alias("us"), "lat", "lon")
    return timed.groupBy("vehicle_id").transformWithState(Lives(ttl_ms), Lives.OUTPUT, "Append", "EventTime")


def store_batches(stream: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> None:
    """Every micro-batch into several tables, each under the batch's number, so that a batch run again replaces itself in all."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, part in tables.items():
            part(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    finish(stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def scoring_rows(seen: DataFrame, now: datetime, context: int, features: Callable[[DataFrame], DataFrame], fresh: int, most: int) -> DataFrame:
    """What a scoring run scores: features over the context seconds up to now, every vehicle's latest, no older than fresh seconds, most rows of them, the newest."""
    ago = lambda s: F.timestamp_add("SECOND", F.lit(-s), F.lit(now))
    rows = features(seen.filter((F.col("time") > ago(context)) & (F.col("time") <= F.lit(now))))
    last = rows.groupBy("vehicle_id").agg(F.max_by(F.struct("*"), "time").alias("row")).select("row.*")
    return last.filter(F.col("time") >= ago(fresh)).orderBy(F.desc("time"), "vehicle_id").limit(most)


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, seen: str | None = None, usable: str | None = None) -> None:
    """Every micro-batch through a batch function, written under its own number, so that a batch run again replaces itself.

    seen: a folder where the batches' rows (those with usable, if named) are kept first, as context for this and later runs.
    """

    def one(batch: DataFrame, number: int) -> None:
        if seen is not None:
            (batch.filter(usable) if usable else batch).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    finish(stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
