"""Segments, interpolation, paths, positions at a time, delay bands and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.geo import PRAGUE, haversine_km, haversine_m, within
from tramline.functions.timeutil import plus_seconds
from tramline.operators import replay as R
from tramline.operators import trajectory as T
from tramline.plans.base import query
from tramline.sources.fixtures import DAY, POS, PRED, positions, predictions

MAX_GAP, MAX_SPEED, STEP, SHORTEST, LONGEST = 86_400.0, 2.0, 600, 1200.0, 21_600.0


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with the order that they arrive in, which isn't that of their time."""
    w = Window.partitionBy("vehicle_id").orderBy("service_date", F.col("event_id") * 6151 % 9973, "event_id")
    return positions(spark, sf_dir).withColumn("arrival_seq", F.row_number().over(w))


def segments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.segments(arrivals(spark, sf_dir), ["arrival_seq"], MAX_GAP, MAX_SPEED)


HAV = "2 * {r}::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
ARR = POS + ", arr AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY service_date, event_id * 6151 % 9973, event_id) AS arrival_seq FROM pos)"
SEG = (
    ARR
    + """, prev AS (SELECT *, lag(time) OVER w AS ptime, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM arr WINDOW w AS (PARTITION BY vehicle_id ORDER BY arrival_seq)),
step AS (SELECT *, (epoch_us(time) - epoch_us(ptime)) / 1e6 AS dt, CASE WHEN ptime IS NOT NULL THEN """
    + HAV.format(r=6371000, a="p", b="").replace("radians(lat - plat)", "radians(lat - plat)")
    + """ END AS distance FROM prev),
seg AS (SELECT *, CASE WHEN ptime IS NULL THEN NULL WHEN dt <= 0 THEN 'out_of_order' WHEN dt > 86400 THEN 'dropout' WHEN distance / dt > 2 THEN 'speed_violation' END AS gap_reason FROM step),
state AS (SELECT *, CASE WHEN gap_reason IS NULL THEN 'observed' ELSE 'invalid_gap' END AS point_state, CASE WHEN gap_reason IS NULL THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN ptime IS NOT NULL AND gap_reason IS NULL THEN 'linear' END AS interpolation_method FROM seg)"""
)
INTER = (
    SEG
    + """, inter AS (SELECT event_id, vehicle_id, ptime + INTERVAL (k * 600) SECOND AS time, plat + (lat - plat) * (k * 600 / dt) AS lat, plon + (lon - plon) * (k * 600 / dt) AS lon,
  'interpolated' AS point_state, 'medium' AS confidence, 'linear' AS interpolation_method, NULL::VARCHAR AS gap_reason, route_id, trip_id, mode
  FROM (SELECT *, unnest(generate_series(1, CAST(ceil(trunc(dt) / 600) AS BIGINT) - 1)) AS k FROM state WHERE point_state = 'observed' AND dt BETWEEN 1200 AND 21600)),
traj AS (SELECT event_id, vehicle_id, time, lat, lon, point_state, confidence, interpolation_method, gap_reason, route_id, trip_id, mode FROM state UNION ALL SELECT * FROM inter)"""
)
BOX = f"lat BETWEEN {PRAGUE[0]} AND {PRAGUE[1]} AND lon BETWEEN {PRAGUE[2]} AND {PRAGUE[3]}"
ROUND = "round(lat, 6) AS lat, round(lon, 6) AS lon"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


def trajectory_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trajectory(segments_of(spark, sf_dir), STEP, SHORTEST, LONGEST)


@query(SEG + "SELECT event_id, vehicle_id, gap_reason, point_state, confidence, interpolation_method, round(distance, 3) AS distance FROM state")
def segment_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(spark, sf_dir).select("event_id", "vehicle_id", "gap_reason", "point_state", "confidence", "interpolation_method", F.round("distance", 3).alias("distance"))


@query(INTER + f"SELECT event_id, vehicle_id, date_trunc('second', time) AS time, {ROUND}, point_state, confidence, interpolation_method, route_id, trip_id, mode FROM inter")
def trajectory_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(T.interpolated(segments_of(spark, sf_dir), STEP, SHORTEST, LONGEST)).drop("gap_reason")
    return found.withColumn("time", F.date_trunc("second", F.col("time").cast("timestamp")).cast("timestamp_ntz"))


@query(INTER + "SELECT point_state, gap_reason, count(*) AS points, count(DISTINCT vehicle_id) AS vehicles FROM traj GROUP BY ALL")
def trajectory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory_of(spark, sf_dir).groupBy("point_state", "gap_reason").agg(F.count("*").alias("points"), F.countDistinct("vehicle_id").alias("vehicles"))


@query(POS + "SELECT event_id, round(" + HAV.format(r=6371, a="c", b="") .replace("lat - clat", "lat - 50.0755").replace("radians(clat)", "radians(50.0755)").replace("lon - clon", "lon - 14.4378") + ", 6) AS km, round(1000 * " + HAV.format(r=6371, a="c", b="").replace("lat - clat", "lat - 50.0755").replace("radians(clat)", "radians(50.0755)").replace("lon - clon", "lon - 14.4378") + f", 3) AS m, {BOX} AS inside FROM pos")
def geo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon, at = F.col("lat"), F.col("lon"), (F.lit(50.0755), F.lit(14.4378))
    return positions(spark, sf_dir).select("event_id", F.round(haversine_km(*at, lat, lon), 6).alias("km"), F.round(haversine_m(*at, lat, lon), 3).alias("m"), within(lat, lon).alias("inside"))


@query(INTER + f""", shown AS (SELECT *, epoch_us(time) - (SELECT epoch_us(min(time)) FROM pos) AS us FROM traj WHERE point_state <> 'invalid_gap' AND {BOX})
SELECT vehicle_id, count(*) AS points, CAST(sum(us // 1000) AS BIGINT) AS sum_ms, round(sum(lon), 4) AS sum_lon,
  CAST(min(us // 1000) AS BIGINT) AS first_ms, CAST(max(us // 1000) AS BIGINT) AS last_ms, arg_max(substr(route_id, 2), (time, event_id)) AS line, arg_max(mode, (time, event_id)) AS mode FROM shown GROUP BY 1""")
def replay_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = positions(spark, sf_dir).agg(F.min("time").alias("start"))
    points = trajectory_of(spark, sf_dir).filter(within(F.col("lat"), F.col("lon"))).crossJoin(F.broadcast(start))
    t = F.transform("path", lambda p: p["t"])
    return T.replay_paths(points, F.col("start")).select(
        "vehicle_id", F.size("path").cast("long").alias("points"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ms"),
        F.round(F.aggregate(F.transform("path", lambda p: p["lon"]), F.lit(0.0), lambda a, x: a + x), 4).alias("sum_lon"),
        F.get(t, 0).alias("first_ms"), F.element_at(t, -1).alias("last_ms"), "line", "mode",
    )


AT = POS + f""", probe AS (SELECT event_id, vehicle_id, time + INTERVAL ((event_id % 97) * 1000) SECOND AS probe_time FROM pos WHERE event_id % 3 = 0),
path AS (SELECT vehicle_id, time, lat, lon, lead(time) OVER w AS ntime, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pos WHERE {BOX} WINDOW w AS (PARTITION BY vehicle_id ORDER BY time)),
held AS (SELECT p.*, s.time, s.lat, s.lon, s.ntime, s.nlat, s.nlon FROM probe p ASOF LEFT JOIN path s ON p.vehicle_id = s.vehicle_id AND p.probe_time >= s.time),
firsts AS (SELECT vehicle_id, arg_min(lat, time) AS flat, arg_min(lon, time) AS flon FROM path GROUP BY 1),
place AS (SELECT h.*, flat, flon, (epoch_us(probe_time) - epoch_us(time)) / (epoch_us(ntime) - epoch_us(time)) AS share, epoch_us(probe_time) - epoch_us(time) > 50000 * 1000000::BIGINT AS gone FROM held h LEFT JOIN firsts USING (vehicle_id))
SELECT event_id, vehicle_id, probe_time,
  round(CASE WHEN time IS NULL THEN flat WHEN ntime IS NOT NULL THEN lat + (nlat - lat) * share WHEN NOT gone THEN lat END, 6) AS lat,
  round(CASE WHEN time IS NULL THEN flon WHEN ntime IS NOT NULL THEN lon + (nlon - lon) * share WHEN NOT gone THEN lon END, 6) AS lon,
  coalesce(time IS NOT NULL AND ntime IS NULL AND probe_time > time, false) AS stale FROM place"""


@query(AT)
def position_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    probes = p.filter("event_id % 3 = 0").select("event_id", "vehicle_id", plus_seconds(F.col("time"), (F.col("event_id") % 97 * 1000).cast("int")).alias("probe_time"))
    return rounded(T.position_at(probes, p.filter(within(F.col("lat"), F.col("lon"))), "probe_time", 50_000))


@query(PRED + """SELECT line, hour(position_time)::INTEGER AS hour, CASE WHEN raw_alert THEN 'alert' WHEN delay < 60 THEN 'small' WHEN delay < 180 THEN 'medium' ELSE 'large' END AS band, count(*) AS vehicles FROM pred GROUP BY ALL""")
def delay_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("raw_alert"), "alert").when(F.col("delay") < 60, "small").when(F.col("delay") < 180, "medium").otherwise("large")
    return predictions(spark, sf_dir).groupBy("line", F.hour("position_time").alias("hour"), band.alias("band")).agg(F.count("*").alias("vehicles"))


@query(SEG + "SELECT count(*) FILTER (WHERE point_state = 'observed') AS observed, count(*) FILTER (WHERE point_state = 'invalid_gap') AS invalid, count(DISTINCT vehicle_id) AS vehicles, count(*) FILTER (WHERE gap_reason = 'dropout') AS dropouts FROM state")
def replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(spark, sf_dir).agg(F.count_if(F.col("point_state") == "observed").alias("observed"), F.count_if(F.col("point_state") == "invalid_gap").alias("invalid"), F.countDistinct("vehicle_id").alias("vehicles"), F.count_if(F.col("gap_reason") == "dropout").alias("dropouts"))


@query(SEG + """, l AS (SELECT vehicle_id, arg_max(point_state, (time, event_id)) AS last_state FROM state GROUP BY 1)
SELECT event_id, vehicle_id, time, line FROM state JOIN l USING (vehicle_id) WHERE last_state <> 'invalid_gap' AND mode = 'click' AND contains(lower(line), 'lic')""")
def replay_vehicle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vehicle_filter(segments_of(spark, sf_dir), mode="click", line="LIC").select("event_id", "vehicle_id", "time", "line")


@query("SELECT min(ts) AS first_time, max(ts) AS last_time, count(*) AS positions FROM events")
def replay_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("positions"))


PAGE = POS + """, w AS (SELECT * FROM pos WHERE time >= (SELECT min(time) + INTERVAL 5 DAY FROM pos) AND time < (SELECT min(time) + INTERVAL 12 DAY FROM pos)),
c AS (SELECT time AS ct, vehicle_id AS cv FROM w ORDER BY time, vehicle_id OFFSET 99 LIMIT 1)"""


def window_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days of positions."""
    p = positions(spark, sf_dir)
    first = p.agg(F.min("time")).first()[0]
    return R.time_window(p, plus_seconds(F.lit(first), 5 * DAY), plus_seconds(F.lit(first), 12 * DAY))


@query(PAGE + "SELECT event_id, vehicle_id, time, (SELECT count(*) FROM w) AS total FROM w ORDER BY time, vehicle_id LIMIT 100")
def replay_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _, total = R.page(window_of(spark, sf_dir), 100)
    return rows.select("event_id", "vehicle_id", "time", F.lit(total).cast("long").alias("total"))


@query(PAGE + ", page AS (SELECT event_id, vehicle_id, time FROM w, c WHERE time > ct OR (time = ct AND vehicle_id > cv) ORDER BY time, vehicle_id LIMIT 101) SELECT * FROM page ORDER BY time, vehicle_id LIMIT 100")
def replay_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, after the cursor that the first one ends with."""
    window = window_of(spark, sf_dir)
    _, more, cursor, _ = R.page(window, 100)
    assert more or cursor is None
    return R.page(window, 100, cursor)[0].select("event_id", "vehicle_id", "time")


@query(POS + "SELECT event_id, vehicle_id, time FROM pos WHERE mode = 'view' AND time < (SELECT max(time) - INTERVAL 3 DAY FROM pos)")
def replay_optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    last = p.agg(F.max("time")).first()[0]
    return R.optional(R.time_window(p, None, plus_seconds(F.lit(last), -3 * DAY)), vehicle=None, mode="view").select("event_id", "vehicle_id", "time")
