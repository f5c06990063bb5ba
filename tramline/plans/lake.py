"""Sources, sinks, cleaning, set operations and daily statistics of positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.geo import within
from tramline.operators import splits as X
from tramline.plans.base import query, scratch
from tramline.sources import lake as L
from tramline.sources import versions
from tramline.sources.fixtures import POS, PRED, positions, predictions, table

FMT = "yyyy-MM-dd HH:mm:ss"
KEEP = ["event_id", "vehicle_id", "time", "delay", "speed", "lat", "lon", "service_date"]


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as text, some of it dirty."""
    p = positions(spark, sf_dir)
    e = F.col("event_id")
    dirty = F.when(e % 11 == 0, "").when(e % 13 == 0, "abc").when(e % 17 == 0, "12.5").otherwise(F.col("delay").cast("string"))
    return p.select(
        F.date_format("time", FMT).alias("time"), F.when(e % 19 == 0, "").otherwise(F.col("vehicle_id")).alias("vehicle_id"), "line", dirty.alias("delay"),
        F.col("lat").cast("string").alias("lat"), F.when(e % 23 == 0, "x").otherwise(F.col("lon").cast("string")).alias("lon"), e.cast("string").alias("speed"),
        "route_id", "mode", F.col("route_type").cast("string").alias("route_type"), "trip_id", F.col("last_stop_sequence").cast("string").alias("last_stop_sequence"),
    )


_DELAY = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 13 ELSE delay END"
CLEAN = "date_trunc('second', time) AS time, vehicle_id, line, " + _DELAY + " AS delay, round(lat, 6) AS lat, round(lon, 6) AS lon, event_id::DOUBLE AS speed, route_id, trip_id, service_date"


@query(POS + f"SELECT {CLEAN}, CASE WHEN event_id % 2 = 0 THEN last_stop_sequence END AS last_stop_sequence FROM pos WHERE event_id % 19 <> 0 AND event_id % 23 <> 0")
def csv_lake_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of gzipped CSV files, one without a column, read by name and typed leniently."""
    out, raw = scratch(spark, "csv"), raw_text(spark, sf_dir)
    even = F.col("speed").cast("long") % 2 == 0
    for name, part in (("a", raw.filter(even)), ("b", raw.filter(~even).drop("last_stop_sequence"))):
        part.write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(f"{out}/{name}")
    found = L.typed(L.read_csv(spark, f"{out}/a", f"{out}/b"))
    return found.select("time", "vehicle_id", "line", "delay", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed", "route_id", "trip_id", "service_date", "last_stop_sequence")


@query(POS + "SELECT CASE WHEN event_id % 19 <> 0 THEN vehicle_id END AS vehicle_id, event_id::DOUBLE AS speed FROM pos WHERE event_id % 7 < 3 AND event_id % 19 <> 0 AND event_id % 23 <> 0")
def csv_first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three files by name of a folder of seven, each written by a task as its rows come, without a sort."""
    out, raw = scratch(spark, "csv"), raw_text(spark, sf_dir)
    raw.repartitionById(7, (F.col("speed").cast("long") % 7).cast("int")).write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(out)
    return L.typed(L.read_csv(spark, out, most_files=3)).select("vehicle_id", "speed")


@query(POS + f"SELECT event_id, CASE WHEN vehicle_id IS NULL THEN NULL ELSE {_DELAY} END AS delay, event_id % 19 <> 0 AND event_id % 23 <> 0 AS usable FROM pos")
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_text(spark, sf_dir)
    ok = L.blank_to_null(F.col("vehicle_id")).isNotNull() & F.col("lon").try_cast("double").isNotNull()
    return raw.select(F.col("speed").cast("long").alias("event_id"), L.lenient_int(F.col("delay")).alias("delay"), ok.alias("usable"))


@query(POS + f"SELECT {', '.join(KEEP)} FROM pos WHERE service_date BETWEEN (SELECT min(service_date) + 3 FROM pos) AND (SELECT min(service_date) + 9 FROM pos)")
def lake_write_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, p = scratch(spark, "lake"), positions(spark, sf_dir).select(*KEEP)
    L.write_lake(p, out)
    first = p.agg(F.min("service_date")).first()[0]
    day = F.col("service_date")
    return spark.read.parquet(out).filter((day >= F.date_add(F.lit(first), 3)) & (day <= F.date_add(F.lit(first), 9))).select(*KEEP)


def _refreshed(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out, p = scratch(spark, "lake"), positions(spark, sf_dir).select(*KEEP)
    versions.refresh(p, out)
    first = p.agg(F.min("service_date")).first()[0]
    fresh = p.filter((F.col("service_date") >= F.date_add(F.lit(first), 10)) & (F.col("event_id") % 2 == 0)).withColumn("delay", F.col("delay") + 1000)
    if mode == "merge":  # some rows move to another date
        fresh = fresh.filter("event_id % 6 = 0").withColumn("service_date", F.when(F.col("event_id") % 12 == 0, F.date_add("service_date", 40)).otherwise(F.col("service_date")))
    versions.refresh(fresh, out, ["event_id"] if mode == "merge" else None)
    return versions.read_versions(spark, out)


REFRESHED = POS + ", b AS (SELECT min(service_date) + 10 AS d FROM pos) SELECT event_id, vehicle_id, time, CASE WHEN service_date >= d AND event_id % 2 = 0 THEN delay + 1000 ELSE delay END AS delay, speed, lat, lon, service_date FROM pos, b"


@query(REFRESHED + " WHERE service_date < d OR event_id % 2 = 0")
def lake_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir, "replace")


@query(POS + """, b AS (SELECT min(service_date) + 10 AS d FROM pos) SELECT event_id, vehicle_id, time, CASE WHEN service_date >= d AND event_id % 6 = 0 THEN delay + 1000 ELSE delay END AS delay, speed, lat, lon,
CASE WHEN service_date >= d AND event_id % 12 = 0 THEN service_date + 40 ELSE service_date END AS service_date FROM pos, b""")
def lake_merge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir, "merge")


@query(POS + "SELECT event_id, service_date FROM pos")
def write_missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the dates are written first; the second write adds the others and leaves those alone."""
    out, p = scratch(spark, "dates"), positions(spark, sf_dir).select("event_id", "service_date")
    L.write_missing_dates(spark, p.filter(F.dayofmonth("service_date") % 2 == 0), out, None)
    L.write_missing_dates(spark, p, out, spark.read.parquet(out))
    return spark.read.parquet(out).select("event_id", "service_date")


@query(POS + "SELECT event_id, time FROM pos WHERE time >= (SELECT max(time) - INTERVAL 240 HOUR FROM pos)")
def time_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written lake has left after old rows were deleted."""
    out, p = scratch(spark, "retention"), positions(spark, sf_dir).select(*KEEP)
    versions.refresh(p, out)
    versions.expire(spark, out, "time", p.agg(F.max("time")).first()[0], 240)
    return versions.read_versions(spark, out).select("event_id", "time")


@query(POS + "SELECT lists, event_id, service_date FROM pos, (SELECT unnest([1, 2]) AS lists) WHERE lists = 1 OR time >= (SELECT max(time) - INTERVAL 240 HOUR FROM pos)")
def lake_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake before and after its old rows went, each as its list says; what no list names was swept away."""
    out, p = scratch(spark, "versions"), positions(spark, sf_dir).select(*KEEP)
    versions.refresh(p.filter("event_id % 2 = 0"), out)
    versions.refresh(p, out)
    versions.expire(spark, out, "time", p.agg(F.max("time")).first()[0], 240)
    versions.sweep(spark, out, 2, 0)
    before, after = (versions.read_versions(spark, out, n).select(F.lit(n - 1).alias("lists"), "event_id", "service_date") for n in (2, 3))
    return before.unionByName(after)


@query(POS + "SELECT event_id, time, delay, lat FROM pos WHERE time >= (SELECT max(time) - INTERVAL 5 DAY FROM pos) AND time < (SELECT max(time) - INTERVAL 2 DAY FROM pos)")
def selected_columns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns of several lakes, those of the optional ones that are there, and a half-open time filter."""
    p, outs = positions(spark, sf_dir), [scratch(spark, f"half-{k}") for k in (0, 1)]
    for k, out in enumerate(outs):
        p.filter(F.col("event_id") % 2 == k).select(*KEEP).write.parquet(out)
    found = L.read_selected(spark, outs, ["event_id", "time", "delay"], ["lat", "heading"])
    last = F.lit(p.agg(F.max("time")).first()[0])
    return found.filter((F.col("time") >= F.timestamp_add("DAY", F.lit(-5), last)) & (F.col("time") < F.timestamp_add("DAY", F.lit(-2), last)))


@query(POS + "SELECT service_date, count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, round(sum(delay)::DOUBLE, 3) AS delays FROM pos GROUP BY 1")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "compact")
    L.compact(positions(spark, sf_dir).select(*KEEP), out)
    return spark.read.parquet(out).groupBy("service_date").agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), F.round(F.sum("delay").cast("double"), 3).alias("delays"))


@query(POS + ", h AS (SELECT date_trunc('hour', min(time)) AS h FROM pos), c AS (SELECT *, (date_diff('second', h, time) // 21600)::INTEGER AS chunk FROM pos, h) SELECT chunk, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM c WHERE chunk >= 40 OR event_id % 2 = 0 GROUP BY 1")
def chunked_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows of some chunks is there already; those chunks are left as they are."""
    out, p = scratch(spark, "chunks"), positions(spark, sf_dir).select("event_id", "time", "vehicle_id")
    first = p.agg(F.date_trunc("hour", F.min(F.col("time").cast("timestamp")))).first()[0]
    since = F.timestamp_diff("HOUR", F.lit(first), F.col("time").cast("timestamp"))
    L.export_chunks(p.filter((since < 240) & (F.col("event_id") % 2 == 0)), out, 6, first)
    back = spark.read.option("header", True).schema("event_id long, time string, vehicle_id string, chunk int")
    L.export_chunks(p, out, 6, first)
    return back.csv(out).groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


def _converted(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """CSV files, the more the more rows there are, and one more that is no gzip, converted to Parquet; the folder and the report."""
    out, p = scratch(spark, "batch"), positions(spark, sf_dir).select("event_id", "line")
    p.repartition("event_id").write.option("header", True).option("compression", "gzip").csv(f"{out}/csv")
    p.limit(0).select(F.lit("")).unionAll(spark.range(1).select(F.lit("no gzip"))).coalesce(1).write.text(f"{out}/bad")
    pattern = f"{out}/{{csv,bad}}/part-*"
    return f"{out}/parquet", L.convert_files(spark, pattern, "event_id long, line string", f"{out}/parquet")


@query(POS + "SELECT line, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM pos GROUP BY 1")
def batch_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files to Parquet in one job, a folder for each file; a file that is no gzip is left out."""
    out, _ = _converted(spark, sf_dir)
    return spark.read.parquet(f"{out}/rows").groupBy("line").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("SELECT unnest([true, false]) AS converted, unnest([(SELECT count(DISTINCT event_type) FROM events) > 0, true]) AS found")
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of files the conversion met."""
    return _converted(spark, sf_dir)[1].groupBy("converted").agg((F.count("*") > 0).alias("found"))


@query(PRED + "SELECT event_id, round(risk, 9) AS risk, raw_alert AS alert FROM pred ORDER BY pred.risk DESC, event_id LIMIT 50")
def scored_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "scored")
    L.write_scored(predictions(spark, sf_dir).withColumn("alert", F.col("raw_alert")).select("event_id", "risk", "alert"), out, "top", "json")
    back = spark.read.schema("event_id long, risk string, alert string").json(out)
    return L.coerce_alerts(back).select("event_id", F.round("risk", 9).alias("risk"), "alert")


@query(PRED + "SELECT 'alerts' AS scope, count(*) AS rows, sum(event_id)::BIGINT AS ids, round(sum(risk), 6) AS risk FROM pred WHERE raw_alert UNION ALL SELECT 'all', count(*), sum(event_id)::BIGINT, round(sum(risk), 6) FROM pred")
def scored_output_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as CSV and all rows as Parquet."""
    out, rows = scratch(spark, "scored"), predictions(spark, sf_dir).withColumn("alert", F.col("raw_alert")).select("event_id", "risk", "alert")
    L.write_scored(rows, f"{out}/alerts", "alerts", "csv")
    L.write_scored(rows, f"{out}/all", "all", "parquet")
    back = {"alerts": spark.read.option("header", True).schema("event_id long, risk double, alert boolean").csv(f"{out}/alerts"), "all": spark.read.parquet(f"{out}/all")}
    found = None
    for scope, df in back.items():
        one = df.agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.round(F.sum("risk"), 6).alias("risk")).withColumn("scope", F.lit(scope))
        found = one if found is None else found.unionByName(one)
    return found


@query(PRED + "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0.0 ELSE round(risk, 9) END AS risk, raw_alert AND event_id % 3 <> 0 AS alert FROM pred")
def scored_alert_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON arrays, with members that are no objects, risks that are no numbers and alerts that are no booleans."""
    e = F.col("event_id")
    risk = F.when(e % 5 == 0, "n/a").when(e % 7 == 0, "NaN").otherwise(F.col("risk").cast("string"))
    one = F.to_json(F.struct("event_id", risk.alias("risk"), F.when(e % 3 == 0, "maybe").otherwise(F.col("raw_alert").cast("string")).alias("alert")))
    texts = predictions(spark, sf_dir).groupBy("scored_at", F.floor(e / 100)).agg(F.concat(F.lit('[5, "x", [1], '), F.array_join(F.collect_list(one), ", "), F.lit(", null]")).alias("value"))
    return L.read_alerts(texts, "event_id long, risk string, alert string").select("event_id", F.round("risk", 9).alias("risk"), "alert")


@query(PRED + "SELECT scored_at AS scored_date, count(*) AS rows, round(sum(risk), 6) AS risk, count(*) FILTER (WHERE raw_alert) AS alerts, sum(delay)::BIGINT AS delays, round(avg(lat), 6) AS lat, 0::BIGINT AS trips, 33 AS columns FROM pred WHERE event_id % 9 <> 0 GROUP BY 1")
def prediction_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a vehicle aren't stored, columns that a scorer lacks are null; two appends make one table by day."""
    out = scratch(spark, "predictions")
    p = predictions(spark, sf_dir).withColumn("vehicle_id", F.when(F.col("event_id") % 9 != 0, F.col("vehicle_id")))
    rows = p.withColumnsRenamed({"risk": "delay_increase_risk", "raw_alert": "raw_delay_increase_alert"})
    for half in (0, 1):
        L.append_predictions(rows.filter(F.col("event_id") % 2 == half), out)
    back = spark.read.parquet(out)
    return back.groupBy("scored_date").agg(
        F.count("*").alias("rows"), F.round(F.sum("delay_increase_risk"), 6).alias("risk"), F.count_if("raw_delay_increase_alert").alias("alerts"), F.sum("delay").alias("delays"),
        F.round(F.avg("lat"), 6).alias("lat"), F.count("trip_id").alias("trips"), F.lit(len(back.columns) - 1).alias("columns"),
    )


ROUTES = ", routes AS (SELECT 'L' || r AS route_id, CAST(r % 4 AS INTEGER) AS route_type FROM (SELECT DISTINCT user_id % 20 AS r FROM events) WHERE r % 6 <> 5)"


def routes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule's routes as text, with blanks, an earlier type for each, and types that are no integers."""
    out = scratch(spark, "routes")
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("r")).distinct()
    rows = r.select(F.explode(F.array(F.struct((F.col("r") * 2).alias("row"), F.concat(F.lit(" L"), "r", F.lit(" ")).alias("id"), F.lit("9").alias("type")), F.struct((F.col("r") * 2 + 1).alias("row"), F.concat(F.lit("L"), "r").alias("id"), (F.col("r") % 4).cast("string").alias("type")))).alias("x"), "r")
    dirty = rows.select("x.row", F.when(F.col("r") % 6 == 5, " ").otherwise(F.col("x.id")).alias("route_id"), "x.type")
    dirty.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return L.read_routes(spark, out)


@query(POS + ROUTES + "SELECT route_id, route_type FROM routes")
def routes_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir)


@query(POS + ROUTES + "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN p.route_type END, r.route_type) AS route_type FROM pos p LEFT JOIN routes r USING (route_id)")
def route_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).withColumn("route_type", F.when(F.col("event_id") % 2 == 0, F.col("route_type")))
    return L.with_route_type(p, routes_of(spark, sf_dir)).select("event_id", "route_type")


@query(POS + "SELECT event_id, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' WHEN 4 THEN 'ferry' ELSE 'unknown' END AS mode FROM pos")
def route_type_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_mode(positions(spark, sf_dir)).select("event_id", "mode")


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update messages as JSON text; some aren't JSON, some no objects, some lack a latitude."""
    p, e = positions(spark, sf_dir), F.col("event_id")
    m = F.to_json(F.struct(
        F.col("vehicle_id").alias("id"), "line", F.when(e % 4 == 0, "true").when(e % 5 == 0, "7.9").otherwise(F.col("delay").cast("string")).alias("delay"), F.when(e % 10 != 3, F.col("lat")).alias("lat"), "lon",
        F.floor("speed").alias("speed"), "route_id", "trip_id", "mode", "last_stop_sequence", "next_stop_sequence", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingest_ts"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observation_ts"),
    ))
    return p.select("event_id", "service_date", F.when(e % 10 == 1, "not json").when(e % 10 == 2, "[1, 2]").otherwise(m).alias("value"))


@query(POS + "SELECT vehicle_id, count(*) AS rows, sum(CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 7 ELSE delay END)::BIGINT AS delays, sum(coalesce(floor(speed), 0))::BIGINT AS speeds FROM pos WHERE event_id % 10 NOT IN (1, 2, 3) GROUP BY 1")
def message_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.parse_messages(messages_of(spark, sf_dir))
    return found.groupBy("vehicle_id").agg(F.count("*").alias("rows"), F.sum("delay").alias("delays"), F.sum("speed").alias("speeds"))


def feed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the vehicle feed for each day and hour, from positions."""
    p, e = positions(spark, sf_dir), F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    gtfs = F.struct("trip_id", "route_id", F.when(e % 3 != 0, F.col("line")).alias("route_short_name"), text("route_type").alias("route_type"))
    last = F.struct("speed", F.lit("on_track").alias("state_position"), F.date_format("time", FMT).alias("origin_timestamp"), F.struct(F.col("delay").alias("actual")).alias("delay"), F.struct(F.col("last_stop_sequence").alias("sequence")).alias("last_stop"))
    props = F.struct(F.when(e % 2 == 0, F.col("vehicle_id")).alias("vehicle_id"), F.struct(F.concat(F.lit("reg-"), "vehicle_id").alias("vehicle_registration_number"), gtfs.alias("gtfs")).alias("trip"), last.alias("last_position"))
    feature = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))
    return p.groupBy(F.date_trunc("hour", F.col("time").cast("timestamp")).alias("hour")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).select("value", F.date_format("hour", FMT).alias("ingest_ts"))


@query(POS + """SELECT CASE WHEN event_id % 2 = 0 THEN vehicle_id ELSE 'reg-' || vehicle_id END AS vehicle_id, CASE WHEN event_id % 3 <> 0 THEN line ELSE route_id END AS line, count(*) AS rows, sum(delay)::BIGINT AS delays, round(sum(lat), 6) AS lats,
max(CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' WHEN 4 THEN 'ferry' ELSE 'unknown' END) AS mode FROM pos GROUP BY 1, 2""")
def feed_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.parse_feed(feed_of(spark, sf_dir))
    return found.groupBy("vehicle_id", "line").agg(F.count("*").alias("rows"), F.sum("delay").alias("delays"), F.round(F.sum("lat"), 6).alias("lats"), F.max("mode").alias("mode"))


#: For each place of a feature, its JSON by the remainder of event_id, and what the row holds then; other remainders have an ordinary value.
_IDS, _LINES, _DELAYS, _PLACES, _TYPES, _BROKEN = 7, 11, 13, 5, 9, 31


def mixed_feed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose values have all kinds of types, and features that are broken in several ways."""
    p, e = positions(spark, sf_dir), F.col("event_id")
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    pick = lambda n, cases, other: reduce(lambda w, k: w.when(e % n == k[0], k[1]), cases[1:], F.when(e % n == cases[0][0], cases[0][1])).otherwise(other)
    lit = lambda *cases: [(k, F.lit(v)) for k, v in enumerate(cases)]
    ids = pick(_IDS, lit("0", '""', "null", "false", "[]"), text("vehicle_id"))
    lines = pick(_LINES, lit("12", "null", "true", '["x"]'), text("line"))
    short = pick(2, lit("5"), F.concat(F.lit('"s'), (e % 3).cast("string"), F.lit('"')))
    delays = pick(_DELAYS, lit('"90"', "null", "true", "{}"), text("delay"))
    actual = pick(3, lit('"7"', "8.9"), F.lit("null"))
    lon, lat = pick(_PLACES, [(0, F.concat(F.lit('"'), text("lon"), F.lit('"'))), (1, F.lit("null"))], text("lon")), text("lat")
    kinds = pick(_TYPES, lit('" 3 "', '"x"', "2.9", "true", '"2.0"', "null"), text("route_type"))
    whole = F.concat(
        F.lit('{"geometry": {"coordinates": ['), lon, F.lit(", "), lat, F.lit(']}, "properties": {"vehicle_id": '), ids, F.lit(', "route_short_name": '), lines, F.lit(', "delay": '), delays,
        F.lit(', "trip": {"vehicle_registration_number": "reg", "gtfs": {"route_short_name": '), short, F.lit(', "route_id": '), text("route_id"), F.lit(', "route_type": '), kinds,
        F.lit('}}, "last_position": {"speed": "3", "delay": {"actual": '), actual, F.lit("}}}}"),
    )
    broken = lit("7", '"text"', "[1, 2]", "null", '{"properties": 5}', '{"geometry": {"coordinates": [14, 50]}, "properties": {"vehicle_id": "v", "trip": [1]}}', '{"geometry": {"coordinates": [14]}, "properties": {"vehicle_id": "v"}}', '{"geometry": "x", "properties": {"vehicle_id": "v"}}',
                 '{"geometry": {"coordinates": [14, 50]}, "properties": {"vehicle_id": "v", "last_position": {"delay": 5}}}')
    feature = pick(_BROKEN, broken, whole)
    return p.groupBy(F.date_trunc("hour", F.col("time").cast("timestamp")).alias("hour")).agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list(feature), ", "), F.lit("]}")).alias("value")).select("value", F.date_format("hour", FMT).alias("ingest_ts"))


@query(POS + """SELECT CASE WHEN event_id % 7 < 5 THEN 'reg' ELSE vehicle_id END AS vehicle_id, CASE WHEN event_id % 11 > 3 THEN line WHEN event_id % 2 = 0 THEN route_id ELSE 's' || (event_id % 3) END AS line,
CASE event_id % 9 WHEN 0 THEN 3 WHEN 1 THEN NULL WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE route_type END AS route_type, count(*) AS rows,
sum(CASE WHEN event_id % 13 > 3 THEN delay WHEN event_id % 13 = 2 THEN 1 WHEN event_id % 3 = 1 THEN 8 ELSE 0 END)::BIGINT AS delays, round(sum(lat + lon), 6) AS places, count(NULL) AS speeds
FROM pos WHERE event_id % 31 > 8 AND event_id % 5 <> 1 GROUP BY ALL""")
def feed_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.parse_feed(mixed_feed_of(spark, sf_dir))
    return found.groupBy("vehicle_id", "line", "route_type").agg(F.count("*").alias("rows"), F.sum("delay").alias("delays"), F.round(F.sum(F.col("lat") + F.col("lon")), 6).alias("places"), F.count("speed").alias("speeds"))


@query(POS + "SELECT service_date, count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, min(time) AS first_time, max(time) AS last_time FROM pos GROUP BY 1")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the named views of a written lake: its rows, and its days over those."""
    out = scratch(spark, "lake")
    L.write_lake(positions(spark, sf_dir).select(*KEEP), out)
    spark.read.parquet(out).createOrReplaceTempView("vehicle_positions")
    spark.sql("CREATE OR REPLACE TEMP VIEW vehicle_days AS SELECT service_date, count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, min(time) AS first_time, max(time) AS last_time FROM vehicle_positions GROUP BY service_date")
    return spark.table("vehicle_days")


@query(POS + "SELECT count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, min(time) AS first_time, max(time) AS last_time, count(DISTINCT service_date) AS partitions, true AS has_files, true AS has_bytes FROM pos")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a written lake; files and bytes depend on the writer, so that the query says only whether they fit."""
    out = scratch(spark, "lake")
    L.write_lake(positions(spark, sf_dir).select(*KEEP), out)
    rows = spark.read.parquet(out).agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.countDistinct("service_date").alias("partitions"))
    files = L.files_of(spark, f"{out}/*/*.parquet").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return rows.crossJoin(F.broadcast(files)).select(*rows.columns, (F.col("files") >= F.col("partitions")).alias("has_files"), (F.col("bytes") > F.col("rows")).alias("has_bytes"))


@query(POS + "SELECT DISTINCT service_date FROM pos")
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("service_date").distinct()


@query(POS + "SELECT DISTINCT service_date FROM pos WHERE service_date NOT IN (SELECT service_date FROM pos WHERE delay >= 450)")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return p.select("service_date").distinct().join(p.filter("delay >= 450").select("service_date"), "service_date", "left_anti")


@query(POS + "SELECT event_id FROM pos WHERE lat BETWEEN 49.9 AND 50.2 AND lon BETWEEN 14.2 AND 14.75")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).filter(within(F.col("lat"), F.col("lon"))).select("event_id")


@query(POS + "SELECT event_id FROM pos WHERE speed IS NOT NULL AND delay IS NOT NULL")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.require(positions(spark, sf_dir), ["speed", "delay"]).dropna(subset=["speed", "delay"]).select("event_id")


@query(POS + ", d AS (SELECT min(service_date) + 5 AS d FROM pos) SELECT event_id FROM pos, d WHERE service_date BETWEEN d - 1 AND d + 2 AND time >= d - INTERVAL 15 MINUTE AND time < d + INTERVAL 1 DAY + INTERVAL 1 DAY + INTERVAL 12 HOUR")
def date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day with its margins, and the dates that can hold them, for partition pruning."""
    p = positions(spark, sf_dir)
    day = F.date_add(F.lit(p.agg(F.min("service_date")).first()[0]), 5)
    start = day.cast("timestamp_ntz")
    inside = (F.col("time") >= F.timestamp_add("MINUTE", F.lit(-15), start)) & (F.col("time") < F.timestamp_add("HOUR", F.lit(60), start))
    return p.filter(F.col("service_date").between(F.date_sub(day, 1), F.date_add(day, 2)) & inside).select("event_id")


@query(POS + "SELECT event_id FROM pos WHERE time >= (SELECT max(time) - INTERVAL 20 HOUR FROM pos)")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hours of the data, not of the clock."""
    p = positions(spark, sf_dir)
    last = p.agg(F.max("time").alias("last"))
    return p.crossJoin(F.broadcast(last)).filter(F.col("time") >= F.timestamp_add("HOUR", F.lit(-20), "last")).select("event_id")


@query(POS + ", k AS (SELECT event_id FROM pos WHERE time >= (SELECT max(time) - INTERVAL 14 DAY FROM pos)) SELECT event_id, (SELECT count(*) FROM pos) AS rows_before, (SELECT count(*) FROM k) AS rows_after FROM k")
def rolling_train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, before, after = X.rolling_window(positions(spark, sf_dir), 14)
    return rows.select("event_id", F.lit(before).cast("long").alias("rows_before"), F.lit(after).cast("long").alias("rows_after"))


@query(POS + ", i AS (SELECT *, row_number() OVER (ORDER BY time, vehicle_id) - 1 AS i, count(*) OVER () AS n FROM pos) SELECT event_id FROM i WHERE i = 0 OR i * 700 // n <> (i - 1) * 700 // n")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spread_sample(positions(spark, sf_dir), ["time", "vehicle_id"], 700).select("event_id")


@query(POS + ", i AS (SELECT *, row_number() OVER (ORDER BY time, vehicle_id) - 1 AS i, count(*) OVER () AS n FROM pos), w AS (SELECT DISTINCT j * (n - 1) // 299 AS i FROM (SELECT unnest(range(300)) AS j), (SELECT count(*) AS n FROM pos)) SELECT event_id FROM i JOIN w USING (i)")
def spread_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spread_indices(positions(spark, sf_dir), ["time", "vehicle_id"], 300).select("event_id")


@query(POS + ", i AS (SELECT *, row_number() OVER (ORDER BY time, vehicle_id) - 1 AS i, count(*) OVER () AS n FROM pos) SELECT event_id, CASE WHEN i < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN i < trunc(n * 0.7::DOUBLE) + trunc(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM i")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_ordered(positions(spark, sf_dir), ["time", "vehicle_id"]).select("event_id", "split")


@query(POS + ", i AS (SELECT *, row_number() OVER (ORDER BY time, vehicle_id) - 1 AS i, count(*) OVER () AS n FROM pos), s AS (SELECT *, CASE WHEN i < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN i < trunc(n * 0.7::DOUBLE) + trunc(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM i) SELECT split, count(*) AS rows, round(avg((delay >= 60)::INTEGER), 9) AS positive_rate, min(time) AS first_time, max(time) AS last_time FROM s GROUP BY 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_ordered(positions(spark, sf_dir), ["time", "vehicle_id"]).groupBy("split").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("delay") >= 60).cast("double")), 9).alias("positive_rate"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(POS + ", d AS (SELECT DISTINCT service_date AS s FROM pos ORDER BY 1 DESC LIMIT 3) SELECT event_id, service_date IN (SELECT s FROM d) AS test FROM pos")
def date_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return p.select("event_id", X.holdout(p, 3).alias("test"))


@query(POS + ", d AS (SELECT service_date, row_number() OVER (ORDER BY service_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT service_date FROM pos)) SELECT event_id, service_date FROM pos WHERE service_date IN (SELECT service_date FROM d WHERE k IN (SELECT round_even(j * (n - 1) / 3, 0) FROM (SELECT unnest(range(4)) AS j)))")
def date_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.select_dates(positions(spark, sf_dir), 4, "spread").select("event_id", "service_date")


@query(POS + "SELECT service_date, count(*) FILTER (WHERE speed IS NOT NULL AND delay >= 60) AS eligible FROM pos GROUP BY 1 HAVING count(*) FILTER (WHERE speed IS NOT NULL AND delay >= 60) > 0")
def eligible_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).groupBy("service_date").agg(F.count_if(F.col("speed").isNotNull() & (F.col("delay") >= 60)).alias("eligible")).filter("eligible > 0")


@query(POS + ", n AS (SELECT unnest(['delay', 'speed', 'lat', 'blank']) AS column_name, unnest([count(delay), count(speed), count(lat), count(NULL)]) AS n FROM pos) SELECT column_name FROM n WHERE n > 0")
def observed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).withColumn("blank", F.lit(None).cast("double"))
    return spark.createDataFrame([(c,) for c in X.observed_columns(p, ["delay", "speed", "lat", "blank", "absent"])], "column_name string")


@query(POS + "SELECT event_id, time FROM pos ORDER BY md5('42|' || event_id), event_id LIMIT 500")
def seeded_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.capped(positions(spark, sf_dir), 500, 42, ["event_id"], ["time", "vehicle_id"]).select("event_id", "time")
