"""Sources and sinks of positions: lenient CSV, partitioned Parquet, incremental refresh, retention, export."""

from __future__ import annotations

import gzip
import re
import zlib
from datetime import datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.timeutil import blank_to_null, lenient_int, truncated_int

TEXT_COLUMNS = (
    "time vehicle_id line delay lat lon speed route_id mode route_type trip_id state_position origin_timestamp last_stop_id last_stop_sequence "
    "last_stop_arrival_time last_stop_departure_time next_stop_id next_stop_sequence next_stop_arrival_time next_stop_departure_time"
).split()
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEXT_COLUMNS])
INTEGERS = ("delay", "last_stop_sequence", "next_stop_sequence")
DOUBLES = ("lat", "lon", "speed")
TIMES = ("time", "origin_timestamp", "last_stop_arrival_time", "last_stop_departure_time", "next_stop_arrival_time", "next_stop_departure_time")
REQUIRED = ("time", "vehicle_id", "lat", "lon")
#: Route types of the feed's schedule standard. Fixed values.
MODES = {0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 11: "trolleybus"}


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file below a folder or pattern; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_csv(spark: SparkSession, *sets: str, most_files: int = 0) -> DataFrame:
    """Text columns of sets of files (plain or gzip), joined by name: a set may lack columns or have them in another order.

    most_files: only so many files of each set, the first in the order of their names.
    """
    out = None
    for path in sets:
        paths = [r["path"] for r in files_of(spark, path).orderBy("path").limit(most_files).collect()] if most_files > 0 else path
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).option("inferSchema", False).csv(paths)
        part = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in TEXT_COLUMNS])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def lenient_time(text: Column) -> Column:
    return F.to_timestamp_ntz(F.regexp_replace(F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00(:?00)?)?\s*$"), text), r"T|\s*(Z|\+00(:?00)?)\s*$", " "))


def typed(raw: DataFrame) -> DataFrame:
    """Text columns to types; what doesn't fit is null. Rows without a required column go."""
    cast = {c: lenient_int(F.col(c)) for c in INTEGERS} | {c: F.col(c).try_cast("double") for c in DOUBLES} | {c: lenient_time(F.col(c)) for c in TIMES}
    cast["route_type"] = lenient_int(F.col("route_type")).cast("short")
    cast["vehicle_id"] = blank_to_null(F.col("vehicle_id"))
    found = raw.withColumns(cast).dropna(subset=list(REQUIRED))
    return found.withColumn("service_date", F.to_date("time"))


def with_mode(df: DataFrame) -> DataFrame:
    """mode from route_type, unknown where there is none."""
    modes = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    return df.withColumn("mode", F.coalesce(F.try_element_at(modes, F.col("route_type").cast("int")), F.lit("unknown")))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """route_id and route_type of a schedule; blank ids and types that are no integers go; the last of a route counts."""
    raw = spark.read.option("header", True).schema("row long, route_id string, route_type string").csv(path)
    clean = raw.select("row", F.trim("route_id").alias("route_id"), F.trim("route_type").try_cast("int").alias("route_type")).filter("route_id <> '' AND route_type IS NOT NULL")
    return clean.groupBy("route_id").agg(F.max_by("route_type", "row").alias("route_type"))


def with_route_type(df: DataFrame, routes: DataFrame) -> DataFrame:
    """route_type from the routes where a row has none; routes are a schedule's, which Spark broadcasts if it is small."""
    found = routes.select(F.col("route_id").alias("__id"), F.col("route_type").alias("__type"))
    return df.join(found, F.col("route_id") == F.col("__id"), "left").withColumn("route_type", F.coalesce("route_type", "__type")).drop("__id", "__type")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_selected(spark: SparkSession, paths: list[str], required: list[str], optional: list[str]) -> DataFrame:
    """Required columns, which must be there, and those of the optional ones that are."""
    df = require(spark.read.parquet(*paths), required)
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def write_lake(df: DataFrame, path: str, force: bool = False) -> None:
    """By service_date, sorted for pruning by vehicle; an existing lake is an error unless force."""
    df.repartition("service_date", F.hour("time")).sortWithinPartitions("service_date", "vehicle_id", "time").write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").partitionBy("service_date").parquet(path)


def by_date(df: DataFrame, parts: int = 4) -> DataFrame:
    """df dealt out by date, a date to a few tasks, so that it is neither one task's work nor many small files."""
    return df.repartition("service_date", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))


def write_missing_dates(spark: SparkSession, df: DataFrame, path: str, there: DataFrame | None, force: bool = False) -> None:
    """All dates in one job; dates that are there are left alone unless force."""
    if there is not None and not force:
        df = df.join(there.select("service_date").distinct(), "service_date", "left_anti")
    by_date(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("service_date").parquet(path)


def retained(df: DataFrame, column: str, newest: Column, hours: int) -> DataFrame:
    """Rows no older than hours before the newest; on a partitioned table Spark prunes whole partitions."""
    return df.filter(F.col(column) >= F.timestamp_add("HOUR", F.lit(-hours), newest))


def compact(df: DataFrame, path: str, files: int = 4) -> None:
    """Some files for each date, clustered by vehicle, newest first within a file."""
    dealt = df.repartition("service_date", F.pmod(F.xxhash64("vehicle_id"), F.lit(files)))
    dealt.sortWithinPartitions("service_date", "vehicle_id", F.desc("time")).write.mode("overwrite").option("compression", "zstd").partitionBy("service_date").parquet(path)


def chunks_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the chunks that a folder of exports holds, as its listing says."""
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunk=*")
    found = folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folders)
    return sorted(int(x.getPath().getName().removeprefix("chunk=")) for x in found or ())


def export_chunks(df: DataFrame, path: str, hours: int, first: datetime | None = None, parts: int = 4) -> None:
    """Gzipped CSV in chunks of hours, from the first hour on (that of df by default), but for chunks that the folder holds.

    A chunk is some tasks and files, whatever its share of the rows.
    """
    first = first or df.agg(F.date_trunc("hour", F.min(F.col("time").cast("timestamp")))).first()[0]
    since = F.timestamp_diff("HOUR", F.lit(first), F.col("time").cast("timestamp"))
    chunked = df.withColumn("chunk", F.floor(since / hours).cast("int"))
    there = chunks_of(df.sparkSession, path)
    if there:
        chunked = chunked.filter(~F.col("chunk").isin(there))
    dealt = chunked.repartition("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    dealt.write.mode("append").option("header", True).option("compression", "gzip").partitionBy("chunk").csv(path)


def whole_gzip(path: str) -> bool:
    """Whether a file is a whole gzip; it is read as a stream, of any length."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
    try:
        with system.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as file:
            while file.read(1 << 20):
                pass
    except (OSError, EOFError, zlib.error):
        return False
    return True


def convert_files(spark: SparkSession, source: str, schema: str, out: str) -> DataFrame:
    """Every gzipped CSV file of a folder into a folder of Parquet named by it; path, and whether it was converted.

    Files that are no whole gzip are left out and reported. Spark's committer renames finished output only.
    """
    found = spark.read.format("binaryFile").load(source).select("path", F.udf(whole_gzip, "boolean")("path").alias("converted"))
    found.write.parquet(f"{out}/report")
    report = spark.read.parquet(f"{out}/report")
    good = [r["path"] for r in report.filter("converted").select("path").collect()]  # a row for each file, as any listing is
    if good:
        rows = spark.read.option("header", True).schema(schema).csv(good).withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv\.gz$", 1))
        rows.write.partitionBy("source").parquet(f"{out}/rows")
    return report


def write_scored(df: DataFrame, path: str, scope: str, kind: str, top: int = 50) -> None:
    """scope top, alerts or all; kind json, csv or parquet."""
    if scope == "top":
        df = df.orderBy(F.desc("risk"), "event_id").limit(top)
    elif scope == "alerts":
        df = df.filter("alert")
    elif scope != "all":
        raise ValueError(f"no scope {scope}")
    {"json": df.write.json, "csv": lambda p: df.write.option("header", True).csv(p), "parquet": df.write.parquet}[kind](path)


def message_schema() -> T.StructType:
    text = "id line delay lat lon speed route_id trip_id route_type mode state_position origin_timestamp last_stop_id last_stop_sequence last_stop_arrival_time last_stop_departure_time next_stop_id next_stop_sequence next_stop_arrival_time next_stop_departure_time ingest_ts observation_ts"
    return T.StructType([T.StructField(c, T.StringType()) for c in text.split()])


def parse_messages(messages: DataFrame, zero: bool = True) -> DataFrame:
    """Rows of update messages (``value``: JSON); those that are no objects or lack id, lat or lon go.

    zero: a missing delay or speed is 0, as in the live table; else null, as in the lake.
    """
    m = messages.select(F.from_json("value", message_schema(), {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    number = lambda c: F.coalesce(truncated_int(F.col(c)), F.lit(0)) if zero else truncated_int(F.col(c))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    rows = m.select(
        F.col("id").alias("vehicle_id"), lat.alias("lat"), lon.alias("lon"), number("delay").alias("delay"), number("speed").alias("speed"),
        F.coalesce(blank_to_null(F.col("line")), F.lit("unknown")).alias("line"), blank_to_null(F.col("route_id")).alias("route_id"), blank_to_null(F.col("trip_id")).alias("trip_id"),
        F.coalesce(blank_to_null(F.col("mode")), F.lit("unknown")).alias("mode"), truncated_int(F.col("last_stop_sequence")).alias("last_stop_sequence"), truncated_int(F.col("next_stop_sequence")).alias("next_stop_sequence"),
        F.to_timestamp("ingest_ts").alias("ingest_ts"), F.coalesce(F.try_to_timestamp("observation_ts"), F.to_timestamp("ingest_ts")).alias("observation_ts"),
    )
    return rows.filter("vehicle_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


#: Kinds of numbers in JSON, as Spark names them.
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


class Json:
    """One VARIANT, told apart by the kind of what it holds. A place that is missing is null and has no kind."""

    def __init__(self, at: Column) -> None:
        self.at = at

    def of(self, kind: str, path: str = "$") -> Column:
        return F.try_variant_get(self.at, path, kind)

    @property
    def kind(self) -> Column:
        return F.schema_of_variant(self.at)

    def text(self) -> Column:
        """What is a string, else null."""
        return F.when(self.kind == "STRING", self.of("string"))

    def number(self, boolean: bool = True) -> Column:
        """What is a number, and if boolean also 1 and 0 for true and false, else null."""
        found = F.when(self.kind.rlike(NUMBERS), self.of("double"))
        return F.when(self.kind == "BOOLEAN", self.of("boolean").cast("double")).otherwise(found) if boolean else found

    def empty(self) -> Column:
        """Missing, null, false, 0, or without any member or character."""
        text = F.coalesce(F.to_json(self.at), F.lit("null"))
        return text.isin("null", "false", '""', "[]", "{}") | F.coalesce(self.number() == 0, F.lit(False))

    def value(self) -> Column:
        """As text whatever is not empty, else null."""
        return F.when(~self.empty(), F.coalesce(self.of("string"), F.to_json(self.at)))


def opened(df: DataFrame, places: dict[str, str]) -> DataFrame:
    """df with each VARIANT column ``place`` and, as ``place_``, a struct of its members as VARIANTs; null where it is no object."""
    kind = lambda members: "struct<" + ", ".join(f"{c}: variant" for c in members.split()) + ">"
    return df.withColumns({f"{c}_": F.try_variant_get(c, "$", kind(members)) for c, members in places.items()})


def kept_once(df: DataFrame, condition: Column) -> DataFrame:
    """df's rows that meet a condition on costly columns. A plain filter would be moved below them and make them a second time."""
    return df.select("*", F.explode_outer(F.array(condition)).alias("__kept")).filter("__kept").drop("__kept")


def parse_feed(snapshots: DataFrame) -> DataFrame:
    """One row for each feature of GeoJSON snapshots (``value``, ``ingest_ts``), with the first usable id, line and delay.

    Feeds hold values of any type. The first id that is not empty counts, and the first line that is a string; a delay or
    speed counts only as a number, a route type also as the text of an integer; coordinates may be numbers or their text.
    A feature whose properties, trip, schedule part or geometry is something other than an object is lost, and so is one
    without an id or two coordinates; each costs no other.

    Objects are opened one inside the other, each once, so that no path is walked again for every leaf.
    """
    each = snapshots.select("ingest_ts", F.explode(F.from_json("value", "features array<string>")["features"]).alias("text"))
    j = lambda path: Json(F.col(path))
    usable = lambda c: F.col(f"{c}_").isNotNull() | j(c).empty()
    f = opened(each.select("ingest_ts", F.try_parse_json("text").alias("feature")), {"feature": "geometry properties"})
    f = f.select("ingest_ts", "feature_.geometry", "feature_.properties")
    f = opened(f, {"geometry": "coordinates", "properties": "vehicle_id route_short_name delay trip last_position"})
    f = kept_once(f, usable("properties") & usable("geometry"))
    f = opened(f.select("ingest_ts", "geometry_", "properties_", F.col("properties_.trip").alias("trip"), F.col("properties_.last_position").alias("last")), {"trip": "vehicle_registration_number gtfs origin_route_name", "last": "delay speed state_position origin_timestamp last_stop next_stop"})
    f = f.withColumns({"gtfs": F.col("trip_.gtfs"), "late": F.col("last_.delay"), "last_stop": F.col("last_.last_stop"), "next_stop": F.col("last_.next_stop")})
    f = opened(f, {"gtfs": "trip_id route_short_name route_id route_type", "late": "actual", "last_stop": "id sequence arrival_time departure_time", "next_stop": "id sequence arrival_time departure_time"})
    f = kept_once(f.withColumn("set_delay", j("properties_.delay").number()), usable("trip") & usable("gtfs") & (F.col("set_delay").isNotNull() | usable("late")))
    whole = lambda c: F.when(c.isNotNull(), c.try_cast("int"))
    typed_text = F.regexp_extract(j("gtfs_.route_type").text(), r"^\s*([+-]?[0-9]+)\s*$", 1)
    places = {"lat": "$[1]", "lon": "$[0]"}
    # A feature that is no object has no id.
    f = f.withColumn("vehicle_id", F.coalesce(j("properties_.vehicle_id").value(), j("trip_.vehicle_registration_number").value(), j("gtfs_.trip_id").value()))
    f = kept_once(f.withColumns({c: j("geometry_.coordinates").of("double", path) for c, path in places.items()}), F.expr("vehicle_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"))
    stops = [j(f"{side}_.{c}").of(kind).alias(f"{side}_{c}") for side in ("last_stop", "next_stop") for c, kind in (("id", "string"), ("sequence", "int"), ("arrival_time", "string"), ("departure_time", "string"))]
    rows = f.select(
        "vehicle_id",
        F.coalesce(j("properties_.route_short_name").text(), j("gtfs_.route_short_name").text(), j("gtfs_.route_id").text(), j("trip_.origin_route_name").text(), F.lit("unknown")).alias("line"),
        whole(F.coalesce("set_delay", j("late_.actual").number(), F.lit(0.0))).alias("delay"), whole(j("last_.speed").number()).alias("speed"),
        "lat", "lon", blank_to_null(j("gtfs_.route_id").text()).alias("route_id"),
        j("gtfs_.trip_id").of("string").alias("trip_id"), F.coalesce(whole(j("gtfs_.route_type").number(boolean=False)), F.nullif(typed_text, F.lit("")).try_cast("int")).alias("route_type"),
        j("last_.state_position").text().alias("state_position"), F.coalesce(j("last_.origin_timestamp").value(), F.col("ingest_ts")).alias("observation_ts"), *stops,
    )
    return with_mode(rows)


def coerce_alerts(raw: DataFrame) -> DataFrame:
    """Scored alerts read as text: risk that is no number is 0, an alert that isn't true is false."""
    risk = F.col("risk").try_cast("double")
    return raw.withColumns({"risk": F.coalesce(F.when(~F.isnan(risk), risk), F.lit(0.0)), "alert": F.coalesce(F.lower("alert").try_cast("boolean"), F.lit(False))})



#: Columns of the table of predictions. Fixed values.
PREDICTIONS = (
    "scored_at timestamp, vehicle_id string, position_time timestamp, delay_increase_risk double, raw_delay_increase_alert boolean, delay_increase_alert boolean, alert_policy_reason string, alert_rank int, "
    "threshold double, alert_min_risk double, model_path string, model_mtime double, score_source string, context_minutes int, sampling_seconds int, output_freshness_seconds int, line string, route_id string, "
    "trip_id string, mode string, state_position string, delay int, actual_increase_60s int, delay_delta_1 double, delay_mean_3 double, speed double, speed_delta_1 double, last_stop_id string, next_stop_id string, "
    "last_stop_sequence int, next_stop_sequence int, lat double, lon double"
)


def as_predictions(df: DataFrame) -> DataFrame:
    """df as rows of the table of predictions: columns that are missing are null, and rows without run, vehicle or time go."""
    there = set(df.columns)
    fields = [c.strip().split(" ") for c in PREDICTIONS.split(",")]
    typed_ = df.select(*[(F.col(c).try_cast(t) if c in there else F.lit(None).cast(t)).alias(c) for c, t in fields])
    return typed_.dropna(subset=["scored_at", "position_time", "vehicle_id"])


def append_predictions(df: DataFrame, path: str) -> None:
    as_predictions(df).withColumn("scored_date", F.to_date("scored_at")).write.mode("append").option("compression", "zstd").partitionBy("scored_date").parquet(path)


def read_alerts(texts: DataFrame, schema: str) -> DataFrame:
    """Alerts of JSON arrays (``value``), coerced; members that are no objects go."""
    each = texts.select(F.explode(F.from_json("value", "array<string>")).alias("text")).filter(F.startswith(F.ltrim("text"), F.lit("{")))
    return coerce_alerts(each.select(F.from_json("text", schema).alias("a")).select("a.*"))
