"""A lake whose dates change together: writers add folders, and the rename of one small list makes them the lake.

Rows lie in ``service_date=<date>/version=<id>``; ``_lists/<number>.json`` names the version that stands for each date, and
the list with the highest number counts. A writer that fails before its rename leaves folders that no list names, so readers
see the old rows; two writers that began from one list can't both end, the second gets a ``Conflict``. A list has one entry
for each date and holds the schema, so that a lake without any date can be read. Rows without a date have a folder as well.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.sources.lake import by_date

#: Spark's name of the partition of null. Fixed value.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has changed the lake since this one began."""


@dataclass(frozen=True)
class Listing:
    number: int
    dates: dict[str, str]
    schema: T.StructType | None


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _found(spark: SparkSession, path: str, pattern: str) -> list:
    return list(_system(spark, path).globStatus(_path(spark, path, pattern)) or ())


def current(spark: SparkSession, path: str, number: int | None = None) -> Listing:
    """The newest list, or the one with a number; a folder without any is a lake without rows."""
    numbers = [int(x.getPath().getName().removesuffix(".json")) for x in _found(spark, path, "_lists/*.json")]
    if number is None and not numbers:
        return Listing(0, {}, None)
    number = max(numbers) if number is None else number
    stream = _system(spark, path).open(_path(spark, path, "_lists", f"{number}.json"))
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Listing(number, said["dates"], T.StructType.fromJson(said["schema"]))


def _switch(spark: SparkSession, path: str, base: Listing, dates: dict[str, str], schema: T.StructType) -> None:
    """Make dates the lake, unless another list followed base."""
    draft, final = _path(spark, path, "_lists", f".{uuid.uuid4().hex}"), _path(spark, path, "_lists", f"{base.number + 1}.json")
    stream = _system(spark, path).create(draft, False)
    stream.write(bytearray(json.dumps({"dates": dates, "schema": schema.jsonValue()}), "utf-8"))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as e:
        _system(spark, path).delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"{path} has changed since list {base.number}") from e
        raise


def _rows(spark: SparkSession, path: str, listing: Listing, dates: set[str]) -> DataFrame:
    """Rows of some of the dates; folders of others aren't listed."""
    folders = [f"{path}/service_date={d}/version={v}" for d, v in sorted(listing.dates.items()) if d in dates]
    if not folders:
        return spark.createDataFrame([], listing.schema)
    return spark.read.schema(listing.schema).option("basePath", path).parquet(*folders).select(*listing.schema.names)


def read_versions(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The lake as its newest list says, or as an older one did."""
    listing = current(spark, path, number)
    if listing.schema is None:
        raise ValueError(f"nothing was written to {path}")
    return _rows(spark, path, listing, set(listing.dates))


def _add(df: DataFrame, path: str) -> dict[str, str]:
    """Write df into folders of a new version, a date to a few tasks; the version for each date that has rows."""
    version = f"v{uuid.uuid4().hex}"
    by_date(df).withColumn("version", F.lit(version)).write.mode("append").option("compression", "zstd").partitionBy("service_date", "version").parquet(path)
    there = _found(df.sparkSession, path, f"service_date=*/version={version}")
    return {x.getPath().getParent().getName().removeprefix("service_date="): version for x in there}


def _dates(df: DataFrame) -> set[str]:
    return {NO_DATE if r[0] is None else str(r[0]) for r in df.select("service_date").distinct().collect()}  # a row for each day


def refresh(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """The dates of df are replaced: by df's rows alone, or, given a key, by these and the old rows with other keys.

    Given a key, rows that stood on other dates under a key of df leave those dates, and a date without rows goes. Columns
    that the lake has and df lacks become null, and new ones are added, for the dates that are written.
    """
    spark = df.sparkSession
    base = current(spark, path)
    out = df
    if key and base.schema:
        lake = _rows(spark, path, base, set(base.dates))
        touched = _dates(df)
        touched |= _dates(lake.select("service_date", *[k for k in key if k != "service_date"]).join(df.select(*key), key, "left_semi"))
        both = df.withColumn("__new", F.lit(1)).unionByName(_rows(spark, path, base, touched).withColumn("__new", F.lit(0)), allowMissingColumns=True)
        columns = [c for c in both.columns if c != "__new"]
        out = both.groupBy(*key).agg(F.max_by(F.struct(*columns), "__new").alias("row")).select("row.*")
    written = _add(out, path)
    if not written:
        raise ValueError("no partitions to refresh")
    gone = touched if key and base.schema else set()
    kept = {d: v for d, v in base.dates.items() if d not in gone}
    fields = {f.name: T.StructField(f.name, f.dataType) for f in [*(base.schema or ()), *out.schema]}
    _switch(spark, path, base, kept | written, T.StructType(list(fields.values())))


def expire(spark: SparkSession, path: str, column: str, newest: datetime, hours: int) -> None:
    """Rows that are older than hours before newest go: whole dates, and those of the date that the limit falls on.

    ``service_date`` is the date of column; rows without one stay.
    """
    limit, base = newest - timedelta(hours=hours), current(spark, path)
    edge = limit.date().isoformat()
    kept = {d: v for d, v in base.dates.items() if d == NO_DATE or d > edge}
    if edge in base.dates:
        kept |= _add(_rows(spark, path, base, {edge}).filter(F.col(column) >= F.lit(limit)), path)
    _switch(spark, path, base, kept, base.schema)


def sweep(spark: SparkSession, path: str, lists: int = 2, hours: float = 24) -> int:
    """Delete lists but for the last few, and folders older than hours that no list left names; how many folders went.

    hours is longer than any writer or reader takes: a writer's folders have no list before it ends.
    """
    system = _system(spark, path)
    numbers = sorted(int(x.getPath().getName().removesuffix(".json")) for x in _found(spark, path, "_lists/*.json"))
    named = {(d, v) for n in numbers[-lists:] for d, v in current(spark, path, n).dates.items()}
    for n in numbers[:-lists]:
        system.delete(_path(spark, path, "_lists", f"{n}.json"), False)
    oldest, gone = datetime.now().timestamp() - 3600 * hours, 0
    for x in _found(spark, path, "service_date=*/version=*"):
        place = x.getPath().getParent().getName().removeprefix("service_date="), x.getPath().getName().removeprefix("version=")
        if place not in named and x.getModificationTime() / 1000 <= oldest:
            gone += bool(system.delete(x.getPath(), True))
    return gone
