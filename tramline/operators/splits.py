"""Row positions in time order, samples, splits and windows of training data, all without a one-task window."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of the first column of an order that rows are dealt to.
RANGES = 200


def range_of(value: Column, edges: list) -> Column:
    """The number of edges, which are sorted, that are no greater than value, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(edges[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(edges))


def edges_of(df: DataFrame, value: Column, ranges: int = RANGES) -> list:
    """Edges between ranges of value that have about as many rows each, from a sketch of quantiles."""
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(value, shares, 100 * ranges).alias("edges")).first()["edges"]
    return sorted(set(found or []))


def indexed(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """df with the position of each row, from 0, in the order of the given columns, which must tell rows apart.

    Rows are dealt to ranges of the first column that follow its quantiles, so that an hour with most of the rows is many
    ranges; a position is the place in the range plus the sizes of the ranges before.
    """
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    zoned = df.withColumn("__zone", range_of(micros, edges_of(df, micros)))
    sizes = zoned.groupBy("__zone").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__zone", before.alias("__before")))  # RANGES rows at most
    place = F.row_number().over(Window.partitionBy("__zone").orderBy(*order))
    return zoned.withColumn("__place", place).join(starts, "__zone").withColumn(name, F.col("__before") + F.col("__place") - 1).drop("__zone", "__place", "__before")


def spread_sample(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """rows of the n rows of df, evenly spread over the order: those where floor(i m / n) moves on."""
    n = df.count()
    if rows >= n:
        return df
    i = F.col("i").cast("decimal(38,0)")
    share = lambda x: F.floor(x * rows / n)
    return indexed(df, order).filter((F.col("i") == 0) | (share(i) != share(i - 1))).drop("i") if rows else df.limit(0)


def spread_indices(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Rows at int(j (n - 1) / (m - 1)) for j from 0 to m - 1."""
    n = df.count()
    steps = df.sparkSession.range(rows)
    wanted = steps.select((F.floor(F.col("id") * (n - 1) / (rows - 1)) if rows > 1 else F.lit(0)).cast("long").alias("i")).distinct()
    return indexed(df, order).join(wanted, "i", "left_semi").drop("i")


def split_ordered(df: DataFrame, order: list[str], parts: tuple[tuple[str, float], ...] = (("train", 0.7), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """df with ``split``: int(n f) rows each in time order, the last one takes the rest; the order must tell rows apart.

    No row moves: the first row of each part is looked up in its range, and every row is compared with those.
    """
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    edges, starts, n = edges_of(df, micros), {}, 0
    for zone, size in sorted(map(tuple, df.groupBy(range_of(micros, edges).alias("zone")).count().collect())):  # RANGES rows at most
        starts[zone], n = n, n + size
    bounds, at = [], 0
    for _, f in parts[:-1]:
        at += int(n * f)
        bounds.append(at)
    zone_of = {at: max(z for z, start in starts.items() if start <= at) for at in bounds if at < n}
    kinds = dict(df.dtypes)
    # Times go through the driver as text or microseconds, which no time zone of a machine changes.
    out = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.col(c).cast("string")}
    back = lambda c, v: F.timestamp_micros(F.lit(v)) if kinds[c] == "timestamp" else F.lit(v).cast(kinds[c])
    firsts = {}
    if zone_of:
        place = F.row_number().over(Window.partitionBy("__zone").orderBy(*order)) - 1
        zone_at = F.coalesce(*[F.when(_in_range(micros, edges, zone), zone) for zone in sorted(set(zone_of.values()))])
        near = df.select(zone_at.alias("__zone"), *order).filter("__zone IS NOT NULL").withColumn("__place", place)
        wanted = reduce(or_, [(F.col("__zone") == zone) & (F.col("__place") == at - starts[zone]) for at, zone in zone_of.items()])
        shown = [out.get(kinds[c], F.col)(c).alias(c) for c in order]
        for zone, k, *row in near.filter(wanted).select("__zone", "__place", *shown).collect():
            firsts[starts[zone] + k] = [back(c, v) for c, v in zip(order, row, strict=True)]
    split = F.lit(parts[-1][0])
    for (name, _), at in reversed(list(zip(parts, bounds, strict=False))):
        split = F.when(_before(order, firsts[at]) if at in firsts else F.lit(True), name).otherwise(split)
    return df.withColumn("split", split)


def _in_range(value: Column, edges: list, zone: int) -> Column:
    """Whether range_of gives value that number; it gives null the last one."""
    low = value >= edges[zone - 1] if zone else F.lit(True)
    return low & (value < edges[zone]) if zone < len(edges) else low | value.isNull()


def _before(order: list[str], row: list[Column]) -> Column:
    """Whether a row stands before the given one."""
    less = F.lit(False)
    for c, v in reversed(list(zip(order, row, strict=True))):
        less = (F.col(c) < v) | ((F.col(c) == v) & less)
    return less


def capped(df: DataFrame, rows: int, seed: int, key: list[str], order: list[str]) -> DataFrame:
    """The rows whose seeded hash (MD5 of seed and key) is least, in time order."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *key)), *key).limit(rows).orderBy(*order)


def rolling_window(df: DataFrame, days: int, end: datetime | None = None) -> tuple[DataFrame, int, int]:
    """Rows of the days up to end (the last time if not given), both ends included, and the rows before and after."""
    last = F.lit(end) if end is not None else F.lit(df.agg(F.max("time")).first()[0])
    inside = (F.col("time") >= F.timestamp_add("DAY", F.lit(-days), last)) & (F.col("time") <= last)
    before, after = df.agg(F.count("*"), F.count_if(inside)).first()
    return df.filter(inside), before, after


def holdout(df: DataFrame, days: int, day: str = "service_date") -> Column:
    """True on the last dates that have rows. The dates are few; rows are not counted."""
    dates = df.select(day).distinct().orderBy(F.desc(day)).limit(days)
    return F.col(day).isin([r[0] for r in dates.collect()])


def select_dates(df: DataFrame, most: int, selection: str, day: str = "service_date") -> DataFrame:
    """Rows of at most ``most`` of the dates: the first ones, the last ones, or ones spread over all."""
    dates = df.select(day).distinct()
    n = dates.count()
    if most <= 0 or n <= most:
        return df
    k = F.row_number().over(Window.orderBy(day)) - 1  # a row for each date
    if selection == "first":
        wanted = k < most
    elif selection == "last":
        wanted = k >= n - most
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (n - 1) / max(1, most - 1), 0).cast("int"))
        wanted = (k == n // 2) if most == 1 else F.array_contains(places, k)
    chosen = dates.withColumn("__wanted", wanted).filter("__wanted").select(day)
    return df.join(F.broadcast(chosen), day, "left_semi")


def observed_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of wanted that df has with any value, found in one pass."""
    there = [c for c in wanted if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    return [c for c in there if counts[c]]
