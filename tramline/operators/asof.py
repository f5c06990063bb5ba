"""As-of and nearest-time joins as one union and one window: a single shuffle by key, no range join.

Both sides are put into one frame and ordered by key time; the match of a probe row is the last build row seen before
it. The frame grows with the order (never from the current row to the end), so a key's rows are passed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.timeutil import epoch_seconds

_PROBE, _BUILD = 1, 2


def _union(left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: Column, payload: list[str]) -> DataFrame:
    right_row = F.struct(right_key.alias("__at"), *[F.col(c) for c in payload])
    probe_type = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in left.schema) + ">"
    build = right.select(*by, right_key.alias("__key"), F.lit(_BUILD).alias("__side"), F.lit(None).cast(probe_type).alias("__left"), right_row.alias("__right"))
    build_type = build.schema["__right"].dataType
    probe = left.select(*by, left_key.alias("__key"), F.lit(_PROBE).alias("__side"), F.struct("*").alias("__left"), F.lit(None).cast(build_type).alias("__right"))
    return probe.unionByName(build)


def _forward(by: list[str]) -> Column:
    order = Window.partitionBy(*by).orderBy(F.desc("__key"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("__right", ignorenulls=True).over(order)


def _backward(by: list[str]) -> Column:
    order = Window.partitionBy(*by).orderBy(F.asc("__key"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("__right", ignorenulls=True).over(order)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: Column, payload: list[str], tolerance: int | None = None, how: str = "left") -> DataFrame:
    """Each row of left with the first row of right at or after its key: left's columns and ``match``.

    match holds __at (right's key) and payload; it is null without a match, or one over tolerance seconds away.
    """
    found = _union(left, right, by, left_key, right_key, payload).withColumn("match", _forward(by)).filter(F.col("__side") == _PROBE)
    match = F.col("match")
    if tolerance is not None:
        match = F.when(epoch_seconds(F.col("match.__at")) - epoch_seconds(F.col("__key")) <= tolerance, match)
    out = found.withColumn("match", match).select("__left.*", "match")
    return out.filter(F.col("match").isNotNull()) if how == "inner" else out


def asof_forward_self(df: DataFrame, by: list[str], probe_key: Column, build_key: Column, payload: list[str], tolerance: int | None = None, how: str = "left") -> DataFrame:
    """asof_forward of a frame with itself: every row is doubled into a probe and a build row where it is.

    The frame is made once, and if it is already partitioned by key, as after a window, nothing is shuffled.
    """
    sides = F.array(F.struct(F.lit(_PROBE).alias("s"), probe_key.alias("k")), F.struct(F.lit(_BUILD).alias("s"), build_key.alias("k")))
    each = df.select(*by, F.struct("*").alias("__row"), F.struct(build_key.alias("__at"), *[F.col(c) for c in payload]).alias("__own"), F.explode(sides).alias("__x"))
    doubled = each.select(
        *by, F.col("__x.k").alias("__key"), F.col("__x.s").alias("__side"),
        F.when(F.col("__x.s") == _PROBE, F.col("__row")).alias("__left"), F.when(F.col("__x.s") == _BUILD, F.col("__own")).alias("__right"),
    )
    found = doubled.withColumn("match", _forward(by)).filter(F.col("__side") == _PROBE)
    match = F.col("match")
    if tolerance is not None:
        match = F.when(epoch_seconds(F.col("match.__at")) - epoch_seconds(F.col("__key")) <= tolerance, match)
    out = found.withColumn("match", match).select("__left.*", "match")
    return out.filter(F.col("match").isNotNull()) if how == "inner" else out


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: Column, payload: list[str]) -> DataFrame:
    """Each row of left with the last row of right at or before its key: left's columns and ``match``."""
    found = _union(left, right, by, left_key, right_key, payload).withColumn("match", _backward(by)).filter(F.col("__side") == _PROBE)
    return found.select("__left.*", "match")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: Column, payload: list[str], tolerance: int) -> DataFrame:
    """Each row of left with the row of right whose key is nearest, within tolerance seconds; the earlier one on ties."""
    both = _union(left, right, by, left_key, right_key, payload).withColumn("__after", _forward(by)).withColumn("__before", _backward(by))
    found = both.filter(F.col("__side") == _PROBE)
    ahead = F.unix_micros(F.col("__after.__at").cast("timestamp")) - F.unix_micros(F.col("__key").cast("timestamp"))
    behind = F.unix_micros(F.col("__key").cast("timestamp")) - F.unix_micros(F.col("__before.__at").cast("timestamp"))
    limit = tolerance * 1_000_000
    pick = F.when((behind <= limit) & (ahead.isNull() | (behind <= ahead)), F.col("__before")).when(ahead <= limit, F.col("__after"))
    return found.withColumn("match", pick).select("__left.*", "match")
