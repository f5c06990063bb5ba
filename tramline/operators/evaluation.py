"""Evaluation of scores and alerts: confusion, calibration, sweeps, ranking measures, grouped diagnostics.

Rows have ``risk``, a boolean ``actual`` (null if not labelled) and whatever alert column is named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.splits import edges_of, range_of

#: 91 thresholds, 0.05 to 0.95, and 11 edges of bins, as evenly spaced points are computed in floating point.
THRESHOLDS = tuple(0.05 + k * ((0.95 - 0.05) / 90) for k in range(90)) + (0.95,)
EDGES = tuple(k * (1.0 / 10) for k in range(10)) + (1.0,)


def confusion(alert: Column, actual: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates over labelled rows, or over cells of weight rows each; a ratio without cases is null."""
    n = F.count_if if weight is None else lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0))
    tp, fp = n(alert & actual), n(alert & ~actual)
    fn, tn = n(~alert & actual), n(~alert & ~actual)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall),
        "alert_rate": F.try_divide(tp + fp, tp + fp + fn + tn), "positive_rate": F.try_divide(tp + fn, tp + fp + fn + tn),
    }


def metrics(df: DataFrame, alert: Column, keys: list[str] | None = None) -> DataFrame:
    labelled = df.filter(F.col("actual").isNotNull())
    aggregates = [c.alias(k) for k, c in confusion(alert, F.col("actual")).items()]
    return labelled.groupBy(*keys).agg(*aggregates) if keys else labelled.agg(*aggregates)


def bin_of(risk: Column, bins: int) -> Column:
    """Number of the bin with k/n <= risk < (k+1)/n, the last one closed; null outside 0 to 1."""
    inside = [F.when((risk >= k / bins) & ((risk < (k + 1) / bins) if k < bins - 1 else (risk <= 1.0)), k) for k in range(bins)]
    return F.coalesce(*inside)


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Every bin, empty ones too: rows, mean risk, observed rate."""
    spark = df.sparkSession
    found = df.filter(F.col("actual").isNotNull()).groupBy(bin_of(F.col("risk"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.avg(F.col("actual").cast("double")).alias("rate"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lower"), ((F.col("id") + 1) / bins).alias("upper"))
    return F.broadcast(every).join(found, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean_risk", "rate")


def score_bands(df: DataFrame) -> DataFrame:
    """Bins that have rows: rows, mean risk, observed rate, and that rate over the rate of all."""
    labelled = df.filter(F.col("actual").isNotNull())
    base = labelled.agg(F.avg(F.col("actual").cast("double")).alias("base"))
    band = reduce(lambda c, k: F.when(F.col("risk") >= EDGES[k], k).otherwise(c), range(10), F.lit(None).cast("int"))
    found = labelled.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.avg(F.col("actual").cast("double")).alias("rate"))
    return found.crossJoin(F.broadcast(base)).select("band", "n", "mean_risk", "rate", F.try_divide("rate", "base").alias("lift"))


def policy_sweep(df: DataFrame, run: str, floors: list[float], caps: list[int], ties: str) -> DataFrame:
    """Confusion of each floor and cap, where a run's cap riskiest eligible rows are its alerts (0: all of them).

    Rows over a floor are the first of a run's raw alerts by risk, so one rank serves all floors and caps. Rows collapse
    to the cells that floors and caps tell apart before the grid is tried on them.
    """
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame([(f, c) for f in floors for c in caps], "floor double, cap int"))
    raw = F.coalesce(F.col("raw_alert"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(run, raw).orderBy(F.desc("risk"), ties))
    within = F.coalesce(F.least(*[F.when(place <= c, c) for c in sorted({*caps} - {0})], F.lit(None).cast("int")), F.lit(2**31 - 1)) if {*caps} - {0} else F.lit(2**31 - 1)
    over = F.greatest(F.lit(None).cast("double"), *[F.when(F.col("risk") >= f, F.lit(float(f))) for f in floors])
    labelled = df.filter(F.col("actual").isNotNull()).select("actual", raw.alias("raw"), over.alias("over"), within.alias("within"))
    cells = labelled.groupBy("actual", "raw", "over", "within").agg(F.count("*").alias("n"))
    alert = F.col("raw") & F.coalesce(F.col("over") >= F.col("floor"), F.lit(False)) & ((F.col("cap") == 0) | (F.col("within") <= F.col("cap")))
    return cells.crossJoin(grid).groupBy("floor", "cap").agg(*[c.alias(k) for k, c in confusion(alert, F.col("actual"), F.col("n")).items()])


def threshold_counts(df: DataFrame) -> DataFrame:
    """At each of the 91 thresholds: alerts, hits among them, and all positives; collapsed to the grid first."""
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame(list(enumerate(THRESHOLDS)), "k int, threshold double"))
    cell = F.size(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: t <= F.col("risk"))) - 1
    cells = df.filter(F.col("actual").isNotNull()).groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.count_if("actual").alias("hits"))
    total = cells.agg(F.sum("hits").alias("positives"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 91 rows
    sums = grid.join(cells, "k", "left").select("k", "threshold", F.sum(F.coalesce("n", F.lit(0))).over(down).alias("alerts"), F.sum(F.coalesce("hits", F.lit(0))).over(down).alias("tp"))
    return sums.crossJoin(F.broadcast(total))


def threshold_sweep(df: DataFrame) -> DataFrame:
    precision, recall = F.try_divide("tp", "alerts"), F.try_divide("tp", "positives")
    found = threshold_counts(df).withColumns({"precision": precision, "recall": recall})
    return found.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def best_threshold(sweep: DataFrame, target: float) -> DataFrame:
    """The threshold of the best F1 and the one of the highest recall with the target precision; the first on ties."""
    fit = F.coalesce(F.col("precision") >= target, F.lit(False))
    return sweep.agg(
        F.max_by("threshold", F.struct(F.round("f1", 12), -F.col("k"))).alias("best_f1_threshold"), F.max(F.round("f1", 12)).alias("best_f1"),
        F.max_by("threshold", F.when(fit, F.struct(F.round("recall", 12), -F.col("k")))).alias("precision_threshold"), F.max(F.when(fit, F.round("recall", 12))).alias("precision_recall"),
    )


def ranking(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ROC AUC (ties count half) and average precision (sum of recall steps by precision), per key; null for one class.

    Rows are first counted per score. Sums over the scores run inside ranges of scores, which follow the quantiles of the
    different scores, and add the totals of the ranges above.
    """
    keys = keys or []
    each = df.filter(F.col("actual").isNotNull()).groupBy(*keys, "risk").agg(F.count_if("actual").alias("p"), F.count_if(~F.col("actual")).alias("q"))
    zone = range_of(F.col("risk"), edges_of(each, F.col("risk")))
    zones = each.groupBy(*keys, zone.alias("zone")).agg(F.sum("p").alias("zp"), F.sum("q").alias("zq"))
    above = Window.partitionBy(*keys).orderBy(F.desc("zone")).rowsBetween(Window.unboundedPreceding, -1)
    tops = zones.select(*keys, "zone", F.coalesce(F.sum("zp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("zq").over(above), F.lit(0)).alias("fp0"))
    inner = Window.partitionBy(*keys, "zone").orderBy(F.desc("risk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.withColumn("zone", zone).withColumns({"tp1": F.sum("p").over(inner), "fp1": F.sum("q").over(inner)}).join(tops, [*keys, "zone"])
    tp, fp = F.col("tp0") + F.col("tp1"), F.col("fp0") + F.col("fp1")
    area, steps = F.sum(F.col("q") * (tp - F.col("p") / F.lit(2.0))), F.sum(F.col("p") * tp / (tp + fp))
    return run.groupBy(*keys).agg(
        F.when(F.sum("p") * F.sum("q") > 0, area / (F.sum("p") * F.sum("q"))).alias("auc"),
        F.when(F.sum("p") * F.sum("q") > 0, steps / F.sum("p")).alias("average_precision"),
    )


def top_fractions(df: DataFrame, fractions: tuple[float, ...], ties: str) -> DataFrame:
    """The riskiest max(1, round(n f)) rows for each f: least risk, precision, recall, lift.

    Rows are counted per range of scores, which follow the scores' quantiles, and only the ranges that the largest n
    reaches are ordered: a row's place is its place in its range plus the rows of the ranges above. Rows with one score
    are in one range.
    """
    spark = df.sparkSession
    score = F.coalesce("risk", F.lit(-1.0))
    labelled = df.filter(F.col("actual").isNotNull())
    labelled = labelled.withColumn("__zone", range_of(score, edges_of(labelled, score)))
    counts = labelled.groupBy("__zone").agg(F.count("*").alias("n"), F.count_if("actual").alias("hits")).collect()  # a row for each range
    total, positives = sum(r["n"] for r in counts), sum(r["hits"] for r in counts)
    sizes = [(f, max(1, round(total * f))) for f in fractions]
    above, starts = 0, []
    for r in sorted(counts, key=lambda r: -r["__zone"]):
        starts.append((r["__zone"], above))
        above += r["n"]
    largest = max(n for _, n in sizes)
    needed = F.broadcast(spark.createDataFrame([x for x in starts if x[1] < largest], "__zone int, __above long"))
    inside = Window.partitionBy("__zone").orderBy(F.desc("risk"), ties)
    ranked = labelled.join(needed, "__zone").withColumn("place", F.col("__above") + F.row_number().over(inside))
    grid = F.broadcast(spark.createDataFrame(sizes, "fraction double, n long"))
    hits = F.count_if("actual")
    return ranked.crossJoin(grid).filter(F.col("place") <= F.col("n")).groupBy("fraction", "n").agg(
        F.min("risk").alias("least_risk"), (hits / F.count("*")).alias("precision"), (hits / F.lit(max(1, positives))).alias("recall"), (hits / F.count("*") / F.lit(positives / max(1, total))).alias("lift"),
    )


def error_measures(predicted: Column, actual: Column) -> dict[str, Column]:
    return {"mae": F.avg(F.abs(predicted - actual)), "rmse": F.sqrt(F.avg((predicted - actual) * (predicted - actual)))}
