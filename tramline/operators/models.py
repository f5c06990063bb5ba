"""Training, scoring and backtests of delay models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import evaluation as E
from tramline.operators.alerts import cooldown

NUMERIC = ["delay", "speed", "delay_delta_1", "speed_delta_1", "delay_mean_3", "stop_sequence_gap", "hour_of_day", "day_of_week"]
CATEGORIES = ["mode", "line", "route_id"]
#: Different values of a category that are told apart.
MOST_VALUES = 254


def prepared(df: DataFrame, numeric: list[str] = NUMERIC, categories: list[str] = CATEGORIES) -> DataFrame:
    """Numbers as double (text that is none is null), categories as text (without any: null), columns that are missing as null."""
    there = set(df.columns)
    value = lambda c, t: F.col(c).try_cast(t) if c in there else F.lit(None).cast(t)
    return df.withColumns({c: value(c, "double") for c in numeric} | {c: F.nullif(value(c, "string"), F.lit("")) for c in categories})


def with_common_values(df: DataFrame, categories: list[str], most: int = MOST_VALUES) -> DataFrame:
    """Rare values of categories as unknown; null stays. The common ones, most for each, are read once, so that no later pass counts them again."""
    found = {c: df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(most).collect() for c in categories}
    return df.withColumns({c: F.when(F.col(c).isin([r[0] for r in rows]), F.col(c)).when(F.col(c).isNotNull(), "unknown") for c, rows in found.items()})


def most_frequent(df: DataFrame, categories: list[str]) -> dict[str, str]:
    """The value that most rows have, of several the least, for each category; ``unknown`` where no row has one."""
    return _usual(df.agg(*[F.mode(c, True).alias(c) for c in categories]).first(), categories)


def _usual(row: Row, categories: list[str]) -> dict[str, str]:
    return {c: row[c] or "unknown" for c in categories}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preparation(ready: DataFrame, numeric: list[str], categories: list[str], linear: bool = False, usual: dict[str, str] | None = None) -> PipelineModel:
    """Fitted stages: median for missing numbers, most frequent value for missing categories, then a code for each value.

    Codes count the values in their order; a value that the rows don't have has the code -1. Linear models get one-hot
    codes, without any for such a value, and numbers of unit variance. usual are the most frequent values, where they are known.
    """
    filled, codes = [f"{c}_filled" for c in numeric], [f"{c}_code" for c in categories]
    usual = usual or most_frequent(ready, categories)
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(`{c}`, {_quoted(v)}) AS `{c}_known`" for c, v in usual.items()) + " FROM __THIS__")
    index = StringIndexer(inputCols=[f"{c}_known" for c in categories], outputCols=[f"{c}_place" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc")
    first = Pipeline(stages=[Imputer(strategy="median", inputCols=numeric, outputCols=filled), fill, index]).fit(ready)
    sizes = [len(values) for values in first.stages[-1].labelsArray]
    code = SQLTransformer(statement="SELECT *, " + ", ".join(f"CASE WHEN `{c}_place` < {n} THEN `{c}_place` ELSE -1.0D END AS `{c}_code`" for c, n in zip(categories, sizes, strict=True)) + " FROM __THIS__")
    if not linear:
        return PipelineModel([*first.stages, code, VectorAssembler(inputCols=filled + codes, outputCol="features")])
    hot = [f"{c}_hot" for c in categories]
    rest = [
        OneHotEncoder(inputCols=[f"{c}_place" for c in categories], outputCols=hot, handleInvalid="keep"), VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True), VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ]
    return PipelineModel([*first.stages, code, *Pipeline(stages=rest).fit(code.transform(first.transform(ready))).stages])


def _ready(df: DataFrame, linear: bool) -> DataFrame:
    """Prepared rows; linear models, which have a coefficient for each value, tell the common ones apart only."""
    return with_common_values(prepared(df), CATEGORIES) if linear else prepared(df)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with ``weight``: both classes weigh the same."""
    return _weighed(df, *df.agg(F.count("*"), _positives(label)).first(), label)


def _positives(label: str) -> Column:
    return F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))


def _weighed(df: DataFrame, n: int, positives: int, label: str = "label") -> DataFrame:
    weight = F.when(F.col(label) == 1, n / (2.0 * max(1, positives))).otherwise(n / (2.0 * max(1, n - positives)))
    return df.withColumn("weight", weight)


def train_classifier(df: DataFrame, linear: bool = False, iterations: int = 200, depth: int = 6, bins: int = 255) -> PipelineModel:
    """Boosted trees, or logistic regression, on a 0/1 ``label``."""
    model = LogisticRegression(weightCol="weight", maxIter=30, regParam=0.001) if linear else GBTClassifier(weightCol="weight", stepSize=0.05, maxDepth=depth, maxIter=iterations, maxBins=max(bins, 32), seed=42)
    return _fitted(_ready(df, linear), linear, model, "label", weigh=True)


def _fitted(ready: DataFrame, linear: bool, model: Estimator, label: str, weigh: bool = False) -> PipelineModel:
    """All stages fit on prepared rows; numbers that no row has are left out.

    One pass counts all that the stages and weights need. Trees pass over their rows several times before they keep them
    in their own form, so that the rows are assembled once and kept until the fit ends; linear models keep theirs at once.
    """
    numbers = {c: F.count(c).alias(f"n_{c}") for c in NUMERIC}
    seen = ready.agg(F.count("*").alias("n"), (_positives(label) if weigh else F.lit(0)).alias("positives"), *numbers.values(), *[F.mode(c, True).alias(c) for c in CATEGORIES]).first()
    first = preparation(ready, [c for c in NUMERIC if seen[f"n_{c}"]], CATEGORIES, linear, _usual(seen, CATEGORIES))
    rows = first.transform(_weighed(ready, seen["n"], seen["positives"], label) if weigh else ready).select("features", label, *(["weight"] if weigh else []))
    if linear:
        return PipelineModel([*first.stages, model.fit(rows)])
    rows = rows.persist()
    try:
        rows.count()  # by all tasks: the fit begins with a look at one row, for which one task would make its whole part
        return PipelineModel([*first.stages, model.fit(rows)])
    finally:
        rows.unpersist()


def train_regressor(df: DataFrame, target: str, linear: bool = False, iterations: int = 100) -> PipelineModel:
    """A delay, or the change of it, from features."""
    model = LinearRegression(labelCol=target, elasticNetParam=0.0, regParam=1.0) if linear else GBTRegressor(labelCol=target, stepSize=0.05, maxDepth=6, maxIter=iterations, maxBins=255, seed=42)
    return _fitted(_ready(df, linear), linear, model, target)


def scored(df: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """df with ``risk`` and ``alert``; features that are missing are null, and nothing else of df changes."""
    out = model.transform(prepared(df))
    return out.withColumn("risk", vector_to_array("probability")[1]).withColumn("alert", F.col("risk") >= threshold).select(*df.columns, "risk", "alert")


ABOUT = "precision_threshold double, best_f1_threshold double, features array<string>"


def save_model(model: PipelineModel, path: str, precision_threshold: float | None, best_f1_threshold: float | None, spark: SparkSession) -> None:
    """The model and, beside it, a table of one row that says where its alerts begin."""
    model.write().overwrite().save(f"{path}/model")
    row = [(precision_threshold, best_f1_threshold, [*NUMERIC, *CATEGORIES])]
    spark.createDataFrame(row, ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), spark.read.schema(ABOUT).parquet(f"{path}/about").first().asDict()


def threshold_of(about: dict, given: float | None = None) -> float:
    """The threshold that is given, else the stored one for the wanted precision, else one half."""
    return next(float(x) for x in (given, about.get("precision_threshold"), 0.5) if x is not None)


def area_under_roc(df: DataFrame, model: PipelineModel) -> float:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(model.transform(prepared(df)))


def side_by_side(spark: SparkSession, f: Callable, items: list, at_once: int = 4) -> list:
    """f of every item, in order; the jobs of at_once items run at a time, since a small tree's jobs leave most cores idle."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(f), items))


Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def rates(keys: list[str], lean: float) -> Fit:
    """A model that gives a row the share of ``actual`` among the training rows with its keys, leaning on the share of all as on lean rows more."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        base = train.agg(F.avg(F.col("actual").cast("double"))).first()[0] or 0.0
        table = train.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if("actual").alias("__k"))
        risk = (F.coalesce("__k", F.lit(0)) + lean * base) / (F.coalesce("__n", F.lit(0)) + lean)
        return lambda df: df.join(table, keys, "left").withColumn("risk", F.round(risk, 9)).drop("__n", "__k")

    return fit


def classifier(linear: bool = True, iterations: int = 200, bins: int = 127) -> Fit:
    """Logistic regression or boosted trees on feature rows."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = train_classifier(train.withColumn("label", F.col("actual").cast("int")), linear, iterations, bins=bins)
        return lambda df: scored(df, model).drop("alert")

    return fit


def backtest(
    rows: DataFrame, windows: list[int], start: datetime, fit: Fit, alert_risk: float, time: str = "position_time", minutes: float = 30,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df, at_once: int = 4,
) -> DataFrame:
    """For each window of days before start a model is fit on its rows alone and measured on all rows from start on.

    Measures: rows it was fit on; precision and recall at alert_risk; precision of the riskiest hundredth; average
    precision; alerts, and those that a cooldown leaves. Models of at_once windows are fit at a time, as jobs side by
    side; keep may store a window's scored rows, which are read several times.
    """
    test, out = rows.filter(F.col(time) >= F.lit(start)), None

    def train_of(days: int) -> DataFrame:
        return rows.filter((F.col(time) >= F.lit(start - timedelta(days=days))) & (F.col(time) < F.lit(start)))

    results = side_by_side(rows.sparkSession, lambda days: keep(fit(train_of(days))(test)), windows, at_once)
    for days, found in zip(windows, results, strict=True):
        at = E.metrics(found, F.col("risk") >= alert_risk).select("precision", "recall", (F.col("tp") + F.col("fp")).alias("alerts"))
        top = E.top_fractions(found, (0.01,), "event_id").select(F.col("precision").alias("top_precision"))
        events = cooldown(found.filter(F.col("risk") >= alert_risk).select("vehicle_id", time, "event_id"), minutes, time).agg(F.count("*").alias("event_alerts"))
        ranked = E.ranking(found).select("average_precision")
        one = train_of(days).agg(F.count("*").alias("train_rows")).select(F.lit(days).alias("days"), "train_rows")  # every part has one row
        for part in (at.select("precision", "recall"), top, ranked, at.select("alerts"), events):
            one = one.crossJoin(F.broadcast(part))
        out = one if out is None else out.unionByName(one)
    return out


def choose_window(measures: DataFrame, least_rows: int, target: float) -> DataFrame:
    """The shortest window whose score is within 2 % of the best, of those that meet the precision target if any does."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.4 * part("precision") + 0.2 * part("recall") + 0.2 * part("top_precision") + 0.2 * part("average_precision") - F.when(F.coalesce("event_alerts", F.lit(0)) == 0, 0.2).otherwise(0.0)
    all_rows = Window.partitionBy()  # a row for each window tried
    found = measures.filter(F.col("train_rows") >= least_rows).withColumns({"score": score, "meets": F.coalesce(F.col("precision") >= target, F.lit(False))})
    found = found.withColumn("any_meets", F.max("meets").over(all_rows)).filter(F.col("meets") | ~F.col("any_meets"))
    best = F.max("score").over(all_rows)
    return found.withColumn("near", F.col("score") >= best - 0.02 * F.abs(best)).filter("near").orderBy("days").limit(1)
