"""Streams over the events, drained to the end, and models trained on features."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.geo import within
from tramline.functions.timeutil import MONDAY
from tramline.operators import alerts as A
from tramline.operators import evaluation as E
from tramline.operators import models as M
from tramline.operators import sampling as S
from tramline.operators import splits as X
from tramline.plans.base import query, scratch, written
from tramline.plans.features import BUCKET, IN, features_of, inside, samples  # noqa: F401 (inside: for tests)
from tramline.plans.lake import messages_of
from tramline.plans.trajectories import ARR, BOX, HAV, INTER, LONGEST, MAX_GAP, MAX_SPEED, SHORTEST, STEP, arrivals
from tramline.sources.fixtures import POS, positions
from tramline.streaming import vehicles as V


#: Boosting rounds of the queries, fewer than the operators' own 200 and 100, whose time no check of a thousand rows is worth.
ITERATIONS = 20


def fed(df: DataFrame, slices: int, by: str, run: Callable[[DataFrame], None]) -> None:
    """A stream over a folder that df lands in, slice after slice of a column's range; run takes it to the end after each.

    A slice is many files, written and read by all tasks. What a run leaves in its checkpoint, the next one goes on from.
    """
    spark = df.sparkSession
    out = scratch(spark, "landed")
    value = F.unix_micros(F.col(by).cast("timestamp")) if dict(df.dtypes)[by].startswith("timestamp") else F.col(by)
    least, most = df.agg(F.min(value), F.max(value)).first()
    part = F.least(F.lit(slices - 1), F.floor((value - least) * slices / max(1, most - least)))
    for k in range(slices):
        df.filter(part == k).write.mode("append").parquet(out)
        run(spark.readStream.schema(df.schema).parquet(out))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with their place in the order of arrival."""
    return arrivals(spark, sf_dir).select("vehicle_id", F.unix_micros(F.col("time").cast("timestamp")).alias("us"), "lat", "lon", F.col("arrival_seq").cast("long").alias("arrival_seq"))


@query(POS + "SELECT vehicle_id, count(*) AS rows, sum(CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 7 ELSE delay END)::BIGINT AS delays FROM pos WHERE event_id % 10 NOT IN (1, 2, 3) GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = scratch(spark, "messages"), scratch(spark, "ingested")
    messages_of(spark, sf_dir).repartition(3).select("value").write.text(source)
    V.run_to_end(V.ingest(spark, source), out, f"{out}-progress")
    return spark.read.parquet(out).groupBy("vehicle_id").agg(F.count("*").alias("rows"), F.sum("delay").alias("delays"))


@query(POS + "SELECT t.kind, vehicle_id, count(*) AS rows, round(sum(lat), 6) AS lats FROM pos, (VALUES ('positions'), ('trajectory')) t(kind) WHERE event_id % 10 NOT IN (1, 2, 3) AND (kind = 'positions' OR lat BETWEEN 49.9 AND 50.2) GROUP BY ALL")
def stream_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every micro-batch of messages goes to the table of positions and, inside the bounds, to that of trajectory points."""
    source, out = scratch(spark, "messages"), scratch(spark, "tables")
    messages_of(spark, sf_dir).repartition(3).select("value").write.text(source)
    inside = lambda df: df.filter(F.col("lat").between(49.9, 50.2)).select("vehicle_id", "observation_ts", "lat", "lon", F.lit("observed").alias("point_state"))
    V.store_batches(V.ingest(spark, source), {"positions": lambda df: df, "trajectory": inside}, out, f"{out}-progress")
    found = None
    for kind in ("positions", "trajectory"):
        one = spark.read.parquet(f"{out}/{kind}").groupBy("vehicle_id").agg(F.count("*").alias("rows"), F.round(F.sum("lat"), 6).alias("lats")).withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found


@query(INTER + "SELECT vehicle_id, point_state, gap_reason, count(*) AS points, round(sum(lat), 5) AS lats, round(sum(lon), 5) AS lons FROM traj GROUP BY ALL")
def stream_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In micro-batches of arrival; later ones go on from the state that earlier ones left."""
    V.keep_state_in_rocksdb(spark)
    out = scratch(spark, "trajectory")
    fed(points_of(spark, sf_dir), 2, "arrival_seq", lambda stream: V.run_to_end(V.trajectory_stream(stream, V.Segments(MAX_GAP, MAX_SPEED, STEP, SHORTEST, LONGEST)), out, f"{out}-progress"))
    found = spark.read.schema(V.Segments.OUTPUT).parquet(out)
    return found.groupBy("vehicle_id", "point_state", "gap_reason").agg(F.count("*").alias("points"), F.round(F.sum("lat"), 5).alias("lats"), F.round(F.sum("lon"), 5).alias("lons"))


_MOVED = HAV.format(r=6371000, a="f.", b="q.")
TRAILS = ARR.replace("WITH pos", "WITH RECURSIVE pos") + f""", q AS (SELECT vehicle_id, lat, lon, epoch_us(time) // 1000 AS ms, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival_seq) AS n FROM arr WHERE {BOX}),
fold AS (SELECT vehicle_id, n, lat, lon, ms, 1 AS points FROM q WHERE n = 1 UNION ALL
  SELECT vehicle_id, n, CASE WHEN stays THEN flat ELSE lat END, CASE WHEN stays THEN flon ELSE lon END, CASE WHEN stays THEN fms ELSE due END, CASE WHEN jumps THEN 1 WHEN stays THEN points ELSE least(30, points + 1) END
  FROM (SELECT *, moved > 1500 OR moved / ((due - fms) / 1000) > 40 AS jumps, moved < 1 AND NOT jumps AS stays
    FROM (SELECT q.vehicle_id, q.n, q.lat, q.lon, f.lat AS flat, f.lon AS flon, f.ms AS fms, greatest(q.ms, f.ms + 1) AS due, f.points, {_MOVED} AS moved FROM fold f JOIN q ON q.vehicle_id = f.vehicle_id AND q.n = f.n + 1)))
SELECT vehicle_id, points::INTEGER AS points, lon AS last_lon, lat AS last_lat, ms AS last_ms FROM fold QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC) = 1"""


@query(TRAILS)
def live_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.trails(points_of(spark, sf_dir))


@query(TRAILS)
def stream_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    V.keep_state_in_rocksdb(spark)
    out = scratch(spark, "trails")
    fed(points_of(spark, sf_dir), 2, "arrival_seq", lambda stream: V.score_batches(V.trail_stream(stream, V.Trails(None)), lambda df: df, out, f"{out}-progress"))
    found = spark.read.schema(V.Trails.OUTPUT + ", batch long").parquet(out)
    return found.groupBy("vehicle_id").agg(F.max_by(F.struct("points", "last_lon", "last_lat", "last_ms"), "batch").alias("t")).select("vehicle_id", "t.*")


@query(POS + """, b AS (SELECT vehicle_id, time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '1970-01-01') AS bucket, time, delay FROM pos)
SELECT vehicle_id, count(*) AS buckets, sum(delay)::BIGINT AS delays FROM (SELECT * FROM b WHERE bucket + INTERVAL 6 HOUR <= (SELECT max(time) - INTERVAL 1 DAY FROM pos) QUALIFY row_number() OVER (PARTITION BY vehicle_id, bucket ORDER BY time DESC) = 1) GROUP BY 1""")
def stream_bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that the watermark has closed."""
    out = scratch(spark, "buckets")
    p = positions(spark, sf_dir).select("vehicle_id", F.col("time").cast("timestamp").alias("time"), "delay")
    fed(p, 2, "time", lambda stream: V.run_to_end(V.bucket_samples(stream, "6 hours", "1 day", ["delay"]), out, f"{out}-progress"))
    return spark.read.parquet(out).groupBy("vehicle_id").agg(F.count("*").alias("buckets"), F.sum("delay").alias("delays"))


@query(POS + """, g AS (SELECT vehicle_id, time, CASE WHEN time < lag(time) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM pos WINDOW w AS (PARTITION BY vehicle_id ORDER BY time)),
n AS (SELECT *, sum(new) OVER (PARTITION BY vehicle_id ORDER BY time) AS life FROM g), l AS (SELECT vehicle_id, life, count(*) AS points, min(time) AS first_time, max(time) AS last_time FROM n GROUP BY ALL)
SELECT vehicle_id, first_time, last_time, points FROM l WHERE last_time + INTERVAL 12 HOUR <= (SELECT max(time) - INTERVAL 1 DAY FROM pos)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that fell silent for longer than their time to live, given out by timers; one that comes back lives anew."""
    V.keep_state_in_rocksdb(spark)
    out = scratch(spark, "expired")
    p = positions(spark, sf_dir).select("vehicle_id", F.col("time").cast("timestamp").alias("time"), "lat", "lon")
    fed(p, 2, "time", lambda stream: V.run_to_end(V.expired(stream, 12 * 3_600_000, "1 day"), out, f"{out}-progress"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return spark.read.schema(V.Lives.OUTPUT).parquet(out).select("vehicle_id", time("first_us").alias("first_time"), time("last_us").alias("last_time"), "points")


#: What models and their measures read of a feature row.
MODEL_COLUMNS = ["vehicle_id", "time", *M.NUMERIC, *M.CATEGORIES, "target_delay", "target_delay_delta"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a label, split by time, written once: models pass over them many times."""
    out = scratch(spark, "labelled")
    f = features_of(samples(spark, sf_dir), columns=MODEL_COLUMNS).dropna(subset=["target_delay", "delay"]).withColumn("label", (F.col("target_delay_delta") >= 60).cast("int"))
    f.write.parquet(f"{out}/rows")
    return X.split_ordered(spark.read.parquet(f"{out}/rows"), ["time", "vehicle_id"])


def _quality(df: DataFrame, name: str) -> DataFrame:
    rows = df if "actual" in df.columns else df.withColumn("actual", F.col("label") == 1)
    return E.ranking(written(rows.select("risk", "actual"), "scored")).select(F.lit(name).alias("model"), F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query()
def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test measures of boosted trees and of logistic regression."""
    rows = labelled(spark, sf_dir)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    trees = M.train_classifier(train, iterations=ITERATIONS)
    line = M.train_classifier(train, linear=True)
    return _quality(M.scored(test, trees), "boosted trees").unionByName(_quality(M.scored(test, line), "logistic"))


@query()
def train_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test errors of the delay to come: as it is, by ridge, and by boosted trees on its change."""
    rows = labelled(spark, sf_dir).withColumns({"target": F.col("target_delay").cast("double"), "change": F.col("target_delay_delta").cast("double")})
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    ridge, trees = M.train_regressor(train, "target", linear=True), M.train_regressor(train, "change", iterations=ITERATIONS)
    guesses = {
        "persistence": test.withColumn("guess", F.col("delay").cast("double")),
        "ridge": ridge.transform(M.prepared(test)).withColumn("guess", F.col("prediction")),
        "boosted trees": trees.transform(M.prepared(test)).withColumn("guess", F.col("prediction") + F.col("delay")),
    }
    out = None
    for name, df in guesses.items():
        one = df.agg(*[F.round(c, 6).alias(k) for k, c in E.error_measures(F.col("guess"), F.col("target")).items()]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of boosted trees on validation and test rows for growing numbers of training rows, with the threshold that the validation rows ask for."""
    rows = labelled(spark, sf_dir).withColumn("actual", F.col("label") == 1)
    train = rows.filter("split = 'train'").drop("split")
    n, out = train.count(), None
    sizes = [max(2, int(n * share)) for share in (0.25, 0.5, 1.0)]

    def measured(size: int) -> DataFrame:
        kept = scratch(spark, "curve")
        model = M.train_classifier(written(X.spread_indices(train, ["time", "vehicle_id"], size), "sample"), iterations=ITERATIONS)
        M.scored(rows.filter("split <> 'train'"), model).select("vehicle_id", "time", "risk", "actual", "split").write.parquet(kept)
        return spark.read.parquet(kept)

    for size, both in zip(sizes, M.side_by_side(spark, measured, sizes), strict=True):
        best = E.best_threshold(E.threshold_sweep(both.filter("split = 'validation'")), 0.4).first()
        threshold = best["precision_threshold"] or best["best_f1_threshold"]
        for split in ("validation", "test"):
            found = both.filter(F.col("split") == split)
            at = E.metrics(found, F.col("risk") >= threshold).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
            top = E.top_fractions(found.withColumn("event_id", F.xxhash64("vehicle_id", "time")), (0.01,), "event_id").select(F.round("precision", 6).alias("top_precision"))
            one = _quality(found, "boosted trees").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(at)).withColumns({"rows": F.lit(size), "split": F.lit(split), "threshold": F.lit(threshold).cast("double")})
            out = one if out is None else out.unionByName(one)
    return out


#: Training windows in days, and days of test rows, of the backtest of trees; the precision that it asks for.
TREE_WINDOWS, TREE_TEST_DAYS, TREE_PRECISION = (8, 16, 24), 5, 0.3


@query()
def window_backtest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of each training window, measured on later rows with the alerts that a cooldown leaves; ``chosen`` is the window to take.

    The windows are nested: all filter one prepared table of features, which is written once.
    """
    rows = labelled(spark, sf_dir).withColumns({"actual": F.col("label") == 1, "event_id": F.xxhash64("vehicle_id", "time")})
    start = rows.agg(F.max("time")).first()[0] - timedelta(days=TREE_TEST_DAYS)
    keep = lambda found: written(found.select("event_id", "vehicle_id", "time", "risk", "actual"), "window")
    measured = scratch(spark, "windows")
    M.backtest(rows, list(TREE_WINDOWS), start, M.classifier(linear=False, iterations=ITERATIONS), 0.5, "time", 15, keep).write.parquet(measured)
    found = spark.read.parquet(measured)
    chosen = M.choose_window(found, 100, TREE_PRECISION).select("days", F.lit(True).alias("chosen"))
    shown = {c: F.round(c, 6) for c in ("precision", "recall", "top_precision", "average_precision")}
    return found.withColumns(shown).join(F.broadcast(chosen), "days", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query()
def stored_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is fit, its threshold chosen on validation rows, both stored and read back; the stored ones score the test rows.

    ``same`` says whether the model scored the row alike before it was stored.
    """
    place, model, rows = stored_model(spark, sf_dir)
    again, about = M.load_model(spark, place)
    test, threshold = rows.filter("split = 'test'"), M.threshold_of(about)
    before = M.scored(test, model).select("vehicle_id", "time", F.col("risk").alias("before"))
    after = M.scored(test, again, threshold).select("vehicle_id", "time", "risk", "alert")
    return after.join(before, ["vehicle_id", "time"]).select("vehicle_id", "time", F.round("risk", 6).alias("risk"), "alert", (F.col("risk") == F.col("before")).alias("same"), F.lit(threshold).alias("threshold"))


@query()
def online_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of rows as they come in: numbers as text or none, categories without a value, a feature that isn't there; the riskiest first."""
    rows = labelled(spark, sf_dir)
    model = M.train_classifier(rows.filter("split = 'train'"), linear=True)
    every = F.xxhash64("vehicle_id", "time") % 5 == 0
    raw = rows.filter("split = 'test'").select("vehicle_id", "time", F.when(every, "n/a").otherwise(F.col("delay").cast("string")).alias("delay"), F.when(~every, F.col("mode")).alias("mode"), "line", "route_id", "speed", "delay_delta_1", "hour_of_day", "day_of_week")
    return M.scored(raw, model).select("vehicle_id", "time", F.round("risk", 6).alias("risk"), "alert").orderBy(F.desc("risk"), "vehicle_id", "time")


#: What a scoring run sees: seconds of context, of age, rows at most; and its policy.
CONTEXT, FRESH, MOST_ROWS, RISK, LOWEST, MOST_ALERTS = 5 * 86_400, 86_400, 60, 0.6, 0.65, 5
#: Columns of the context that scoring reads.
SCORED = ["time", "delay", "speed", *M.CATEGORIES]
_RUN = """runs AS (SELECT 1 AS run, max(time) AS now FROM pos WHERE (epoch_us(time) - (SELECT min(epoch_us(time)) FROM pos)) * 2 < (SELECT max(epoch_us(time)) - min(epoch_us(time)) FROM pos) UNION ALL SELECT 2, max(time) FROM pos)"""


@query(IN + f""", {_RUN}, rs AS (SELECT run, now, vehicle_id, time_bucket(INTERVAL 6 HOUR, time) AS bucket, arg_max(time, time) AS time, arg_max(delay, time) AS delay FROM inb, runs WHERE time > now - INTERVAL {CONTEXT} SECOND AND time <= now GROUP BY ALL),
rl AS (SELECT *, delay - lag(delay) OVER (PARTITION BY run, vehicle_id ORDER BY time) AS delta, row_number() OVER (PARTITION BY run, vehicle_id ORDER BY time DESC) AS nth FROM rs),
rf AS (SELECT *, 1 / (1 + exp(-coalesce(delta, 0) / 60.0::DOUBLE)) AS risk FROM rl WHERE nth = 1 AND time >= now - INTERVAL {FRESH} SECOND QUALIFY row_number() OVER (PARTITION BY run ORDER BY time DESC, vehicle_id) <= {MOST_ROWS}),
rp AS (SELECT *, row_number() OVER (PARTITION BY run, risk >= {RISK} AND risk >= {LOWEST} ORDER BY risk DESC, vehicle_id) AS rk FROM rf)
SELECT now AS scored_at, vehicle_id, round(risk, 9) AS risk, CASE WHEN risk < {RISK} THEN 'below_threshold' WHEN risk < {LOWEST} THEN 'below_min_risk' WHEN rk <= {MOST_ALERTS} THEN 'selected' ELSE 'suppressed_by_cap' END AS reason FROM rp""")
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After every micro-batch: features over the context that all batches left, each vehicle's latest if fresh, scored, held to the policy, stored.

    The scorer here is a stand-in, a logistic curve of the change in delay, so that SQL can follow; stream_model_scores has a trained one.
    """
    return scoring_stream(spark, sf_dir, lambda rows: rows.withColumn("risk", 1 / (1 + F.exp(-F.coalesce("delay_delta_1", F.lit(0)) / 60.0))), RISK)


def scoring_run(context: DataFrame, now: datetime, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """What one run says at now of the rows seen so far."""
    features = lambda rows: S.with_deltas(S.with_lags(S.sample_last_non_null(rows, SCORED, BUCKET, MONDAY)))
    rows = V.scoring_rows(context, now, CONTEXT, features, FRESH, MOST_ROWS)
    return A.apply_policy(score(rows).withColumn("scored_at", F.lit(now)), "scored_at", threshold, max(threshold, LOWEST), MOST_ALERTS).select("scored_at", "vehicle_id", F.round("risk", 9).alias("risk"), "reason")


def scoring_stream(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Positions in two slices; the stream is stopped after the first and goes on from its checkpoint with the second."""
    seen, out = scratch(spark, "seen"), scratch(spark, "scores")
    one = lambda batch: scoring_run(spark.read.schema(batch.schema).parquet(seen), batch.agg(F.max("time")).first()[0], score, threshold)
    every = positions(spark, sf_dir).select("vehicle_id", *SCORED, within(F.col("lat"), F.col("lon")).alias("inside"))
    fed(every, 2, "time", lambda stream: V.score_batches(stream, one, out, f"{out}-progress", seen, "inside"))
    return spark.read.parquet(out).drop("batch")


def stored_model(spark: SparkSession, sf_dir: str, target: float = 0.4) -> tuple[str, PipelineModel, DataFrame]:
    """The folder of a model that was fit on training rows and stored with the threshold that validation rows ask for; the model and all rows."""
    rows = labelled(spark, sf_dir).withColumn("actual", F.col("label") == 1)
    model, place, found = M.train_classifier(rows.filter("split = 'train'"), linear=True), scratch(spark, "model"), scratch(spark, "validation")
    M.scored(rows.filter("split = 'validation'"), model).select("risk", "actual").write.parquet(found)
    best = E.best_threshold(E.threshold_sweep(spark.read.parquet(found)), target).first()
    M.save_model(model, place, best["precision_threshold"], best["best_f1_threshold"], spark)
    return place, model, rows


@query()
def stream_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_scoring with a stored model, read once for all micro-batches, and its threshold."""
    model, about = M.load_model(spark, stored_model(spark, sf_dir)[0])
    return scoring_stream(spark, sf_dir, lambda rows: M.scored(rows, model).drop("alert"), M.threshold_of(about))
