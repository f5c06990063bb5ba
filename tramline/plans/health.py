"""Data quality, freshness and the window backtest's choice."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import models as M
from tramline.operators import quality as Q
from tramline.plans.alerting import POLICY, policy_of, rounded
from tramline.plans.base import query, scratch, written
from tramline.plans.features import FEATURES, LAGS, TARGET, features_of, samples
from tramline.plans.trajectories import SEG, segments_of
from tramline.sources import lake as L
from tramline.sources.fixtures import POS, PRED, positions, predictions

#: The clock of these queries: half a day after the events' last one.
NOW_SQL = "(SELECT max(ts) + INTERVAL 12 HOUR FROM events)"
MOST_AGE, LEAST = 10 * 86_400, 300


def now_of(df: DataFrame, time: str = "time") -> F.Column:
    return F.timestamp_add("HOUR", F.lit(12), F.lit(df.agg(F.max(time)).first()[0]))


def _checks(source: str, checks: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT service_date, '{name}' AS \"check\", CASE WHEN coalesce({ok}, false) THEN 'passed' ELSE '{bad}' END AS status FROM {source}" for name, (ok, bad) in checks.items())


#: A day without positions, counted from the first one; days without alerts.
GAP, QUIET = 4, 5
DAYS = POS + f""", kept AS (SELECT * FROM pos WHERE service_date <> (SELECT min(service_date) + {GAP} FROM pos)), days AS (SELECT unnest(generate_series(min(service_date)::TIMESTAMP, max(service_date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS service_date FROM pos)"""
DQ1 = f", daily AS (SELECT d.service_date, n, v, latest FROM days d LEFT JOIN (SELECT service_date, count(*) AS n, count(DISTINCT vehicle_id) AS v, max(time) AS latest FROM kept GROUP BY 1) k USING (service_date)), dq1 AS (" + _checks("daily", {
    "rows": ("n >= 300", "failed"), "files": ("n > 0", "failed"), "vehicles": ("v > 0", "failed"), "partition": ("n IS NOT NULL", "failed"), "max_time": ("latest IS NOT NULL", "failed"),
    "freshness": (f"latest IS NOT NULL AND greatest(0, floor((epoch_us({NOW_SQL}) - epoch_us(latest)) / 1e6)) <= 864000", "warning"),
}) + ")"


def kept_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions but for one day."""
    p = positions(spark, sf_dir)
    return p.filter(F.col("service_date") != F.date_add(F.lit(p.agg(F.min("service_date")).first()[0]), GAP))


@query(DAYS + DQ1 + "SELECT * FROM dq1")
def position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kept_positions(spark, sf_dir)
    return Q.position_checks(p, Q.every_date(p), now_of(p), LEAST, MOST_AGE)


FEATS = LAGS + TARGET + f", feats AS ({FEATURES}), days AS (SELECT unnest(generate_series(min(service_date)::TIMESTAMP, max(service_date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS service_date FROM pos)"
DQ2 = f", fdaily AS (SELECT d.service_date, g.n, g.labelled FROM days d LEFT JOIN (SELECT service_date, count(*) AS n, count(target_delay) AS labelled FROM feats WHERE service_date <> (SELECT min(service_date) + {GAP} FROM pos) GROUP BY 1) g USING (service_date)), dq2 AS (" + _checks("fdaily", {
    "partition": ("n IS NOT NULL", "failed"), "rows": ("n >= 150", "failed"), "bytes": ("n > 0", "failed"), "labelled": ("labelled > 0", "warning"),
}) + ")"


@query(FEATS + DQ2 + "SELECT * FROM dq2")
def feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a written lake of features that lacks a date."""
    out, p = scratch(spark, "features"), positions(spark, sf_dir)
    gap = F.date_add(F.lit(p.agg(F.min("service_date")).first()[0]), GAP)
    L.by_date(features_of(samples(spark, sf_dir)).filter(F.col("service_date") != gap)).write.partitionBy("service_date").parquet(out)
    files = L.files_of(spark, f"{out}/*/*.parquet").select(F.to_date(F.regexp_extract("path", r"service_date=([0-9-]+)/", 1)).alias("service_date"), "length")
    return Q.feature_checks(spark.read.parquet(out), files, Q.every_date(p), 150)


DQ3 = f""", made AS (SELECT * FROM pol WHERE alert AND day(scored_at) % {QUIET} <> 0), runs AS (SELECT DISTINCT scored_at AS service_date FROM pol), s AS (SELECT max(time) AS source FROM pos),
g AS (SELECT r.service_date, coalesce(n, 0) AS n, latest, floor((epoch_us({NOW_SQL}) - epoch_us(latest)) / 1e6) AS age, floor((epoch_us({NOW_SQL}) - epoch_us(source)) / 1e6) AS source_age, floor((epoch_us(source) - epoch_us(latest)) / 1e6) AS lag
FROM s, runs r LEFT JOIN (SELECT scored_at AS service_date, count(*) AS n, max(position_time) AS latest FROM made GROUP BY 1) a USING (service_date)),
dq3 AS (SELECT service_date, 'rows' AS "check", CASE WHEN n > 0 THEN 'passed' ELSE 'warning' END AS status FROM g UNION ALL SELECT service_date, 'columns', 'passed' FROM g WHERE n > 0 UNION ALL SELECT service_date, 'latest_time', 'passed' FROM g WHERE n > 0
UNION ALL SELECT service_date, 'freshness', CASE WHEN age <= 36000 THEN 'passed' WHEN source_age > 36000 AND lag <= 864000 THEN 'warning' ELSE 'failed' END FROM g WHERE n > 0)"""


def made_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts under the policy, on some days none."""
    return policy_of(spark, sf_dir).filter(F.col("alert") & (F.dayofmonth("scored_at") % QUIET != 0)).withColumn("service_date", F.col("scored_at"))


@query(POLICY + DQ3 + "SELECT * FROM dq3")
def alert_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy_of(spark, sf_dir)
    last, runs = p.agg(F.max("position_time")).first()[0], p.select(F.col("scored_at").alias("service_date")).distinct()
    return Q.alert_checks(made_alerts(spark, sf_dir), runs, now_of(p, "position_time"), 36_000, F.lit(last), 864_000, ["vehicle_id", "position_time", "risk", "alert"])


def checks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a run, written as a history table is, and read back."""
    out = scratch(spark, "checks")
    for name, f in (("positions", position_checks), ("features", feature_checks), ("alerts", alert_checks)):
        f(spark, sf_dir).withColumn("source", F.lit(name)).write.mode("append").parquet(out)
    return spark.read.parquet(out)


REPORT = POLICY + DAYS.removeprefix(POS) + DQ1 + FEATS.removeprefix(POS).replace(", days AS", ", fdays AS") + DQ2.replace("FROM days d", "FROM fdays d") + DQ3 + ", h AS (SELECT * FROM dq1 UNION ALL SELECT * FROM dq2 UNION ALL SELECT * FROM dq3)"
COUNTS = "count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'passed' END AS verdict FROM h"


@query(REPORT + f" SELECT service_date, {COUNTS} GROUP BY 1 UNION ALL SELECT NULL, {COUNTS}")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.report(checks_of(spark, sf_dir))


#: Age that a run's alerts may have; a run whose rows hold this event failed.
ALERT_AGE, BROKEN = 15 * 86_400, 503
_STATUS = "CASE WHEN n = 0 THEN 'missing' WHEN floor((epoch_us({now}) - epoch_us(latest)) / 1e6) > {limit} THEN 'stale' ELSE 'fresh' END"
RUNS = POLICY + f""", run AS (SELECT scored_at AS service_date, count(*) FILTER (WHERE alert AND day(scored_at) % {QUIET} <> 0) AS n, max(CASE WHEN alert AND day(scored_at) % {QUIET} <> 0 THEN position_time END) AS latest,
  max(position_time) AS made, bool_or(event_id % 1000 = {BROKEN}) AS broken FROM pol GROUP BY 1),
st AS (SELECT *, CASE WHEN broken THEN 'error' WHEN n = 0 THEN 'missing' WHEN floor((epoch_us({NOW_SQL}) - epoch_us(made)) / 1e6) > {ALERT_AGE} OR latest IS NULL THEN 'stale' ELSE 'fresh' END AS status FROM run)"""


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring runs: alerts, their latest time, when the run was made, and its error, if it had one."""
    p = policy_of(spark, sf_dir)
    shown = F.col("alert") & (F.dayofmonth("scored_at") % QUIET != 0)
    runs = p.groupBy(F.col("scored_at").alias("service_date")).agg(
        F.count_if(shown).alias("n"), F.max(F.when(shown, F.col("position_time"))).alias("latest"), F.max("position_time").alias("made"),
        F.max(F.when(F.col("event_id") % 1000 == BROKEN, F.concat(F.lit("event "), "event_id"))).alias("error"),
    )
    status = Q.alert_status(F.col("n"), F.col("latest"), F.col("made"), F.col("error"), now_of(p, "position_time"), ALERT_AGE)
    return runs.withColumn("status", status)


@query(RUNS + "SELECT service_date, n AS alerts, latest, status FROM st")
def alert_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(spark, sf_dir).select("service_date", F.col("n").alias("alerts"), "latest", "status")


SOURCES = RUNS + f", src AS (SELECT service_date, {_STATUS.format(now=NOW_SQL, limit=5 * 86400)} AS status FROM (SELECT service_date, count(*) AS n, max(time) AS latest FROM pos GROUP BY 1) UNION ALL SELECT service_date, status FROM st)"


@query(SOURCES + "SELECT service_date, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status = 'stale') THEN 'stale' ELSE 'fresh' END AS status FROM src GROUP BY 1")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    place = p.groupBy("service_date").agg(F.count("*").alias("n"), F.max("time").alias("latest")).select("service_date", Q.freshness(F.col("latest"), F.col("n"), now_of(p), 5 * 86400).alias("status"))
    return Q.worst(place.unionByName(runs_of(spark, sf_dir).select("service_date", "status")), ["service_date"])


BOARD = SEG + RUNS.removeprefix(POS) + REPORT.removeprefix(POLICY) + f""", u AS (SELECT 'positions' AS source, count(*) AS rows, max(time) AS latest, 432000 AS "limit", {_STATUS.format(now=NOW_SQL, limit=432000).replace('n = 0', 'count(*) = 0').replace('latest', 'max(time)')} AS status FROM pos
UNION ALL SELECT 'trajectory', count(*), max(time), 864000, {_STATUS.format(now=NOW_SQL, limit=864000).replace('n = 0', 'count(*) = 0').replace('latest', 'max(time)')} FROM state WHERE point_state = 'observed'
UNION ALL SELECT 'alerts', n, latest, {ALERT_AGE}, status FROM st WHERE service_date = (SELECT max(service_date) FROM st)
UNION ALL SELECT 'checks', count(*), max(service_date)::TIMESTAMP, NULL, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'passed' END FROM h)"""


@query(BOARD + "SELECT * FROM u")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source: two tables, the newest scoring run, and the report of checks."""
    p = positions(spark, sf_dir)
    now, rows = now_of(p), None
    for df, name, limit in ((p, "positions", 432_000), (segments_of(spark, sf_dir).filter("point_state = 'observed'"), "trajectory", 864_000)):
        one = df.agg(F.count("*").alias("rows"), F.max("time").alias("latest")).select(F.lit(name).alias("source"), "rows", "latest", F.lit(limit).alias("limit"), Q.freshness(F.col("latest"), F.col("rows"), now, limit).alias("status"))
        rows = one if rows is None else rows.unionByName(one)
    newest = runs_of(spark, sf_dir).agg(F.max_by(F.struct("n", "latest", "status"), "service_date").alias("r"))
    rows = rows.unionByName(newest.select(F.lit("alerts").alias("source"), F.col("r.n").alias("rows"), F.col("r.latest").alias("latest"), F.lit(ALERT_AGE).alias("limit"), F.col("r.status").alias("status")))
    history = checks_of(spark, sf_dir)
    last = history.agg(F.max("service_date").cast("timestamp_ntz").alias("latest"))
    all_checks = Q.report(history).filter("service_date IS NULL").crossJoin(F.broadcast(last))
    return rows.unionByName(all_checks.select(F.lit("checks").alias("source"), (F.col("passed") + F.col("warnings") + F.col("failed")).alias("rows"), "latest", F.lit(None).cast("int").alias("limit"), F.col("verdict").alias("status")))


@query(POS + f""", l AS (SELECT max(time) AS last FROM pos) SELECT count(*) AS rows, max(last) AS latest, count(*) FILTER (WHERE time >= last - INTERVAL 24 HOUR) AS near_rows, count(DISTINCT CASE WHEN time >= last - INTERVAL 24 HOUR THEN vehicle_id END) AS near_vehicles,
count(*) FILTER (WHERE time >= {NOW_SQL} - INTERVAL 24 HOUR) AS recent_rows, count(DISTINCT CASE WHEN time >= {NOW_SQL} - INTERVAL 24 HOUR THEN vehicle_id END) AS recent_vehicles FROM pos, l""")
def table_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return Q.near_latest(p, 86_400, now_of(p))


@query(LAGS + TARGET + f", feats AS ({FEATURES}) SELECT service_date, count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, min(time) AS first_time, max(time) AS last_time, round(avg(target_delay_delta), 6) AS mean_delta, coalesce(count(*) FILTER (WHERE target_delay_delta >= 60), 0) AS positives FROM feats GROUP BY 1")
def feature_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features_of(samples(spark, sf_dir))
    return f.groupBy("service_date").agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.round(F.avg("target_delay_delta"), 6).alias("mean_delta"), F.coalesce(F.count_if(F.col("target_delay_delta") >= 60), F.lit(0)).alias("positives"))


@query(LAGS + TARGET + f", feats AS ({FEATURES}) SELECT vehicle_id, time, target_delay_delta >= 60 AS label FROM feats WHERE target_delay IS NOT NULL AND delay IS NOT NULL")
def eligible_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features_of(samples(spark, sf_dir)).dropna(subset=["delay", "target_delay", "target_delay_delta"])
    return f.select("vehicle_id", "time", (F.col("target_delay_delta") >= 60).alias("label"))


#: Days before the test rows that models are tried on, days of test rows, the risk that alerts, and rows that a rate leans on its base by.
WINDOWS, TEST_DAYS, ALERT_RISK, LEAN = (4, 8, 16, 24), 5, 0.32, 20
BACK = PRED.replace("WITH pos", "WITH RECURSIVE pos") + f""", w AS (SELECT unnest([4, 8, 16, 24]) AS days), t0 AS (SELECT max(position_time) - INTERVAL 5 DAY AS start FROM pred),
tr AS (SELECT days, route_id, mode, actual FROM pred, w, t0 WHERE position_time >= start - to_days(days::INTEGER) AND position_time < start),
tot AS (SELECT days, count(*) AS train_rows, avg(actual::INTEGER) AS base FROM tr GROUP BY 1),
rate AS (SELECT days, route_id, mode, count(*) AS n, count(*) FILTER (WHERE actual) AS k FROM tr GROUP BY ALL),
te AS (SELECT tot.days, train_rows, event_id, vehicle_id, position_time, actual, (coalesce(k, 0) + {LEAN} * base) / (coalesce(n, 0) + {LEAN}) AS risk FROM t0, tot JOIN pred ON true LEFT JOIN rate ON rate.days = tot.days AND rate.route_id = pred.route_id AND rate.mode = pred.mode WHERE position_time >= start),
m AS (SELECT days, any_value(train_rows) AS train_rows, count(*) FILTER (WHERE risk >= {ALERT_RISK} AND actual) / nullif(count(*) FILTER (WHERE risk >= {ALERT_RISK}), 0) AS precision, count(*) FILTER (WHERE risk >= {ALERT_RISK} AND actual) / count(*) FILTER (WHERE actual) AS recall,
  count(*) FILTER (WHERE risk >= {ALERT_RISK}) AS alerts, count(*) AS test_rows FROM te GROUP BY 1),
top AS (SELECT days, avg(actual::INTEGER) AS top_precision FROM (SELECT *, row_number() OVER (PARTITION BY days ORDER BY round(risk, 9) DESC, event_id) AS place, count(*) OVER (PARTITION BY days) AS n FROM te) WHERE place <= greatest(1, round_even(n * 0.01, 0)) GROUP BY 1),
u AS (SELECT days, round(risk, 9) AS risk, count(*) FILTER (WHERE actual) AS p, count(*) AS n FROM te GROUP BY ALL), c AS (SELECT *, sum(p) OVER k AS tp, sum(n) OVER k AS al FROM u WINDOW k AS (PARTITION BY days ORDER BY risk DESC)),
ap AS (SELECT days, sum(p * tp / al) / sum(p) AS average_precision FROM c GROUP BY 1),
aa AS (SELECT days, vehicle_id, position_time, row_number() OVER (PARTITION BY days, vehicle_id ORDER BY position_time, event_id) AS n FROM te WHERE risk >= {ALERT_RISK}),
fo AS (SELECT days, vehicle_id, n, position_time AS last, true AS kept FROM aa WHERE n = 1
  UNION ALL SELECT aa.days, aa.vehicle_id, aa.n, CASE WHEN aa.position_time - fo.last >= INTERVAL 30 MINUTE THEN aa.position_time ELSE fo.last END, aa.position_time - fo.last >= INTERVAL 30 MINUTE
  FROM fo JOIN aa ON aa.days = fo.days AND aa.vehicle_id = fo.vehicle_id AND aa.n = fo.n + 1),
ev AS (SELECT days, count(*) FILTER (WHERE kept) AS event_alerts FROM fo GROUP BY 1),
b AS (SELECT days::INTEGER AS days, train_rows, precision, recall, top_precision, average_precision, alerts, coalesce(event_alerts, 0)::BIGINT AS event_alerts FROM m JOIN top USING (days) JOIN ap USING (days) LEFT JOIN ev USING (days))"""


def backtest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(predictions(spark, sf_dir).select("event_id", "vehicle_id", "position_time", "route_id", "mode", "actual"), "backtest")
    start = rows.agg(F.max("position_time")).first()[0] - timedelta(days=TEST_DAYS)
    return M.backtest(rows, list(WINDOWS), start, M.rates(["route_id", "mode"], LEAN), ALERT_RISK, keep=lambda found: written(found, "window"))


@query(BACK + " SELECT days, train_rows, round(precision, 9) AS precision, round(recall, 9) AS recall, round(top_precision, 9) AS top_precision, round(average_precision, 9) AS average_precision, alerts, event_alerts FROM b")
def window_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of each training window, measured on the rows that come later."""
    return rounded(backtest_of(spark, sf_dir))


@query(BACK + """, s AS (SELECT *, 0.4 * coalesce(precision, 0) + 0.2 * coalesce(recall, 0) + 0.2 * coalesce(top_precision, 0) + 0.2 * coalesce(average_precision, 0) - CASE WHEN alerts = 0 THEN 0.2 ELSE 0 END AS score FROM b WHERE train_rows >= 100),
p AS (SELECT *, coalesce(precision, 0) >= 0.33 AS meets, bool_or(coalesce(precision, 0) >= 0.33) OVER () AS any_meets FROM s), q AS (SELECT *, max(score) OVER () AS best FROM p WHERE meets OR NOT any_meets)
SELECT min(days) AS days FROM q WHERE score >= best - 0.02 * abs(best)""")
def window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which training window to take, from a model of each, measured on later rows."""
    return M.choose_window(backtest_of(spark, sf_dir), 100, 0.33).select("days")
