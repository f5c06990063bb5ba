"""Alert policy, cooldown, neighbours, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import alerts as A
from tramline.operators import evaluation as E
from tramline.plans.base import query
from tramline.sources.fixtures import PRED, predictions

THRESHOLD, FLOOR, CAP = 0.6, 0.8, 5


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


POLICY = PRED + """, p AS (SELECT *, risk >= 0.6 AS raw, risk >= 0.8 AS elig FROM pred),
r AS (SELECT *, CASE WHEN elig THEN row_number() OVER (PARTITION BY scored_at, elig ORDER BY risk DESC, event_id) END AS rk FROM p),
pol AS (SELECT *, coalesce(elig AND rk <= 5, false) AS alert, CASE WHEN NOT raw THEN 'below_threshold' WHEN NOT elig THEN 'below_min_risk' WHEN rk <= 5 THEN 'selected' ELSE 'suppressed_by_cap' END AS reason FROM r)"""


def policy_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_policy(predictions(spark, sf_dir), "scored_at", THRESHOLD, FLOOR, CAP, "event_id")


@query(POLICY + "SELECT event_id, reason, alert, CASE WHEN alert THEN rk END AS alert_rank FROM pol")
def alert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_of(spark, sf_dir).select("event_id", "reason", "alert", "alert_rank")


@query(POLICY + "SELECT scored_at, reason, count(*) AS n FROM pol GROUP BY ALL")
def alert_policy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_of(spark, sf_dir).groupBy("scored_at", "reason").agg(F.count("*").alias("n"))


@query(POLICY + "SELECT event_id, scored_at, alert FROM pol QUALIFY row_number() OVER (PARTITION BY scored_at ORDER BY alert DESC, risk DESC, event_id) <= 20 OR alert")
def prediction_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.select_for_storage(policy_of(spark, sf_dir), "scored_at", 20, ties="event_id").select("event_id", "scored_at", "alert")


@query(POLICY + "SELECT event_id, vehicle_id FROM pol WHERE alert")
def alerts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_of(spark, sf_dir).filter("alert").select("event_id", "vehicle_id")


COOLDOWN = PRED.replace("WITH pos", "WITH RECURSIVE pos") + """, a AS (SELECT event_id, vehicle_id, position_time, actual, row_number() OVER (PARTITION BY vehicle_id ORDER BY position_time) AS n FROM pred WHERE raw_alert),
fold AS (SELECT event_id, vehicle_id, n, position_time AS last, true AS kept, actual, position_time FROM a WHERE n = 1
  UNION ALL SELECT a.event_id, a.vehicle_id, a.n, CASE WHEN a.position_time - f.last >= INTERVAL 1 DAY THEN a.position_time ELSE f.last END, a.position_time - f.last >= INTERVAL 1 DAY, a.actual, a.position_time
  FROM fold f JOIN a ON a.vehicle_id = f.vehicle_id AND a.n = f.n + 1)"""


@query(COOLDOWN + "SELECT event_id, vehicle_id FROM fold WHERE kept")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cooldown(predictions(spark, sf_dir).filter("raw_alert"), 24 * 60).select("event_id", "vehicle_id")


@query(COOLDOWN + """SELECT count(*) FILTER (WHERE kept) AS events, count(*) FILTER (WHERE NOT kept) AS suppressed, round(count(*) FILTER (WHERE kept AND actual) / count(*) FILTER (WHERE kept), 9) AS precision,
round(count(*) FILTER (WHERE kept AND actual) / (SELECT count(*) FILTER (WHERE actual) FROM pred), 9) AS recall, count(DISTINCT vehicle_id) AS vehicles FROM fold""")
def event_alert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    raw, kept = p.filter("raw_alert"), A.cooldown(p.filter("raw_alert"), 24 * 60)
    one = kept.agg(F.count("*").alias("events"), F.count_if("actual").alias("hits"), F.countDistinct("vehicle_id").alias("vehicles"))
    every = raw.agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg(F.count_if("actual").alias("positives"))))
    return rounded(one.crossJoin(F.broadcast(every)).select("events", (F.col("n") - F.col("events")).alias("suppressed"), (F.col("hits") / F.col("events")).alias("precision"), (F.col("hits") / F.col("positives")).alias("recall"), "vehicles"))


@query(POLICY + """SELECT count(*) FILTER (WHERE alert) AS alerts, round(count(*) FILTER (WHERE alert) / count(*), 9) AS share, count(DISTINCT CASE WHEN alert THEN vehicle_id END) AS vehicles,
round(count(*) FILTER (WHERE alert) / ((epoch_us(max(position_time)) - epoch_us(min(position_time))) / 3.6e9), 9) AS per_hour, round(24 * count(*) FILTER (WHERE alert) / ((epoch_us(max(position_time)) - epoch_us(min(position_time))) / 3.6e9), 9) AS per_day FROM pol""")
def alert_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.volume(policy_of(spark, sf_dir), "alert", "position_time"))


PAIRS = PRED + """, b AS (SELECT *, (last_stop_sequence + next_stop_sequence) / 2.0::DOUBLE AS center, delay - lag(delay) OVER (PARTITION BY vehicle_id ORDER BY position_time) AS delta FROM pred),
pairs AS (SELECT a.scored_at, a.event_id, o.event_id AS other, a.center, o.center AS oc, o.delay, o.delta, o.risk,
  CASE WHEN o.center > a.center THEN 'downstream' WHEN o.center < a.center THEN 'upstream' ELSE 'same' END AS band
  FROM b a JOIN b o ON a.scored_at = o.scored_at AND a.route_id = o.route_id AND a.event_id <> o.event_id)"""


def with_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("vehicle_id").orderBy("position_time")
    return predictions(spark, sf_dir).withColumn("delay_delta_1", F.col("delay") - F.lag("delay").over(w))


@query(PAIRS + "SELECT event_id, band, count(*) AS vehicles, round(avg(delay), 9) AS mean_delay, coalesce(count(*) FILTER (WHERE delta > 0), 0) AS rising FROM pairs GROUP BY ALL")
def propagation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.propagation(with_deltas(spark, sf_dir), "scored_at", ["event_id"]))


@query(PAIRS + """, near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(oc - center), risk DESC, other) <= 7)
SELECT event_id, other AS other_event_id, row_number() OVER (PARTITION BY event_id ORDER BY oc, other)::INTEGER AS place FROM near""")
def route_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.route_window(predictions(spark, sf_dir), "scored_at", ["event_id"]).select("event_id", "other_event_id", "place")


@query(PRED + """, l AS (SELECT vehicle_id, arg_max(risk, (position_time, event_id)) AS risk FROM pred WHERE raw_alert GROUP BY 1), v AS (SELECT DISTINCT vehicle_id FROM pred)
SELECT v.vehicle_id, round(l.risk, 9) AS risk, coalesce(l.risk >= 0.9, false) AS threshold_alert FROM v LEFT JOIN l USING (vehicle_id)""")
def vehicle_alert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    found = A.with_alerts(p.select("vehicle_id").distinct(), p.filter("raw_alert"), ["position_time", "event_id"], 0.9)
    return rounded(found.select("vehicle_id", F.col("found.risk").alias("risk"), "threshold_alert"))


@query(POLICY + ", live AS (SELECT DISTINCT vehicle_id FROM pos WHERE time >= (SELECT max(time) - INTERVAL 1 DAY FROM pos)) SELECT event_id FROM pol WHERE alert AND vehicle_id IN (SELECT vehicle_id FROM live)")
def active_vehicle_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy_of(spark, sf_dir)
    last = p.agg(F.max("position_time").alias("last"))
    live = p.crossJoin(F.broadcast(last)).filter(F.col("position_time") >= F.timestamp_add("DAY", F.lit(-1), "last")).select("vehicle_id")
    return p.filter("alert").join(live, "vehicle_id", "left_semi").select("event_id")


@query(PRED + "SELECT event_id, round(risk, 9) AS risk FROM pred ORDER BY pred.risk DESC, event_id LIMIT 50")
def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predictions(spark, sf_dir).orderBy(F.desc("risk"), "event_id").limit(50).select("event_id", "risk"))


@query(PRED + "SELECT event_id, position_time FROM pred ORDER BY position_time DESC, event_id DESC LIMIT 500")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).orderBy(F.desc("position_time"), F.desc("event_id")).limit(500).select("event_id", "position_time")


@query(PRED + "SELECT event_id, scored_at FROM pred ORDER BY scored_at DESC, risk DESC, event_id LIMIT 200")
def newest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).orderBy(F.desc("scored_at"), F.desc("risk"), "event_id").limit(200).select("event_id", "scored_at")


def _confusion_sql(alert: str, source: str, keys: str = "") -> str:
    return f"""SELECT {keys + ', ' if keys else ''}tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / nullif(p + r, 0), 9) AS f1,
round((tp + fp) / nullif(tp + fp + fn + tn, 0), 9) AS alert_rate, round((tp + fn) / nullif(tp + fp + fn + tn, 0), 9) AS positive_rate
FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT {keys + ', ' if keys else ''}count(*) FILTER (WHERE {alert} AND actual) AS tp, count(*) FILTER (WHERE {alert} AND NOT actual) AS fp,
count(*) FILTER (WHERE NOT {alert} AND actual) AS fn, count(*) FILTER (WHERE NOT {alert} AND NOT actual) AS tn FROM {source} WHERE actual IS NOT NULL {'GROUP BY ' + keys if keys else ''}))"""


@query(POLICY + _confusion_sql("alert", "pol"))
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metrics(policy_of(spark, sf_dir), F.col("alert")))


@query(PRED + _confusion_sql("(risk >= 0.75)", "pred"))
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metrics(predictions(spark, sf_dir), F.col("risk") >= 0.75))


@query(PRED + """, i AS (SELECT unnest(range(10))::INTEGER AS bin)
SELECT bin, round(bin / 10, 9) AS lower, round((bin + 1) / 10, 9) AS upper, count(risk) AS n, round(avg(risk), 9) AS mean_risk, round(avg(actual::INTEGER), 9) AS rate
FROM i LEFT JOIN pred ON risk >= bin / 10 AND (risk < (bin + 1) / 10 OR (bin = 9 AND risk <= 1)) GROUP BY bin""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calibration(predictions(spark, sf_dir)))


_EDGE = "CASE " + " ".join(f"WHEN risk >= {E.EDGES[k]!r} THEN {k}" for k in reversed(range(10))) + " END"


@query(PRED + f"SELECT {_EDGE} AS band, count(*) AS n, round(avg(risk), 9) AS mean_risk, round(avg(actual::INTEGER), 9) AS rate, round(avg(actual::INTEGER) / (SELECT avg(actual::INTEGER) FROM pred), 9) AS lift FROM pred GROUP BY 1")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.score_bands(predictions(spark, sf_dir)))


@query(PRED + """, g AS (SELECT * FROM pred, (VALUES (0.0), (0.6), (0.7), (0.8), (0.9)) f(floor), (VALUES (0), (1), (5), (10)) c(cap)),
e AS (SELECT *, raw_alert AND risk >= floor AS elig FROM g),
k AS (SELECT *, elig AND (cap = 0 OR row_number() OVER (PARTITION BY floor, cap, scored_at, elig ORDER BY risk DESC, event_id) <= cap) AS alert FROM e)
""" + _confusion_sql("alert", "k", "floor, cap").replace("SELECT floor, cap, tp", "SELECT floor::DOUBLE AS floor, cap::INTEGER AS cap, tp"))
def policy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.policy_sweep(predictions(spark, sf_dir), "scored_at", [0.0, 0.6, 0.7, 0.8, 0.9], [0, 1, 5, 10], "event_id"))


_T = ", t AS (SELECT unnest([" + ", ".join(map(repr, E.THRESHOLDS)) + "]::DOUBLE[]) AS threshold, unnest(range(91))::INTEGER AS k)"
SWEEP = PRED + _T + """, s AS (SELECT k, threshold, count(*) FILTER (WHERE risk >= threshold) AS alerts, count(*) FILTER (WHERE risk >= threshold AND actual) AS tp, count(*) FILTER (WHERE actual) AS positives FROM t, pred GROUP BY ALL),
sw AS (SELECT *, tp / nullif(alerts, 0) AS precision, tp / nullif(positives, 0) AS recall, coalesce(2 * (tp / nullif(alerts, 0)) * (tp / nullif(positives, 0)) / nullif(tp / nullif(alerts, 0) + tp / nullif(positives, 0), 0), 0) AS f1 FROM s)"""


@query(SWEEP + "SELECT k, round(threshold, 9) AS threshold, alerts, tp, positives, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_sweep(predictions(spark, sf_dir)))


@query(SWEEP + """SELECT round(arg_max(threshold, (round(f1, 12), -k)), 9) AS best_f1_threshold, round(max(f1), 9) AS best_f1,
round(arg_max(threshold, (round(recall, 12), -k)) FILTER (precision >= 0.1), 9) AS precision_threshold, round(max(recall) FILTER (precision >= 0.1), 9) AS precision_recall FROM sw""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.best_threshold(E.threshold_sweep(predictions(spark, sf_dir)), 0.1))


RANK = """, u AS (SELECT {k}risk, count(*) FILTER (WHERE actual) AS p, count(*) FILTER (WHERE NOT actual) AS q FROM pred WHERE actual IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM u WINDOW w AS ({pk}ORDER BY risk DESC))
"""
RANKED = "round(CASE WHEN sum(p) * sum(q) > 0 THEN sum(q * (tp - p / 2)) / (sum(p) * sum(q)) END, 9) AS auc, round(CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END, 9) AS average_precision FROM c"


@query(PRED + RANK.format(k="", pk="") + f"SELECT {RANKED}")
def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.ranking(predictions(spark, sf_dir)))


@query(PRED + ", n AS (SELECT count(*) AS n, count(*) FILTER (WHERE actual) AS pos FROM pred), f AS (SELECT unnest([0.005, 0.01, 0.02, 0.05, 0.1]::DOUBLE[]) AS fraction), " + """s AS (SELECT fraction, greatest(1, round_even(n * fraction, 0))::BIGINT AS m, n, pos FROM f, n),
r AS (SELECT *, row_number() OVER (ORDER BY risk DESC, event_id) AS place FROM pred)
SELECT fraction, m AS n, round(min(risk), 9) AS least_risk, round(count(*) FILTER (WHERE actual) / count(*), 9) AS precision, round(count(*) FILTER (WHERE actual) / any_value(pos), 9) AS recall, round(count(*) FILTER (WHERE actual) / count(*) / (any_value(pos) / any_value(s.n)), 9) AS lift
FROM s JOIN r ON place <= m GROUP BY fraction, m""")
def top_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.top_fractions(predictions(spark, sf_dir), (0.005, 0.01, 0.02, 0.05, 0.1), "event_id"))


@query(PRED + RANK.format(k="route_id, ", pk="PARTITION BY route_id ") + f""", rk AS (SELECT route_id, {RANKED} GROUP BY route_id),
g AS (SELECT route_id, count(*) AS n, round(avg(actual::INTEGER), 9) AS positive_rate, count(*) FILTER (WHERE risk >= 0.6) AS alerts, round(count(*) FILTER (WHERE risk >= 0.6 AND actual) / nullif(count(*) FILTER (WHERE risk >= 0.6), 0), 9) AS precision,
  round(count(*) FILTER (WHERE risk >= 0.6 AND actual) / nullif(count(*) FILTER (WHERE actual), 0), 9) AS recall FROM pred WHERE route_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)
SELECT g.*, average_precision FROM g JOIN rk USING (route_id) ORDER BY n DESC, route_id LIMIT 10""")
def grouped_classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).filter("route_id IS NOT NULL")
    hit, alert = F.col("actual"), F.col("risk") >= THRESHOLD
    groups = p.groupBy("route_id").agg(
        F.count("*").alias("n"), F.avg(hit.cast("double")).alias("positive_rate"), F.count_if(alert).alias("alerts"),
        F.try_divide(F.count_if(alert & hit), F.count_if(alert)).alias("precision"), F.try_divide(F.count_if(alert & hit), F.count_if(hit)).alias("recall"),
    ).filter("n >= 20").orderBy(F.desc("n"), "route_id").limit(10)
    return rounded(F.broadcast(groups).join(E.ranking(p, ["route_id"]).select("route_id", "average_precision"), "route_id"))


PERSIST = PRED + ", l AS (SELECT *, lag(delay) OVER (PARTITION BY vehicle_id ORDER BY position_time) AS before FROM pred)"


def _before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("before", F.lag("delay").over(Window.partitionBy("vehicle_id").orderBy("position_time")))


@query(PERSIST + "SELECT line, count(*) AS n, round(avg(abs(before - delay)), 9) AS persistence_mae, round(sqrt(avg((before - delay)**2)), 9) AS persistence_rmse, round(avg(abs(0.5 * before - delay)), 9) AS model_mae, round(sqrt(avg((0.5 * before - delay)**2)), 9) AS model_rmse FROM l WHERE before IS NOT NULL GROUP BY 1")
def grouped_regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the delay before, and of half of it as a stand-in for a model."""
    held, model = E.error_measures(F.col("before"), F.col("delay")), E.error_measures(F.col("before") * 0.5, F.col("delay"))
    rows = _before(spark, sf_dir).filter("before IS NOT NULL")
    return rounded(rows.groupBy("line").agg(F.count("*").alias("n"), *[c.alias(f"persistence_{k}") for k, c in held.items()], *[c.alias(f"model_{k}") for k, c in model.items()]))


@query(PERSIST + "SELECT round(avg(abs(before - delay)), 9) AS mae, round(sqrt(avg((before - delay)**2)), 9) AS rmse FROM l WHERE before IS NOT NULL")
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_before(spark, sf_dir).filter("before IS NOT NULL").agg(*[c.alias(k) for k, c in E.error_measures(F.col("before"), F.col("delay")).items()]))


@query(PERSIST + ", b AS (SELECT *, coalesce(delay - before, 0) >= 60 AS says FROM l) " + _confusion_sql("says", "b"))
def persistence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _before(spark, sf_dir)
    return rounded(E.metrics(rows, F.coalesce(F.col("delay") - F.col("before"), F.lit(0)) >= 60))


@query(POLICY + """SELECT count(*) AS predictions, count(actual) AS labelled, count(*) - count(actual) AS unlabelled, count(*) FILTER (WHERE actual) AS positives, count(*) FILTER (WHERE alert) AS map_alerts, count(*) FILTER (WHERE raw) AS raw_alerts,
max(scored_at) AS latest_run, max(position_time) AS latest_position, CASE WHEN count(*) = 0 THEN 'warning' WHEN count(actual) < 3 THEN 'warning' ELSE 'passed' END AS status FROM pol""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("actual")
    return policy_of(spark, sf_dir).agg(
        F.count("*").alias("predictions"), n.alias("labelled"), (F.count("*") - n).alias("unlabelled"), F.count_if("actual").alias("positives"), F.count_if("alert").alias("map_alerts"), F.count_if("policy_raw").alias("raw_alerts"),
        F.max("scored_at").alias("latest_run"), F.max("position_time").alias("latest_position"), F.when(n < 3, "warning").otherwise("passed").alias("status"),
    )


@query(POLICY + "SELECT count(*) AS total, count(*) FILTER (WHERE alert) AS alerts, max(CASE WHEN alert THEN position_time END) AS latest_alert FROM pol")
def alert_collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_of(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("alert").alias("alerts"), F.max(F.when(F.col("alert"), F.col("position_time"))).alias("latest_alert"))
