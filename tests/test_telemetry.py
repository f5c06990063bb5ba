"""The telemetry operators on small cases with known results."""

from __future__ import annotations

import shutil
import subprocess
import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_km, haversine_m, within
from tramline.functions.timeutil import MILLENNIUM, MONDAY, bucket, day_of_week, lenient_int, second_diff, truncated_int
from tramline.operators import alerts as A
from tramline.operators import evaluation as E
from tramline.operators import models as M
from tramline.operators import quality as Q
from tramline.operators import replay as R
from tramline.operators import sampling as S
from tramline.operators import splits as X
from tramline.operators import trajectory as T
from tramline.operators.asof import asof_forward, nearest
from tramline.sources import lake as L
from tramline.sources.fixtures import positions
from tramline.streaming import vehicles as V

T0 = datetime(2024, 5, 18, 8, 0, 0)
SF = "/root/testdata/sf0.001"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def column(df, name):
    return [r[name] for r in df.collect()]


# Time, casts, geography


def test_bucket_origins(spark):
    one = spark.createDataFrame([(datetime(2024, 1, 1, 10),), (datetime(1999, 12, 31, 23, 59, 59, 500000),)], "t timestamp_ntz")
    rows = one.select(bucket(F.col("t"), 7 * 3600, MONDAY).alias("m"), bucket(F.col("t"), 30, MILLENNIUM).alias("s")).collect()
    assert rows[0].m == datetime(2024, 1, 1, 7) and rows[0].s == datetime(2024, 1, 1, 10) and rows[1].s == datetime(1999, 12, 31, 23, 59, 30)


def test_seconds_are_boundaries_and_days_start_on_sunday(spark):
    one = spark.createDataFrame([(datetime(2024, 1, 7, 0, 0, 0, 900000), datetime(2024, 1, 7, 0, 0, 2, 100000))], "a timestamp_ntz, b timestamp_ntz")
    r = one.select(second_diff(F.col("a"), F.col("b")).alias("d"), day_of_week(F.col("a")).alias("sun"), day_of_week(F.col("a"), iso=True).alias("iso")).first()
    assert (r.d, r.sun, r.iso) == (2, 0, 7)


def test_lenient_casts(spark):
    texts = spark.createDataFrame([(x,) for x in ("12.5", "13.5", "-12.5", " 7 ", "1e2", "abc", "", None, "true")], "x string")
    assert column(texts.select(lenient_int(F.col("x")).alias("v")), "v") == [13, 14, -13, 7, 100, None, None, None, None]
    assert column(texts.select(truncated_int(F.col("x")).alias("v")), "v") == [12, 13, -12, 7, 100, None, None, None, None]


def test_distance_and_bounds(spark):
    one = spark.range(1)
    p = tuple(map(F.lit, (50.0875, 14.4214, 50.0865, 14.4114)))
    r = one.select(haversine_m(*p).alias("m"), haversine_km(*p).alias("km"), haversine_m(F.lit(None).cast("double"), *p[1:]).alias("n"), within(F.lit(50.0755), F.lit(14.4378)).alias("i"), within(F.lit(49.1951), F.lit(16.6068)).alias("o")).first()
    assert abs(r.m - 722) < 1 and abs(r.km * 1000 - r.m) < 1e-6 and r.n is None and r.i and not r.o


# Sampling and joins


def test_sampling_modes_differ_on_nulls(spark):
    df = spark.createDataFrame([("v", at(0), 1, 5.0), ("v", at(10), 2, None)], "vehicle_id string, time timestamp_ntz, delay int, speed double")
    assert S.sample_last_non_null(df, ["delay", "speed"], 30, MONDAY).first()["speed"] == 5.0
    row = S.sample_last_row(df, ["delay", "speed"], 30, MONDAY).first()
    assert row["speed"] is None and row["delay"] == 2


def test_as_of_takes_equal_keys_and_respects_tolerance(spark):
    left = spark.createDataFrame([("v", at(0)), ("v", at(5)), ("w", at(0))], "vehicle_id string, t timestamp_ntz")
    right = spark.createDataFrame([("v", at(0), 1), ("v", at(20), 2)], "vehicle_id string, time timestamp_ntz, delay int")
    found = asof_forward(left, right, ["vehicle_id"], F.col("t"), F.col("time"), ["delay"], 15).orderBy("vehicle_id", "t")
    assert column(found.select(F.col("match.delay").alias("d")), "d") == [1, 2, None]
    assert asof_forward(left, right, ["vehicle_id"], F.col("t"), F.col("time"), ["delay"], 14, "inner").count() == 1


def test_nearest_prefers_the_earlier_on_ties(spark):
    left = spark.createDataFrame([("v", at(10)), ("v", at(100))], "vehicle_id string, t timestamp_ntz")
    right = spark.createDataFrame([("v", at(5), 1), ("v", at(15), 2)], "vehicle_id string, time timestamp_ntz, delay int")
    found = nearest(left, right, ["vehicle_id"], F.col("t"), F.col("time"), ["delay"], 30).orderBy("t")
    assert column(found.select(F.col("match.delay").alias("d")), "d") == [1, None]


def test_unlabelled_rows_are_kept(spark):
    df = spark.createDataFrame([("v", at(0), 10)], "vehicle_id string, time timestamp_ntz, delay int")
    assert S.with_target(df, 300, 600).first()["target_delay"] is None
    assert S.with_target(df, 300, 600, keep_unlabelled=False).count() == 0


# Trajectories


def points(spark, rows):
    return spark.createDataFrame([(k, "v", at(s), lat, lon, "L9", "t", "tram") for k, (s, lat, lon) in enumerate(rows)], "event_id long, vehicle_id string, time timestamp_ntz, lat double, lon double, route_id string, trip_id string, mode string")


def test_segment_rules_in_order(spark):
    rows = [(0, 50.0, 14.4), (10, 50.001, 14.4), (5, 50.002, 14.4), (60, 50.002, 14.4), (61, 50.1, 14.4), (61, 50.1, 14.4)]
    found = T.segments(points(spark, rows), ["event_id"]).orderBy("event_id").collect()
    assert [r.gap_reason for r in found] == [None, None, "out_of_order", "dropout", "speed_violation", "out_of_order"]
    assert [r.interpolation_method for r in found][:2] == [None, "linear"]


@pytest.mark.parametrize(("dt", "n"), [(2.0, 1), (2.5, 1), (5.9, 4), (30, 29), (31, 0), (1.9, 0)])
def test_interpolated_points(spark, dt, n):
    found = T.interpolated(T.segments(points(spark, [(0, 50.0, 14.4), (dt, 50.0001, 14.4)]), ["event_id"])).collect()
    assert len(found) == n and all(50.0 < r.lat < 50.0001 for r in found)


def test_position_at_a_time(spark):
    path = points(spark, [(0, 50.0, 14.0), (10, 50.1, 14.0), (10.0, 50.1, 14.0), (20, 50.2, 14.0)])
    probes = spark.createDataFrame([("v", at(s)) for s in (-5, 5, 20, 100, 400)], "vehicle_id string, t timestamp_ntz")
    found = T.position_at(probes, path, "t").orderBy("t").collect()
    assert [None if r.lat is None else round(r.lat, 6) for r in found] == [50.0, 50.05, 50.2, 50.2, None]
    assert [r.stale for r in found] == [False, False, False, True, True]


# Alerts and evaluation

RISKS = "vehicle_id string, run int, risk double"


def test_alert_cap_and_floor(spark):
    df = spark.createDataFrame([(v, 1, r) for v, r in zip("abcd", (0.91, 0.82, 0.73, 0.44), strict=True)], RISKS)
    rows = A.apply_policy(df, "run", 0.7, 0.0, 2).orderBy("vehicle_id").collect()
    assert [r.reason for r in rows] == ["selected", "selected", "suppressed_by_cap", "below_threshold"] and [r.alert_rank for r in rows] == [1, 2, None, None]
    rows = A.apply_policy(df.limit(2).withColumn("risk", F.when(F.col("vehicle_id") == "a", 0.9).otherwise(0.75)), "run", 0.7, 0.8, 0).orderBy("vehicle_id").collect()
    assert [r.reason for r in rows] == ["selected", "below_min_risk"] and all(r.policy_raw for r in rows)


def test_storage_never_drops_alerts(spark):
    df = spark.createDataFrame([("a", 1, 0.1, True), ("b", 1, 0.2, True), ("c", 1, 0.9, False)], RISKS + ", alert boolean")
    assert sorted(column(A.select_for_storage(df, "run", 1), "vehicle_id")) == ["a", "b"] and A.select_for_storage(df, "run", 0).count() == 3


def test_cooldown_counts_from_the_last_kept(spark):
    rows = [("v", at(m * 60)) for m in (0, 20, 40, 59, 61)] + [(None, at(0)), ("w", None)]
    df = spark.createDataFrame(rows, "vehicle_id string, position_time timestamp_ntz")
    kept = A.cooldown(df, 30).filter("vehicle_id = 'v'").orderBy("position_time")
    assert column(kept, "position_time") == [at(0), at(2400)] and A.cooldown(df, 30).count() == 4 and A.cooldown(df, 0).count() == 7


def test_confusion_and_calibration(spark):
    df = spark.createDataFrame([(0.9, True, True), (0.9, True, False), (0.1, False, True), (0.1, False, False), (0.5, True, None)], "risk double, alert boolean, actual boolean")
    r = E.metrics(df, F.col("alert")).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5) and (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    bins = spark.createDataFrame([(0.15, False), (0.19, True), (0.82, True), (1.0, True), (1.5, True)], "risk double, actual boolean")
    rows = E.calibration(bins, 5).orderBy("bin").collect()
    assert [(x.n, x.rate) for x in rows] == [(2, 0.5), (0, None), (0, None), (0, None), (2, 1.0)]


def test_policy_sweep(spark):
    df = spark.createDataFrame([("a", 1, 0.91, True, True), ("b", 1, 0.82, True, False), ("c", 1, 0.72, True, True)], RISKS + ", raw_alert boolean, actual boolean")
    rows = {(r.floor, r.cap): (r.tp + r.fp, round(r.precision, 6)) for r in E.policy_sweep(df, "run", [0.0, 0.8], [0, 1], "vehicle_id").collect()}
    assert rows == {(0.0, 0): (3, round(2 / 3, 6)), (0.0, 1): (1, 1.0), (0.8, 0): (2, 0.5), (0.8, 1): (1, 1.0)}


def test_ranking_measures(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, False)], "risk double, actual boolean")
    r = E.ranking(df).first()
    assert abs(r.auc - (3 + 1.5) / 6) < 1e-9 and abs(r.average_precision - (0.5 * 1 + 0.5 * 2 / 4)) < 1e-9
    assert E.ranking(df.filter("actual")).first().auc is None


def _vehicles(n, seed):
    import random

    rng = random.Random(seed)
    stop = lambda: rng.choice([None, rng.randrange(6)])
    return [(f"v{k}", rng.randrange(2), rng.choice([0.1, 0.5, 0.9]), rng.choice(["L1", None]), rng.choice(["1", "2"]), stop(), stop(), rng.choice([None, rng.randrange(90)]), rng.choice([None, -1, 1]), k) for k in range(n)]


ON_ROUTE = RISKS + ", route_id string, line string, last_stop_sequence int, next_stop_sequence int, delay int, delay_delta_1 int, event_id long"


@pytest.mark.parametrize("n", [3, 60])
def test_neighbours_against_all_pairs(spark, n):
    rows = _vehicles(n, n)
    place = {r[9]: (r[5] + r[6]) / 2 if None not in r[5:7] else r[5] if r[5] is not None else r[6] for r in rows}
    bands, nearest = {}, {}
    for r in rows:
        others = [o for o in rows if o[9] != r[9] and o[1] == r[1] and (o[3] or o[4]) == (r[3] or r[4])]
        for o in others:
            a, b = place[r[9]], place[o[9]]
            band = "same" if a is None or b is None or a == b else "downstream" if b > a else "upstream"
            bands.setdefault((r[9], band), []).append(o)
        distance = lambda o: abs(place[o[9]] - place[r[9]]) if place[o[9]] is not None and place[r[9]] is not None else float("inf")  # noqa: B023, E731
        near = sorted(others, key=lambda o: (distance(o), -o[2], o[9]))[:7]
        along = sorted(near, key=lambda o: (place[o[9]] is not None, place[o[9]] or 0, o[9]))
        nearest |= {(r[9], k + 1): o[9] for k, o in enumerate(along)}
    want = {}
    for key, others in bands.items():
        delays = [o[7] for o in others if o[7] is not None]
        want[key] = len(others), round(sum(delays) / len(delays), 6) if delays else None, sum((o[8] or 0) > 0 for o in others)
    df = spark.createDataFrame(rows, ON_ROUTE)
    found = {(r.event_id, r.band): (r.vehicles, None if r.mean_delay is None else round(r.mean_delay, 6), r.rising) for r in A.propagation(df, "run", ["event_id"]).collect()}
    assert found == want
    assert {(r.event_id, r.place): r.other_event_id for r in A.route_window(df, "run", ["event_id"]).collect()} == nearest


def test_top_fractions_and_sweep_against_sorting(spark):
    import random

    rng = random.Random(4)
    rows = [(f"v{k}", rng.randrange(3), rng.choice([0.5, rng.random()]), rng.random() < 0.7, rng.random() < 0.3, k) for k in range(500)]
    df = spark.createDataFrame(rows, RISKS + ", raw_alert boolean, actual boolean, event_id long")
    order = sorted(rows, key=lambda r: (-r[2], r[5]))
    for r in E.top_fractions(df, (0.01, 0.1, 0.5), "event_id").collect():
        top = order[: r.n]
        assert r.n == max(1, round(500 * r.fraction)) and r.least_risk == top[-1][2] and abs(r.precision - sum(x[4] for x in top) / r.n) < 1e-12
    for r in E.policy_sweep(df, "run", [0.0, 0.4, 0.5, 0.8], [0, 1, 5, 30], "event_id").collect():
        alerts = []
        for run in range(3):
            fit = [x for x in order if x[1] == run and x[3] and x[2] >= r.floor]
            alerts += fit[: r.cap] if r.cap else fit
        assert (r.tp, r.fp) == (sum(x[4] for x in alerts), sum(not x[4] for x in alerts)) and r.tp + r.fp + r.fn + r.tn == 500


def test_cooldown_against_a_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(f"v{rng.randrange(4)}", at(rng.randrange(40_000)), k) for k in range(600)]
    df = spark.createDataFrame(rows, "vehicle_id string, position_time timestamp_ntz, event_id long")
    last, want = {}, []
    for v, t in sorted({(v, t) for v, t, _ in rows}):
        if v not in last or (t - last[v]).total_seconds() >= 600:
            last[v] = t
            want.append((v, t))
    assert sorted((r.vehicle_id, r.position_time) for r in A.cooldown(df, 10).collect()) == want


def test_window_choice(spark):
    df = spark.createDataFrame([(14, 5000, 0.59, 0.5, 0.9, 0.6, 10), (30, 5000, 0.61, 0.3, 0.9, 0.6, 10)], "days int, train_rows int, precision double, recall double, top_precision double, average_precision double, event_alerts int")
    assert M.choose_window(df, 100, 0.6).first().days == 30 and M.choose_window(df, 100, 0.9).first().days == 14


def _learnable(spark):
    e = F.col("id")
    delay = (e * 7919 % 200).cast("double")
    rows = spark.range(1200).select(
        F.concat(F.lit("v"), e % 7).alias("vehicle_id"), e.alias("event_id"), F.timestamp_seconds(e * 60).cast("timestamp_ntz").alias("time"), delay.alias("delay"), F.when(e % 9 != 0, delay / 10).alias("speed"),
        F.concat(F.lit("m"), e % 3).alias("mode"), F.lit("l").alias("line"), F.concat(F.lit("r"), e % 5).alias("route_id"),
    )
    return rows.withColumns({"label": ((F.col("delay") > 120) | (F.col("mode") == "m1")).cast("int"), "target": F.col("delay") * 2 + F.when(F.col("mode") == "m1", 50).otherwise(0)})


@pytest.mark.parametrize("linear", [True, False])
def test_models_learn_and_take_what_is_missing(spark, linear):
    rows = _learnable(spark)
    train, test = rows.filter("event_id < 900"), rows.filter("event_id >= 900")
    model = M.train_classifier(train, linear, iterations=6)
    scored = M.scored(test, model)
    assert scored.columns == [*test.columns, "risk", "alert"]
    assert E.ranking(scored.withColumn("actual", F.col("label") == 1)).first().auc > 0.9 and M.area_under_roc(test, model) > 0.9
    bare = M.scored(test.select("vehicle_id", F.lit("n/a").alias("delay"), F.lit(None).cast("string").alias("mode")), model)
    assert bare.count() == 300 and bare.filter("risk IS NULL OR risk < 0 OR risk > 1").isEmpty()
    weighed = M.balanced(train).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert abs(weighed[0].w - weighed[1].w) < 1e-6
    guess = M.train_regressor(train, "target", linear, iterations=40).transform(M.prepared(test))
    error, spread = guess.agg(F.avg(F.abs(F.col("prediction") - F.col("target"))), F.stddev("target")).first()
    assert error < spread / 2


# Lake, splits, replay, quality


def test_lake_modes(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    df = spark.createDataFrame([(1, at(0), "v", date(2024, 5, 18)), (2, at(86400), "v", date(2024, 5, 19))], "event_id long, time timestamp_ntz, vehicle_id string, service_date date")
    L.write_lake(df, path)
    with pytest.raises(Exception, match="already exists"):
        L.write_lake(df, path)
    with pytest.raises(ValueError, match="missing"):
        L.require(df, ["event_id", "nothing"])


def test_compaction_sorts_within_files(spark, tmp_path):
    path = f"file://{tmp_path}/compact"
    L.compact(positions(spark, SF).select("event_id", "vehicle_id", "time", "service_date"), path)
    place = Window.partitionBy("f").orderBy("row")
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("row"))
    before = lambda c: F.lag(c).over(place)
    wrong = rows.withColumn("bad", (before("vehicle_id") > F.col("vehicle_id")) | ((before("vehicle_id") == F.col("vehicle_id")) & (before("time") < F.col("time")))).filter("bad")
    assert wrong.isEmpty() and rows.count() == 1000


def test_conversion_reports_damaged_files(spark, tmp_path):
    import gzip

    whole = gzip.compress(b"event_id,line\n1,a\n2,b\n")
    for name, data in (("a.csv.gz", whole), ("b.csv.gz", whole[:-9]), ("c.csv.gz", b"text")):
        (tmp_path / name).write_bytes(data)
    report = L.convert_files(spark, f"file://{tmp_path}/*.gz", "event_id long, line string", f"file://{tmp_path}/out")
    assert {r.path.rsplit("/", 1)[1]: r.converted for r in report.collect()} == {"a.csv.gz": True, "b.csv.gz": False, "c.csv.gz": False}
    assert sorted((r.event_id, r.source) for r in spark.read.parquet(f"file://{tmp_path}/out/rows").collect()) == [(1, "a"), (2, "a")]


def test_rolling_window_and_dates(spark):
    days = [datetime(2024, 5, 1), datetime(2024, 5, 10), datetime(2024, 5, 20, 12)]
    df = spark.createDataFrame([(d, d.date()) for d in days], "time timestamp_ntz, service_date date")
    found, before, after = X.rolling_window(df, 14, datetime(2024, 5, 20, 12))
    assert (before, after, found.count()) == (3, 2, 2)
    pick = lambda k, s: sorted(r.service_date.day for r in X.select_dates(df, k, s).collect())
    assert pick(2, "last") == [10, 20] and pick(2, "first") == [1, 10] and pick(2, "spread") == [1, 20] and pick(1, "spread") == [10] and len(pick(0, "last")) == 3
    assert X.observed_columns(df.withColumn("n", F.lit(None).cast("int")), ["time", "n", "gone"]) == ["time"]


def test_samples_and_splits(spark):
    p = positions(spark, SF)
    n = p.count()
    assert X.spread_sample(p, ["time", "vehicle_id"], 137).count() == 137 and X.spread_sample(p, ["time", "vehicle_id"], n + 1).count() == n
    rows = X.split_ordered(p, ["time", "vehicle_id"]).groupBy("split").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).collect()
    by = {r.split: r for r in rows}
    assert by["train"].n == int(n * 0.7) and by["validation"].n == int(n * 0.15) and by["train"].b < by["validation"].a and by["validation"].b < by["test"].a


def test_pages_make_up_the_window(spark):
    p = positions(spark, SF).limit(95)
    seen, cursor, more, totals = [], None, True, []
    while more:
        rows, more, cursor, total = R.page(p, 20, cursor)
        totals.append(total)
        seen += column(rows, "event_id")
    assert seen == column(p.orderBy("time", "vehicle_id"), "event_id") and totals == [95, None, None, None, None]
    plan = R.page(spark.read.parquet(f"{SF}/events.parquet").withColumnsRenamed({"ts": "time"}).withColumn("vehicle_id", F.col("event_type")), 5, (T0, "x"))[0]._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_freshness_and_worst_status(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("b", None, 1), ("c", at(0), 0)], "k string, t timestamp_ntz, n int")
    fresh = df.select("k", Q.freshness(F.col("t"), F.col("n"), F.lit(at(30)), 120).alias("status"))
    assert column(fresh.orderBy("k"), "status") == ["fresh", "missing", "missing"]
    assert df.select(Q.freshness(F.col("t"), F.col("n"), F.lit(at(300)), 120).alias("s")).first().s == "stale"
    statuses = spark.createDataFrame([(1, "fresh"), (1, "stale"), (2, "error"), (2, "missing")], "d int, status string")
    assert {r.d: r.status for r in Q.worst(statuses, ["d"]).collect()} == {1: "stale", 2: "error"}


def _alerts(spark, rows):
    return spark.createDataFrame(rows, "service_date date, vehicle_id string, position_time timestamp_ntz, risk double, alert boolean")


@pytest.mark.parametrize(("alerts", "source", "strict", "want"), [
    ([at(0)], at(0), False, {"rows": "passed", "columns": "passed", "latest_time": "passed", "freshness": "passed"}),
    ([], at(0), False, {"rows": "warning"}),
    ([], at(0), True, {"rows": "failed"}),
    ([at(-90_000)], at(0), False, {"rows": "passed", "columns": "passed", "latest_time": "passed", "freshness": "failed"}),
    ([at(-90_000)], at(-89_000), False, {"rows": "passed", "columns": "passed", "latest_time": "passed", "freshness": "warning"}),
])
def test_alert_checks(spark, alerts, source, strict, want):
    day = date(2024, 5, 18)
    runs = spark.createDataFrame([(day,)], "service_date date")
    found = Q.alert_checks(_alerts(spark, [(day, "v", t, 0.9, True) for t in alerts]), runs, F.lit(at(60)), 3600, F.lit(source), 7200, ["vehicle_id", "risk"], strict)
    assert {r.check: r.status for r in found.collect()} == want
    verdict = {r.service_date: r.verdict for r in Q.report(found).collect()}
    worst = "failed" if "failed" in want.values() else "warning" if "warning" in want.values() else "passed"
    assert verdict == {day: worst, None: worst}


def test_checks_of_missing_dates_and_columns(spark):
    p = spark.createDataFrame([(date(2024, 5, 18), "v", at(0)), (date(2024, 5, 20), "v", at(0))], "service_date date, vehicle_id string, time timestamp_ntz")
    found = {(r.service_date.day, r.check): r.status for r in Q.position_checks(p, Q.every_date(p), F.lit(at(60)), 1, 3600).collect()}
    assert {k for k, v in found.items() if v != "passed"} >= {(19, "rows"), (19, "vehicles"), (19, "partition"), (19, "max_time"), (19, "files")} and found[19, "freshness"] == "warning" and found[18, "rows"] == "passed"
    features = p.withColumn("target_delay", F.lit(None).cast("int"))
    files = spark.createDataFrame([(date(2024, 5, 18), 10)], "service_date date, length long")
    found = {(r.service_date.day, r.check): r.status for r in Q.feature_checks(features, files, Q.every_date(p), 1).collect()}
    assert found[18, "bytes"] == "passed" and found[20, "bytes"] == "failed" and found[19, "partition"] == "failed" and found[18, "labelled"] == "warning"
    missing = Q.alert_checks(_alerts(spark, [(date(2024, 5, 18), "v", at(0), 0.9, True)]), p.select("service_date").distinct(), F.lit(at(60)), 3600, F.lit(at(0)), 10, ["nothing"])
    assert {r.status for r in missing.filter("check = 'columns'").collect()} == {"failed"}


def test_status_of_scoring_runs(spark):
    rows = [("fresh", 3, at(0), at(0), None), ("error", 3, at(0), at(0), "x"), ("missing", 0, None, at(0), None), ("stale", 3, at(0), at(-9000), None), ("stale", 3, None, at(0), None), ("stale", 3, at(0), None, None)]
    df = spark.createDataFrame(rows, "want string, n int, latest timestamp_ntz, made timestamp_ntz, error string")
    status = Q.alert_status(F.col("n"), F.col("latest"), F.col("made"), F.col("error"), F.lit(at(30)), 120)
    assert all(r.want == r.status for r in df.withColumn("status", status).collect())


def test_backtest_fits_on_its_window_alone(spark):
    rows = [(k, "v", T0 + timedelta(days=d), "r", "m", d < 10) for d in range(30) for k in range(100 * d, 100 * d + 4)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, position_time timestamp_ntz, route_id string, mode string, actual boolean")
    found = {r.days: r for r in M.backtest(df, [5, 25], T0 + timedelta(days=25), M.rates(["route_id"], 1), 0.3).collect()}
    assert (found[5].train_rows, found[5].alerts, found[25].train_rows, found[25].alerts) == (20, 0, 100, 20) and found[25].precision == 0 and found[25].event_alerts == 5


def test_backtest_of_trees_tells_windows_apart(spark):
    """What says 'late' turns around after day 10: trees of the short window know it, those of the long one mostly the old rule."""
    rows = [(k, f"v{k % 7}", T0 + timedelta(days=d, minutes=k % 1000), k * 37 % 100, (k * 37 % 100 >= 50) == (d >= 10)) for d in range(15) for k in range(1000 * d, 1000 * d + (30 if d >= 10 else 90))]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, time timestamp_ntz, delay int, actual boolean")
    seen = []
    keep = lambda found: seen.append(found.columns) or found
    got = {n: {r.days: r for r in M.backtest(df, [3, 13], T0 + timedelta(days=13), M.classifier(False, 3), 0.5, "time", 15, keep, n).collect()} for n in (1, 2)}
    assert got[1] == got[2] and len(seen) == 4
    short, long = got[1][3], got[1][13]
    assert (short.train_rows, short.average_precision, short.precision) == (90, 1.0, 1.0) and short.event_alerts < short.alerts
    assert long.train_rows == 990 and long.precision < 0.5
    assert M.choose_window(M.backtest(df, [3, 13], T0 + timedelta(days=13), M.classifier(False, 3), 0.5, "time"), 50, 0.6).first().days == 3


def test_categories_without_value_take_the_most_frequent(spark):
    rows = [("bus", 1.0), ("tram", 2.0), ("tram", 3.0), ("ale's", None), ("ale's", 9.0), (None, 5.0)]
    df = M.prepared(spark.createDataFrame(rows, "mode string, delay double"), ["delay"], ["mode"])
    assert M.most_frequent(df, ["mode"]) == {"mode": "ale's"}
    stages = M.preparation(df, ["delay"], ["mode"])
    new = spark.createDataFrame([("bus", 1.0), (None, None), ("ferry", 0.0), ("tram", 2.0)], "mode string, delay double")
    assert [r.features.tolist() for r in stages.transform(M.prepared(new, ["delay"], ["mode"])).collect()] == [[1, 1], [3, 0], [0, -1], [2, 2]]


def test_stored_models(spark, tmp_path):
    rows = [(k, "v", f"m{k % 3}" if k % 7 else None, float(k % 50), int(k % 50 > 25)) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, mode string, delay double, label int")
    for linear in (True, False):
        model, place = M.train_classifier(df, linear, iterations=3), f"file://{tmp_path}/{linear}"
        M.save_model(model, place, 0.7 if linear else None, 0.3, spark)
        again, about = M.load_model(spark, place)
        assert M.threshold_of(about) == (0.7 if linear else 0.5) and M.threshold_of(about, 0.9) == 0.9
        risks = [{r.event_id: r.risk for r in M.scored(df, m).collect()} for m in (model, again)]
        assert risks[0] == risks[1] and len({*risks[0].values()}) > 1


def test_ranges_follow_the_rows(spark):
    """Nearly all rows in one hour, nearly all scores in one narrow range: no range has much more than its share."""
    rows = [(k, 1_000_000 + k * 1000 if k % 10 else k * 3_600_000_000, 0.5 + k / 1e8 if k % 10 else k / 4000, k % 3 == 0) for k in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, us long, risk double, actual boolean").withColumn("time", F.timestamp_micros("us"))
    for value in (F.unix_micros("time"), F.col("risk")):
        sizes = df.groupBy(X.range_of(value, X.edges_of(df, value))).count().select(F.max("count")).first()[0]
        assert sizes <= 2 * 4000 / X.RANGES
    places = {r.event_id: r.i for r in X.indexed(df, ["time", "event_id"]).collect()}
    assert [places[r[0]] for r in sorted(rows, key=lambda r: (r[1], r[0]))] == list(range(4000))
    ordered = sorted(rows, key=lambda r: -r[2])
    pairs, above = 0, 0
    for r in ordered:
        pairs, above = (pairs, above + 1) if r[3] else (pairs + above, above)
    assert abs(E.ranking(df).first().auc - pairs / (above * (4000 - above))) < 1e-12
    top = E.top_fractions(df, (0.01, 0.3), "event_id").collect()
    assert sorted((r.n, r.least_risk) for r in top) == [(n, ordered[n - 1][2]) for n in (40, 1200)]
    assert X.indexed(df.limit(0), ["time", "event_id"]).count() == 0


def test_scoring_stream_equals_batch(spark):
    """Micro-batches scored by a stored model, over a restart, against runs in batch with the model read again."""
    from tramline.operators import models
    from tramline.plans import streams

    found = sorted(map(tuple, streams.stream_model_scores(spark, SF).collect()))
    model, about = models.load_model(spark, streams.stored_model(spark, SF)[0])
    p = streams.inside(spark, SF)
    us = F.unix_micros(F.col("time").cast("timestamp"))
    least, most = streams.positions(spark, SF).agg(F.min(us), F.max(us)).first()
    want = []
    for k in range(2):
        upto = streams.positions(spark, SF).filter(F.least(F.lit(1), F.floor((us - least) * 2 / (most - least))) <= k)
        now = upto.agg(F.max("time")).first()[0]
        want += streams.scoring_run(p, now, lambda rows: models.scored(rows, model).drop("alert"), models.threshold_of(about)).collect()
    assert found == sorted(map(tuple, want)) and len(found) > 20


def test_messages_and_feed(spark):
    messages = spark.createDataFrame([('{"id": "v", "lat": 50.1, "lon": 14.4, "delay": 12.9}',), ("junk",), ("[1]",), ('{"id": "v", "lat": 50.1}',)], "value string")
    row = L.parse_messages(messages).collect()
    assert len(row) == 1 and (row[0].delay, row[0].speed, row[0].line) == (12, 0, "unknown")
    assert L.parse_messages(messages, zero=False).first().speed is None
    feed = spark.createDataFrame([('{"features": [{"geometry": {"coordinates": [14.4, 50.1]}, "properties": {"vehicle_id": "", "trip": {"vehicle_registration_number": "7", "gtfs": {"route_id": " L1 ", "route_type": 11}}, "last_position": {"delay": {"actual": 60}}}}, 5]}', "now")], "value string, ingest_ts string")
    row = L.parse_feed(feed).collect()
    assert [(r.vehicle_id, r.line, r.delay, r.mode, r.route_id, r.observation_ts) for r in row] == [("7", " L1 ", 60, "trolleybus", "L1", "now")]


@pytest.mark.parametrize(("props", "want"), [
    ('"vehicle_id": 0, "trip": {"vehicle_registration_number": 12}', ("12", "unknown", 0, None, None)),
    ('"vehicle_id": [], "trip": {"gtfs": {"trip_id": "t"}}', ("t", "unknown", 0, None, None)),
    ('"vehicle_id": "v", "route_short_name": 22, "trip": {"gtfs": {"route_short_name": null, "route_id": "L9"}}', ("v", "L9", 0, None, "L9")),
    ('"vehicle_id": "v", "route_short_name": {}, "trip": {"gtfs": {"route_id": 9}, "origin_route_name": "o"}', ("v", "o", 0, None, None)),
    ('"vehicle_id": "v", "delay": "90", "last_position": {"delay": {"actual": 30}, "speed": "4"}', ("v", "unknown", 30, None, None)),
    ('"vehicle_id": "v", "delay": false, "last_position": {"delay": {"actual": 30}, "speed": 4.7}', ("v", "unknown", 0, 4, None)),
    ('"vehicle_id": "v", "delay": null, "last_position": [1]', ("v", "unknown", 0, None, None)),
    ('"vehicle_id": "v", "last_position": {"delay": 30}', None), ('"vehicle_id": "v", "trip": "t"', None), ('"vehicle_id": "v", "trip": {"gtfs": 1}', None), ('"vehicle_id": ""', None), ('"vehicle_id": "v", "trip": []', ("v", "unknown", 0, None, None)),
])
def test_feed_values_of_any_type(spark, props, want):
    feed = spark.createDataFrame([(f'{{"features": [{{"geometry": {{"coordinates": ["14.4", 50.1]}}, "properties": {{{props}}}}}]}}', "now")], "value string, ingest_ts string")
    assert [(r.vehicle_id, r.line, r.delay, r.speed, r.route_id, r.lon) for r in L.parse_feed(feed).collect()] == ([(*want, 14.4)] if want else [])


# Streams


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, files):
    from tramline.plans import streams

    V.keep_state_in_rocksdb(spark)
    p = streams.points_of(spark, SF)
    out = streams.scratch(spark, "t")
    streams.fed(p, files, "arrival_seq", lambda stream: V.run_to_end(V.trajectory_stream(stream, V.Segments(86_400.0, 2.0, 600, 1200.0, 21_600.0)), out, f"{out}-c"))
    from tramline.plans.trajectories import trajectory_of

    count = lambda df: sorted((r.point_state, r.gap_reason or "", r["count"]) for r in df.groupBy("point_state", "gap_reason").count().collect())
    assert count(spark.read.parquet(out)) == count(trajectory_of(spark, SF))
    trails = streams.scratch(spark, "t")
    streams.fed(p, files, "arrival_seq", lambda stream: V.score_batches(V.trail_stream(stream, V.Trails(None)), lambda df: df, trails, f"{trails}-c"))
    last = spark.read.parquet(trails).groupBy("vehicle_id").agg(F.max_by("last_ms", "batch").alias("ms"), F.max_by("points", "batch").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted((r.vehicle_id, r.last_ms, r.points) for r in V.trails(p).collect())


def test_silent_vehicles_expire(spark, tmp_path):
    """Timers end lives while the stream goes on, also after a restart; a point between two open lives joins them."""
    V.keep_state_in_rocksdb(spark)
    slices = [[("a", 0), ("a", 60), ("b", 30), ("d", 0), ("d", 150)], [("a", 400), ("d", 90)], [("c", 900)]]
    schema, want = "vehicle_id string, time timestamp, lat double, lon double", []
    for k, part in enumerate(slices):
        df = spark.createDataFrame([(v, at(s)) for v, s in part], "vehicle_id string, t timestamp_ntz").select("vehicle_id", F.col("t").cast("timestamp").alias("time"), F.lit(50.0 + k).alias("lat"), F.lit(14.0).alias("lon"))
        df.write.mode("append").parquet(f"file://{tmp_path}/rows")
        V.run_to_end(V.expired(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/rows"), 120_000, "200 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/progress")
        found = spark.read.schema(V.Lives.OUTPUT).parquet(f"file://{tmp_path}/out").collect()
        want += [[], [("a", 2, 50.0), ("b", 1, 50.0)], [("a", 1, 51.0), ("d", 3, 50.0)]][k]
        assert sorted((r.vehicle_id, r.points, r.last_lat) for r in found) == sorted(want)


def test_lives():
    import random

    rng = random.Random(3)
    for _ in range(200):
        points = [rng.randrange(1000) for _ in range(rng.randrange(1, 25))]
        lives: list = []
        for us in points:
            lives = V.live_step(lives, us, 0.0, 0.0, 40)
        runs: list = []
        for us in sorted(points):
            if runs and us < runs[-1][-1] + 40:
                runs[-1].append(us)
            else:
                runs.append([us])
        assert [x[:3] for x in lives] == [(r[0], r[-1], len(r)) for r in runs]


def test_trail_rules():
    a = V.trail_step([], 50.0, 14.4, 0)
    assert V.trail_step(a, 60.0, 14.4, 1_000_000) == a and V.trail_step(a, 50.0000001, 14.4, 1_000_000) == a
    assert len(V.trail_step(a, 50.0001, 14.4, 1_000_000)) == 2 and len(V.trail_step(a, 50.1, 14.4, 1_000_000)) == 1
    assert V.trail_step(a, 50.0001, 14.4, 0)[-1][2] in (0, 1)
    trail = a
    for k in range(50):
        trail = V.trail_step(trail, 50.0 + (k + 1) * 0.0001, 14.4, (k + 1) * 1_000_000)
    assert len(trail) == 30


# Entry


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 537
    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and len(names) > 100


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_folders(tmp_path, left):
    top = Path(__file__).resolve().parent.parent
    gone = {"llm", "corpus_pipeline.py", ".git", "__pycache__"} - set(left)
    shutil.copytree(top, tmp_path / "copy", ignore=lambda _, names: gone.intersection(names))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_a_vehicle_has_one_timer():
    """However many lives are open; what the watermark has passed ends at once, and the next life gets the timer."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    held, timers = [], set()
    lives = V.Lives(1000)
    lives.handle = SimpleNamespace(registerTimer=timers.add, deleteTimer=timers.remove)
    lives.lives = SimpleNamespace(get=lambda: list(held), put=lambda new: held.__setitem__(slice(None), new), clear=held.clear)
    rows = lambda *at: iter([Row(us=1_000_000 * s, lat=50.0, lon=14.0) for s in at])
    assert list(lives.handleInputRows(("u",), rows(*range(20, 200, 10)), None)) == [] and len(held) == 18 and timers == {21_000}
    list(lives.handleInputRows(("u",), rows(10), None))
    assert timers == {11_000}
    timers.clear()
    found = list(lives.handleExpiredTimer(("u",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 51_000), None))
    assert [r.last_us for r in found] == [1_000_000 * s for s in (10, 20, 30, 40, 50)] and timers == {61_000} and len(held) == 14


def test_exports_are_written_without_a_sort_and_in_many_files(spark, monkeypatch):
    """The seven files hold a remainder each, without folders, which would need a sort; converted files grow with the rows."""
    from tramline.plans import lake

    folders = []
    monkeypatch.setattr(lake, "scratch", lambda *a, made=lake.scratch: folders.append(made(*a)) or folders[-1])
    lake.csv_first_files(spark, "/root/testdata/sf0.001")
    files = sorted(r.path for r in L.files_of(spark, folders[0]).collect() if r.path.endswith(".csv.gz"))
    parts = [{int(r.speed) % 7 for r in spark.read.option("header", True).csv(f).select("speed").collect()} for f in files]
    assert parts == [{k} for k in range(7)] and not any("part=" in f for f in files)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        lake._converted(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.path.endswith(".csv.gz") for r in L.files_of(spark, f"{folders[1]}/csv").collect()) == 9


def test_feed_features_are_parsed_once(spark):
    """Each feature's text is parsed at one place of the plan: no filter makes costly columns a second time (F7, F9)."""
    from tramline.plans import lake

    for name in ("feed_normalisation", "feed_mixed_types"):
        plan = getattr(lake, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, name


def test_models_and_scoring_carry_only_what_they_read(spark):
    """Rows of models and the context of scoring leave out columns that nothing reads, and the rows stay the same (F6)."""
    from tramline.plans import features, streams

    rows = streams.labelled(spark, SF)
    assert not {"trip_id", "origin_timestamp", "lat_lag_1"} & set(rows.columns)
    whole = features.delay_features(spark, SF).dropna(subset=["target_delay", "delay"]).select(*streams.MODEL_COLUMNS)
    assert sorted(map(str, rows.select(*streams.MODEL_COLUMNS).collect())) == sorted(map(str, whole.collect()))
    plan = streams.features_of(streams.samples(spark, SF), columns=streams.MODEL_COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    assert "trip_id" not in plan and "speed_lag_3" not in plan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_a_split_moves_no_row(spark, kind):
    """Parts hold the rows that a sort gives, bounds inside one hour and between equal times included, and nothing is shuffled (F8, F10, F15)."""
    rows = [(k, f"v{k * 7 % 10}", T0 + timedelta(seconds=k // 10)) for k in range(1000)] + [(5000 + k, "w", T0 + timedelta(days=k)) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, time timestamp_ntz").withColumn("time", F.col("time").cast(kind))
    parts = (("a", 0.333), ("b", 0.2), ("none", 0.0), ("c", 0.4))
    split = X.split_ordered(df, ["time", "vehicle_id"], parts)
    n, ordered = len(rows), [r[0] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    a, b = int(n * 0.333), int(n * 0.333) + int(n * 0.2)
    want = dict(zip(ordered, ["a"] * a + ["b"] * (b - a) + ["c"] * (n - b), strict=True))
    assert {r.event_id: r.split for r in split.collect()} == want
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    assert {r.split for r in X.split_ordered(df.limit(1), ["time", "vehicle_id"]).collect()} == {"test"}
    assert X.split_ordered(df.limit(0), ["time", "vehicle_id"]).count() == 0


def test_training_counts_its_rows_once(spark, monkeypatch):
    """One pass gives all counts, values and medians' columns before the stages fit, and trees keep assembled rows until they are fit (F8, F10, F15)."""
    firsts, kept = [], []
    first, persist = type(spark.range(1)).first, type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: firsts.append(df.columns) or first(df))
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    M.train_classifier(_learnable(spark), iterations=2)
    assert len(firsts) == 1 and len(kept) == 1
    assert kept[0].columns == ["features", "label", "weight"] and not kept[0].is_cached


def test_common_values_are_read_once(spark):
    """Rare values become unknown by a list, not by joins that each later pass would count again (F10, F15)."""
    rows = [("a", "x")] * 3 + [("b", None)] * 2 + [("c", "z"), (None, "y")]
    found = M.with_common_values(spark.createDataFrame(rows, "mode string, line string"), ["mode", "line"], 2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "x")] * 3 + [("b", None)] * 2 + [("unknown", "unknown"), (None, "y")], key=str)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([(None,)], "mode string")
    assert [r.mode for r in M.with_common_values(none, ["mode"]).collect()] == [None]


def test_feed_parsing_stays_small_enough_for_the_jit(spark):
    """The JVM never compiles a method of more than 8,000 bytes: the parser's steps must not melt into one (F9)."""
    from contextlib import redirect_stdout
    from io import StringIO

    from tramline.plans import lake

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("feed_normalisation", "feed_mixed_types"):
            with redirect_stdout(StringIO()) as shown:
                getattr(lake, name)(spark, SF).explain(mode="codegen")
            sizes = [int(part.split(";")[0]) for part in shown.getvalue().split("maxMethodCodeSize:")[1:]]
            assert sizes and max(sizes) < 8000, (name, sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
