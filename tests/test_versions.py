"""Lakes whose dates change together: refresh, retention, failures between steps, two writers, sweeping."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tramline.sources import versions as V

SCHEMA = "event_id long, time timestamp_ntz, vehicle_id string, service_date date"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, datetime(2024, 5, day, hour), v, date(2024, 5, day)) for i, day, hour, v in rows], SCHEMA)


def seen(spark, path, number=None):
    return sorted((r.event_id, r.vehicle_id, r.service_date.day) for r in V.read_versions(spark, path, number).collect())


@pytest.fixture
def lake(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    V.refresh(rows_of(spark, (1, 18, 8, "v"), (2, 19, 8, "v"), (3, 19, 9, "v")), path)
    return path


def test_dates_are_replaced(spark, lake):
    V.refresh(rows_of(spark, (4, 19, 8, "w")), lake)
    assert seen(spark, lake) == [(1, "v", 18), (4, "w", 19)]
    assert seen(spark, lake, 1) == [(1, "v", 18), (2, "v", 19), (3, "v", 19)]
    with pytest.raises(ValueError, match="no partitions"):
        V.refresh(rows_of(spark).limit(0), lake)


def test_rows_with_a_key_move_and_empty_dates_go(spark, lake):
    V.refresh(rows_of(spark, (1, 20, 8, "w"), (2, 20, 8, "w")), lake, ["event_id"])
    assert seen(spark, lake) == [(1, "w", 20), (2, "w", 20), (3, "v", 19)]
    assert set(V.current(spark, lake).dates) == {"2024-05-19", "2024-05-20"}


def test_merge_into_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/new"
    with pytest.raises(ValueError, match="nothing was written"):
        V.read_versions(spark, path)
    V.refresh(rows_of(spark, (1, 18, 8, "v")), path, ["event_id"])
    assert seen(spark, path) == [(1, "v", 18)]


@pytest.mark.parametrize("step", ["_add", "_switch"])
@pytest.mark.parametrize("change", ["refresh", "merge", "expire"])
def test_a_failure_between_steps_leaves_the_old_rows(spark, lake, monkeypatch, step, change):
    run = {
        "refresh": lambda: V.refresh(rows_of(spark, (4, 19, 8, "w")), lake),
        "merge": lambda: V.refresh(rows_of(spark, (1, 19, 8, "w")), lake, ["event_id"]),
        "expire": lambda: V.expire(spark, lake, "time", datetime(2024, 5, 19, 10), 1),
    }[change]
    old, real = seen(spark, lake), getattr(V, step)

    def fails(*args):
        if step == "_add":
            real(*args)  # the folders are there, the caller never hears of them
        raise OSError("killed")

    with monkeypatch.context() as m, pytest.raises(OSError, match="killed"):
        m.setattr(V, step, fails)
        run()
    assert seen(spark, lake) == old
    run()
    assert seen(spark, lake) == {"refresh": [(1, "v", 18), (4, "w", 19)], "merge": [(1, "w", 19), (2, "v", 19), (3, "v", 19)], "expire": [(3, "v", 19)]}[change]


def test_the_second_of_two_writers_hears_of_the_first(spark, lake, monkeypatch):
    base = V.current(spark, lake)
    V.refresh(rows_of(spark, (4, 18, 8, "first")), lake)
    real = V.current
    with monkeypatch.context() as m, pytest.raises(V.Conflict):
        m.setattr(V, "current", lambda spark, path, number=None: base if number is None else real(spark, path, number))
        V.refresh(rows_of(spark, (5, 18, 8, "second")), lake)
    assert seen(spark, lake) == [(2, "v", 19), (3, "v", 19), (4, "first", 18)]


def test_everything_may_expire(spark, lake):
    V.expire(spark, lake, "time", datetime(2024, 7, 1), 1)
    assert seen(spark, lake) == [] and V.read_versions(spark, lake).columns == ["event_id", "time", "vehicle_id", "service_date"]


def test_rows_without_a_date_stay(spark, lake):
    V.refresh(rows_of(spark, (9, 18, 8, "none")).withColumn("service_date", F.lit(None).cast("date")), lake)
    V.expire(spark, lake, "time", datetime(2024, 7, 1), 1)
    assert [(r.event_id, r.service_date) for r in V.read_versions(spark, lake).collect()] == [(9, None)]


def test_new_and_missing_columns(spark, lake):
    V.refresh(rows_of(spark, (4, 19, 8, "w")).drop("vehicle_id").withColumn("speed", F.lit(2.5)), lake)
    found = {r.event_id: (r.vehicle_id, r.speed) for r in V.read_versions(spark, lake).collect()}
    assert found == {1: ("v", None), 4: (None, 2.5)}


def test_sweep_keeps_what_the_last_lists_name(spark, lake):
    for k in range(3):
        V.refresh(rows_of(spark, (10 + k, 19, 8, "w")), lake)
    assert V.sweep(spark, lake, 2) == 0  # all folders are younger than a day
    for k in range(2):
        V.refresh(rows_of(spark, (20 + k, 19, 8, "w")), lake)
    assert V.sweep(spark, lake, 2, 0) == 4
    assert seen(spark, lake) == [(1, "v", 18), (21, "w", 19)] and seen(spark, lake, 5) == [(1, "v", 18), (20, "w", 19)]


def test_dates_are_pruned(spark, lake):
    plan = V.read_versions(spark, lake).filter(F.col("service_date") == date(2024, 5, 19))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(service_date" in plan
