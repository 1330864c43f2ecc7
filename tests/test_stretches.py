"""Stretches of equal minutes stand for their minutes, and dense rows stay with their subject."""

import numpy as np
from pyspark.sql import functions as F

from diurna import queries as library
from diurna.operators import curate, period, sleep
from diurna.sources import events
from tests.conftest import SF


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_stretches_are_the_readings(spark):
    dense, runs = events.readings(spark, SF, 60), events.reading_runs(spark, SF, 60)
    again = sleep.each_minute(runs, 60).select("id", "t", "activity")
    assert again.exceptAll(dense).count() == dense.exceptAll(again).count() == 0
    assert runs.count() * 4 < dense.count()


def test_stretches_sleep_as_minutes_do(spark):
    minutes = sleep.marked_minutes(curate.with_moving(events.readings(spark, SF, 60)), library.HOURLY, 60)
    runs = sleep.marked_minutes(curate.with_moving(events.reading_runs(spark, SF, 60)), library.HOURLY, 60)
    a, b = sleep.bouts(minutes), sleep.bouts(runs)
    assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    a, b = sleep.minutes(minutes), sleep.each_minute(sleep.minutes(runs), 60).select(sleep.minutes(minutes).columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_a_gap_in_two_stretches_is_one_gap(spark):
    rows = [(1, 0, 9, 0), (1, 10, 11, None), (1, 12, 13, None), (1, 14, 20, 0), (2, 0, 9, 0), (2, 10, 11, None), (2, 12, 14, None), (2, 15, 20, 0)]
    found = sleep.bouts(sleep.marked_minutes(spark.createDataFrame(rows, "id int, t int, t_end int, moving int")))
    assert sorted(tuple(r)[2:4] + (r["id"],) for r in found.collect()) == [(0, 9, 2), (0, 20, 1), (15, 20, 2)]


def test_minutes_outside_of_bouts_have_no_state(spark):
    bouts = spark.createDataFrame([(1, 1, 10, 14, 4.0, "short")], "id int, bout int, start_t int, end_t int, duration_min double, state string")
    asleep = spark.createDataFrame([(1, 9, 1), (1, 10, 1), (1, 12, 0), (1, 14, 1), (1, 15, 1)], "id int, t int, sleep int")
    assert sorted(sleep.minutes_of_bouts(bouts, asleep).select("t", "state").collect()) == [(9, None), (10, "short"), (14, "short"), (15, None)]


def test_only_the_log_is_shuffled(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many subjects
    try:
        for name in ("acf_lags", "ls_fixed_grid", "linear_detrend", "zscore", "minutes_of_bouts", "minute_sleep"):
            assert exchanges(library.queries()[name](spark, SF)) <= 2, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lags_of_a_record_with_a_hole(spark):
    x = {0: 1.0, 60: 5.0, 120: None, 240: 2.0, 300: 8.0}
    found = period.correlogram(spark.createDataFrame([(1, t, v) for t, v in x.items()], "id int, t int, activity double"), max_hours=6)
    y = {t: 0.0 if v is None else v - 4.0 for t, v in x.items()}
    want = {lag: sum(y[t] * y[t + lag] for t in y if t + lag in y) / sum(v * v for v in y.values()) for lag in range(0, 361, 60) if any(t + lag in y for t in y)}
    assert {round(r["lag_hours"] * 60): round(r["r"], 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_spectrum_of_a_still_record_is_null(spark):
    rows = [(1, t, 3.0) for t in range(0, 6000, 60)] + [(2, t, float(np.sin(2 * np.pi * t / 1440))) for t in range(0, 14400, 60)]
    found = {(r["id"], r["period"]): r["power"] for r in period.spectrum(spark.createDataFrame(rows, "id int, t int, activity double"), [20.0, 24.0]).collect()}
    assert found[1, 24.0] is None and round(found[2, 24.0], 6) == 1.0 and found[2, 20.0] < 0.5
