"""Estimators, models and imports against known answers."""

import datetime
import math

import numpy as np
import pytest

from diurna import params
from diurna.functions import numeric as N
from diurna.functions import scalars as S
from diurna.functions import tests_math as M
from diurna.operators import bins, curate, groups, hmm, period, phase, phase_shift, runs, sleep, stats
from diurna.sources import monitor
from pyspark.sql import functions as F


@pytest.mark.parametrize("hours", [18.0, 24.0, 28.0])
def test_period_of_a_sinusoid(hours):
    t = np.arange(0, 9 * 1440, 30.0)
    x = 5 + 4 * np.sin(2 * np.pi * t / 60 / hours) + np.random.default_rng(1).normal(0, 0.3, len(t))
    assert N.lomb_scargle(t / 60, x, 16, 36)["period"] == pytest.approx(hours, rel=0.02)
    assert N.lomb_scargle(t / 60, x, 16, 36)["fap"] < 1e-6
    # The second day's window holds the third peak of 18 h, whose half is a trough: that lag is not halved.
    assert N.autocorrelation_period(x, 30, 16, 36)["period"] == pytest.approx({18.0: 54.0}.get(hours, hours), rel=0.03)
    assert N.mesa(x, 0.5, 16, 36)["period"] == pytest.approx(hours, rel=0.05)
    found = N.wavelet_summary(x, 30, 16, 36)
    assert found["period"] == pytest.approx(hours, rel=0.03) and found["strength"] > 2


def test_noise_is_not_rhythmic():
    x = np.random.default_rng(3).normal(0, 1, 432)
    assert N.lomb_scargle(np.arange(432) / 2.0, x, 16, 36)["fap"] > 1e-3
    assert N.lomb_scargle(np.arange(9.0), np.ones(9), 16, 36) is None


def test_lowpass_keeps_slow_and_removes_fast():
    t = np.arange(0, 5 * 48) / 2.0
    slow, fast = np.sin(2 * np.pi * t / 24), np.sin(2 * np.pi * t / 2)
    out = N.lowpass(slow + fast, 8.0, 2.0)
    assert np.abs(out - slow)[20:-20].max() < 0.1


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0], float)
    assert N.find_peaks(x).tolist() == [1, 4, 7]
    assert N.find_peaks(x, distance=4).tolist() == [4]
    assert N.find_peaks(x, prominence=1.5).tolist() == [4, 7]


def test_tails():
    assert M.t_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert M.f_p(4.0, 2, 12) == pytest.approx(0.0466, abs=1e-3)
    assert M.chi2_p(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert M.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert M.studentized_range_p(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3)
    assert M.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert M.letters(3, {(0, 2)}) == ["a", "ab", "b"]


def minute_rows(spark, runs_):
    moving = [v for n, v in runs_ for _ in range(n)]
    return spark.createDataFrame([("a", t, v) for t, v in enumerate(moving)], "id string, t int, moving int")


def test_bouts_at_their_bounds(spark):
    for still, duration, state in ((4, None, None), (5, None, None), (6, 5.0, "short"), (31, 30.0, "intermediate"), (61, 60.0, "long")):
        rows = minute_rows(spark, [(20, 1), (still, 0), (20, 1)])
        found = sleep.bouts(sleep.marked_minutes(rows)).collect()
        assert [(b.duration_min, b.state) for b in found] == ([] if state is None else [(duration, state)])


def test_short_gaps_are_bridged_between_equal_values(spark):
    rows = minute_rows(spark, [(5, 0), (4, None), (5, 0), (5, None), (5, 0), (3, None), (4, 1)])
    out = [r.f for r in runs.fill_short_gaps(rows, "moving", "f").orderBy("t").collect()]
    assert out == [0] * 14 + [None] * 5 + [0] * 5 + [None] * 3 + [1] * 4


def test_death_ends_a_record(spark):
    rng = np.random.default_rng(0)
    alive = (rng.random(6 * 1440) < 0.3).astype(int).tolist() + [0] * 1440
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(alive)], "id string, t int, activity double")
    last = curate.curate(rows).agg(F.max("t")).first()[0]
    assert 6 * 1440 - 60 <= last <= 6 * 1440 + 720
    assert curate.curation_counts(curate.alive(rows)).first().asDict() == {"subjects": 1, "kept": 1, "removed": 0, "trimmed": 1, "unchanged": 0}


def test_phase_policy():
    assert phase.resolve_phase("auto", "period") == "DD" and phase.resolve_phase("auto", "period", False) == "both"
    with pytest.raises(phase.PhaseError):
        phase.resolve_phase("both", "period")


def test_planted_shift_is_found(spark):
    markers = [("a", d, 1440.0 * d + 600 + (0 if d < 5 else 90)) for d in range(11)]
    found = spark.createDataFrame(markers, "id string, day int, minute double")
    subjects = spark.createDataFrame([("a", "g", 5 * 1440 + 840), ("b", "g", None)], "id string, grp string, pulse_minute int")
    out = {r.id: r for r in phase_shift.shifts(found, subjects).collect()}
    assert out["a"].status == "ok" and out["a"].phase_shift_hours == pytest.approx(1.5)
    assert out["b"].status == "no_pulse"


def test_hidden_chain_is_recovered():
    rng = np.random.default_rng(5)
    a, state, x, truth = np.array([[0.95, 0.05], [0.05, 0.95]]), 0, [], []
    for _ in range(1500):
        state = rng.choice(2, p=a[state])
        truth.append(state)
        x.append(0 if rng.random() < (0.9 if state == 0 else 0.05) else rng.poisson((1.0, 12.0)[state]))
    settings = params.Hmm(n_states=2, n_restarts=1, n_iter=60)
    m = hmm.fit([np.array(x, float)], settings, 0)
    p = dict(zip(hmm.NAMES["zip"], map(np.array, m["params"])))
    path = hmm.viterbi(hmm.log_emission(np.array(x, float), p, "zip"), np.array(m["start"]), np.array(m["trans"]).reshape(2, 2))
    assert (path == truth).mean() > 0.95 and p["rate"][1] == pytest.approx(12, rel=0.15)


def test_fits_over_many_tasks_are_those_of_one_place(spark):
    rng = np.random.default_rng(9)
    series = {i: np.where(rng.random(120) < 0.5, 0, rng.poisson(6, 120)).astype(float) for i in range(6)}
    rows = [(i, t, float(v)) for i, x in series.items() for t, v in enumerate(x)]
    seen = spark.createDataFrame(rows, "id int, t int, x double").repartition(4)
    who = spark.createDataFrame([(i, "g" if i < 5 else "h") for i in series], "id int, grp string")
    settings = params.Hmm(n_states=2, n_restarts=2, n_iter=6)
    found = {r.grp: r for r in hmm.train(seen, who, settings).collect()}
    for grp, ids in (("g", range(5)), ("h", [5])):
        wanted = max((hmm.fit([series[i] for i in ids], settings, n) for n in range(2)), key=lambda f: f["ll"])
        assert found[grp].ll == pytest.approx(wanted["ll"], rel=1e-9) and found[grp].trans == pytest.approx(wanted["trans"], rel=1e-6)
    alone = {r.grp: r for r in hmm.train_subjects(seen, who, settings).collect()}
    assert alone["h"].ll == pytest.approx(found["h"].ll, rel=1e-9)
    chosen = hmm.select_states(seen, who, [2], settings, folds=2).collect()
    assert {r.n_states for r in chosen} == {2} and sum(r.n for r in chosen) == 720 and all(r.ll_per_obs < 0 for r in chosen)


def test_group_tests(spark):
    rows = [(g, float(v)) for g, vs in {"a": [1, 2, 3, 4, 5], "b": [11, 12, 13, 14, 15], "c": [1, 2, 3, 5, 9], "d": [1]}.items() for v in vs]
    frame = spark.createDataFrame(rows, "grp string, v double")
    welch = stats.compare(frame, "v").collect()
    assert welch[0].test == "Welch ANOVA" and welch[0].p < 0.01
    marks = {r.comparison: r.letters for r in welch if r.test == "letters"}
    assert set(marks["a"]) & set(marks["c"]) and not set(marks["a"]) & set(marks["b"])
    assert stats.compare(frame.where("grp IN ('a', 'b')"), "v", "rank").first().test == "Mann-Whitney"


def test_monitor_files(spark, tmp_path):
    lines = []
    for i, (minute, second, status) in enumerate([(0, 0, 1), (1, 0, 51), (1, 0, 1), (2, 31, 1), (3, 0, 50)]):
        lines.append("\t".join([str(i), "8 Jan 25", f"09:0{minute}:{second:02}", str(status), *["0"] * 6, str(i), str(10 * i)]))
    (tmp_path / "Monitor07.txt").write_text("\n".join(lines))
    rows = monitor.read_monitor(spark, str(tmp_path), 2)
    fixed = monitor.resolve_status(rows)
    got = {(r.channel, r.ts.minute): r.value for r in fixed.collect()}
    assert got[1, 0] == 0 and got[1, 1] == 2 and got[2, 3] == 30 and (1, 2) not in got
    assert {r.monitor for r in rows.select("monitor").distinct().collect()} == {"7"}
    assert {r.status: r.n for r in monitor.status_counts(rows).collect()} == {1: 3, 50: 1, 51: 1}
    sheet = spark.createDataFrame([("7", "2025-01-08 09:00:00", "2025-01-08 09:03:00", "wt", "1..2")], "Monitor string, start_datetime string, stop_datetime string, genotype string, region_id string")
    monitor.check_metadata(sheet)
    with pytest.raises(monitor.MetadataError, match="missing_columns"):
        monitor.check_metadata(sheet.drop("genotype"))
    with pytest.raises(monitor.MetadataError, match="stop_before_start"):
        monitor.check_metadata(sheet.withColumn("stop_datetime", F.lit("2025-01-08 08:00:00")))
    tubes = monitor.expand_metadata(sheet).select("id", F.col("Monitor").alias("monitor"), "region", F.col("start_datetime").cast("timestamp_ntz").alias("start_ts"), F.col("stop_datetime").cast("timestamp_ntz").alias("stop_ts"))
    assert monitor.check_windows(tubes, rows).count() == 0
    aligned = monitor.align(fixed, tubes)
    assert aligned.where("id = '20250108_7_1'").count() == 4 and aligned.where("activity IS NOT NULL").count() == 6


def test_scalars(spark):
    rows = spark.createDataFrame([("ZT15",), ("zt 15",), ("15",), ("",), (None,), ("noon",)], "x string")
    assert [r[0] for r in rows.select(S.parse_zt_hour("x")).collect()] == [15.0, 15.0, 15.0, None, None, None]
    assert [r[0] for r in rows.select(F.coalesce(S.unreadable_zt("x"), F.lit(False))).collect()] == [False] * 5 + [True]
    one = spark.range(1)
    assert one.select(S.number_ranges(F.array(*map(F.lit, [3, 1, 2, 5])))).first()[0] == "1-3, 5"
    assert one.select(S.wrap_hours(F.lit(13.0)), S.wrap_hours(F.lit(-12.0))).first()[:] == (-11.0, -12.0)
    assert one.select(S.stars(F.lit(0.004)), S.format_p(F.lit(0.0004)), S.pulse_label(F.lit(14.5))).first()[:] == ("**", "p < 0.001", "ZT14.5")
    assert one.select(S.safe_name(F.lit(" a/b c "))).first()[0] == "a_b_c"
    levels = groups.order_levels(spark.createDataFrame([("ZT14",), ("ZT2",), ("",)], "v string"), "v").orderBy("ord").collect()
    assert [r.v for r in levels] == ["ZT2", "ZT14", ""]


def test_settings_round_trip_and_reject_unknown_keys():
    own = params.Sleep(threshold_seconds=600)
    assert params.Sleep.from_rows(own.rows()) == own
    with pytest.raises(ValueError, match="unknown settings"):
        params.Sleep.of({"threshold": 1})
    with pytest.raises(ValueError):
        params.Sleep(threshold_seconds=10)


def test_ultradian_amplitude_of_a_planted_rhythm(spark):
    from diurna.operators import ultradian

    t = np.arange(0, 6 * 1440, 30)
    x = ((np.sin(2 * np.pi * t / 150) > 0) & (t % 1440 < 720)).astype(int)
    rows = spark.createDataFrame([("a", "standard", int(m), int(v)) for m, v in zip(t, x)], "id string, state string, t int, asleep int")
    found = ultradian.surfaces(rows, step=30, bin_minutes=30, lo=2, hi=32, voices=8)
    series = ultradian.amplitude(found)
    out = ultradian.amplitude_rhythm(series, 30).first()
    assert out.period == pytest.approx(24, rel=0.1) and out.fap < 1e-3
    assert ultradian.chi2_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)


def test_panels_repeat_their_reference(spark):
    from diurna.operators import facets

    rows = [(k, g, z) for k, (g, z) in enumerate([("wt", "ZT2"), ("wt", "ZT14"), ("mut", "ZT2"), ("mut", "ZT14"), ("mut", "none")])]
    subjects = spark.createDataFrame(rows, "id int, genotype string, pulse string")
    found = facets.panels(subjects, facets.Facets(("pulse",), ("genotype",), {"pulse": ["ZT2", "ZT14"]}, {"pulse": "none"})).orderBy("panel_ord", "series_ord").collect()
    assert [(r.panel, r.series, r.is_reference) for r in found] == [("mut", "none", True), ("mut", "ZT2", False), ("mut", "ZT14", False), ("wt", "none", True), ("wt", "ZT2", False), ("wt", "ZT14", False)]


def test_scopes_and_controls(spark):
    seen = spark.createDataFrame([("a", t, 1.0) for t in range(2880)] + [("b", t, 0.0) for t in range(30)], "id string, t int, x double")
    who = spark.createDataFrame([("a", "g"), ("b", "g")], "id string, grp string")
    assert {r.grp for r in hmm.scoped(seen, who, "subject_day")[1].collect()} == {"a/0", "a/1"}
    assert {r.grp for r in hmm.scoped(seen, who, "pooled")[1].collect()} == {"all"}
    values = spark.createDataFrame([(g, c, float(v)) for g, c, vs in (("t", "c", [5, 6, 7]), ("c", None, [1, 2, 3])) for v in vs], "grp string, control_grp string, v double")
    out = stats.versus_control(values, "v").collect()
    assert len(out) == 1 and out[0].p_holm == out[0].p < 0.02


def test_holm_over_all_rows_is_no_single_task(spark):
    from diurna.operators import stats

    values = [((k * 7919) % 401 + 1) / 90000.0 for k in range(1000)] + [None, None]
    found = stats.holm_adjusted(spark.createDataFrame(list(enumerate(values)), "id int, p double"))
    known, top, wanted = sorted((v, i) for i, v in enumerate(values) if v is not None), 0.0, {1000: None, 1001: None}
    for rank, (v, i) in enumerate(known):
        top = max(top, min(1.0, v * (len(known) - rank)))
        wanted[i] = top
    assert {r.id: r.p_holm for r in found.collect()} == wanted
    assert "SinglePartition" not in found._jdf.queryExecution().toString()


def test_pulse_columns_name_the_rows_at_fault(spark):
    shape = "row int, pulse_datetime string, pulse_duration string"
    good = monitor.pulse_columns(spark.createDataFrame([(2, "2024-01-05 10:00", "30"), (3, None, None), (4, "", "0")], shape)).orderBy("row").collect()
    assert [(r.pulse_time is not None, r.pulse_duration_min) for r in good] == [(True, 30.0), (False, 0.0), (False, 0.0)]
    for cells, said in ((("soon", "30"), "cannot be read"), (("2024-01-05", "long"), "not a number"), (("2024-01-05", None), "no duration"), ((None, "5"), "no pulse")):
        with pytest.raises(monitor.MetadataError, match=f"{said}.*: 1 row.s., 7"):
            monitor.pulse_columns(spark.createDataFrame([(2, None, None), (7, *cells)], shape))
    with pytest.raises(monitor.MetadataError, match="no_pulse_datetime"):
        monitor.pulse_columns(spark.createDataFrame([(2, "5")], "row int, pulse_duration string"))
    plain = spark.createDataFrame([(2,)], "row int")
    assert monitor.pulse_columns(plain) is plain
