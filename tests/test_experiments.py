"""Phase state, carry-over, fits that fail, configurations and the command line; scalograms and phase responses by known answers."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna import __main__ as cli
from diurna import params
from diurna.functions import numeric as N
from diurna.operators import groups, hmm, period, phase, phase_response, phase_shift, scalograms, state, stats
from diurna.plans import carry, experiment, schema
from diurna.sources import events, monitor
from tests.conftest import SF

# Phase state


def test_a_cut_table_refuses_another_phase(spark, tmp_path):
    readings, who = events.readings(spark, SF, 60), events.subjects(spark, SF)
    ld = phase.select_phase(readings, who, "LD", ["activity"])
    ld.join(who.select("id", "grp"), "id").select("grp", "id", "t", "activity").where("t < 100000").write.parquet(str(tmp_path / "ld"))
    for table in (ld, spark.read.parquet(str(tmp_path / "ld"))):
        assert state.phase_of(table) == "LD" and state.split_applied(table)
        assert phase.select_phase(table, who, "LD", ["activity"]) is table
        for other in ("DD", "both"):
            with pytest.raises(phase.PhaseError, match="cut to LD"):
                phase.select_phase(table, who, other, ["activity"])
        with pytest.raises(phase.PhaseError, match="cut to LD"):
            phase.split_phase(table, who, "DD")
    assert state.phase_of(readings) == "full" and not state.split_applied(readings)
    assert state.phase_of(phase.split_phase(readings, who, "DD")) == "DD"
    mixed = ld.withColumnRenamed("activity", "a").join(phase.select_phase(readings, who, "DD", ["activity"]), ["id", "t"])
    with pytest.raises(phase.PhaseError, match="several phases"):
        state.phase_of(mixed)


def test_fingerprints_tell_what_differs(spark):
    readings, who = events.readings(spark, SF, 60), events.subjects(spark, SF)
    base = state.fingerprint(readings, who, params.Sleep())
    assert base == state.fingerprint(readings.orderBy("t"), who.repartition(3), params.Sleep())
    others = [
        state.fingerprint(readings, groups.regroup(who, ["nation"]), params.Sleep()),
        state.fingerprint(readings, who.where("id > 3"), params.Sleep()),
        state.fingerprint(readings.where("t < 1440"), who, params.Sleep()),
        state.fingerprint(phase.select_phase(readings, who, "LD", ["activity"]), who, params.Sleep()),
        state.fingerprint(readings, who, params.Sleep(bridge_minutes=5)),
    ]
    assert len({base, *others}) == 6
    made = state.made_with(readings, params.Sleep(), params.Curation())
    assert state.differing(made, params.Sleep(), params.Split()) == [] and state.differing(made, params.Sleep(bridge_minutes=5)) == ["Sleep"]


def test_phases_of_analyses():
    assert [phase.resolve_phase("auto", a) for a in ("hmm", "sleep", "ultradian", "actogram")] == ["LD", "LD", "DD", "both"]
    assert phase.resolve_phase("dd", "hmm") == "DD"
    for given, analysis in (("both", "ultradian"), ("DD", "deprivation"), ("LD", "nonsense")):
        with pytest.raises(phase.PhaseError):
            phase.resolve_phase(given, analysis)


def test_a_pulse_goes_from_sheet_to_minute(spark):
    rows = [(1, "2024-01-05 14:00", "30", "2024-01-01 09:00", "2024-01-05 09:00"), (2, None, None, "2024-01-01 09:00", "2024-01-05 09:00")]
    sheet = spark.createDataFrame(rows, "row int, pulse_datetime string, pulse_duration string, start_ts string, first_dd_ts string")
    sheet = sheet.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "first_dd_ts")})
    found = {r.row: (r.split_minute, r.pulse_minute, r.pulse_duration_min) for r in monitor.split_minutes(monitor.pulse_columns(sheet)).collect()}
    assert found == {1: (5760, 4 * 1440 + 300.0, 30.0), 2: (5760, None, 0.0)}
    by_text = sheet.select("row", "start_ts", "first_dd_ts", F.when(F.col("row") == 1, "ZT15").otherwise("2024-01-02 09:30").alias("pulse_time"))
    assert [r.pulse_minute for r in monitor.split_minutes(by_text).orderBy("row").collect()] == [4320 + 900.0, 1470.0]


# Carry-over


PLAN = {"name": "e", "groups": {"by": ["grp"]}, "curation": {"immobility_proportion": 0.001}, "split": {}, "analyses": {"period": {"step_minutes": 60, "methods": ["ac"]}, "sleep": {"threshold_seconds": 1800}}}


def test_what_a_change_of_groups_keeps(spark, monkeypatch):
    readings, subjects = events.readings(spark, SF, 60), events.subjects(spark, SF)
    few = subjects.where("id < 12")
    plan = experiment.check(PLAN)
    made = experiment.run(readings, few, plan, 60)
    other = experiment.check({**PLAN, "groups": {"by": ["nation"]}})

    def result(who, new):
        return carry.carry_over(made, made["subjects"], experiment.members(who, new), plan, new)

    regrouped = result(few, other)
    assert {"period", "bouts", "bout_summary"} == set(regrouped.kept) and {"profile", "rhythm", "states"} <= set(regrouped.again)
    larger = result(subjects.where("id < 14"), plan)
    assert "period" in larger.again and not set(larger.kept) and any("never analysed" in n for n in larger.notes)
    smaller = result(few.where("id > 2"), plan)
    assert "period" in smaller.kept and smaller.kept["period"].where("id <= 2").count() == 0 and "profile" in smaller.again
    stricter = result(few, experiment.check({**PLAN, "curation": {"immobility_proportion": 0.5}}))
    assert not {"period", "bouts"} & set(stricter.kept)
    same = result(few, plan)
    assert set(same.kept) == set(made) - {"subjects"} and not same.again
    fitted = carry.carry_over({"hmm_models": made["subjects"], "hmm_minutes": made["subjects"]}, made["subjects"], experiment.members(few, other), experiment.check({**PLAN, "analyses": {"sleep": {}, "hmm": {}}}), experiment.check({**PLAN, "groups": {"by": ["nation"]}, "analyses": {"sleep": {}, "hmm": {}}}))
    assert fitted.gone == ["hmm_models", "hmm_minutes"]
    monkeypatch.setattr(period, "run", lambda *a, **k: pytest.fail("the period is made again"))
    tables, told = carry.regroup(readings, few, made, plan, other, 60)
    assert tables["rhythm"].where("grp <> 'ALL'").count() > made["rhythm"].where("grp <> 'ALL'").count() and tables["period"] is made["period"]


# Fits that throw


def test_a_fit_that_fails_for_all_raises(spark):
    readings = events.readings(spark, SF, 60).where("id < 6")
    settings = params.Period(step_minutes=60, methods=("mesa", "ac"), mesa_bin_minutes=60)
    found, seen = period.watched(period.run(readings, settings), settings.methods)
    found.write.format("noop").mode("overwrite").save()
    assert period.judge(seen)["mesa"][0] > 0

    def outcome(statuses):
        rows = [(k, "mesa", s) for k, s in enumerate(statuses)] + [(9, "ac", "ok")]
        table, seen = period.watched(spark.createDataFrame(rows, "id int, method string, status string"), ("mesa", "ac"))
        table.collect()
        return period.judge(seen)

    assert outcome(["numerical: TypeError: no", "ok", "too_short"]) == {"mesa": (1, 1), "ac": (1, 0)}
    assert outcome(["too_short", "below_floor"]) == {"mesa": (0, 0), "ac": (1, 0)}
    with pytest.raises(period.FitError, match="every subject.*2.*TypeError: deprecated"):
        outcome(["numerical: TypeError: deprecated", "numerical: TypeError: deprecated", "too_short"])


def test_a_fit_that_throws_leaves_a_status(spark):
    rows = [(i, t * 60, math.inf if i == 1 and t == 5 else float(t % 24 < 12)) for i in (1, 2) for t in range(240)]
    bad = period.estimate(spark.createDataFrame(rows, "id int, t int, activity double").withColumn("activity", F.when((F.col("id") == 1) & (F.col("t") == 600), F.lit(1e308) * 10).otherwise(F.col("activity"))), "ac", params.Period(step_minutes=60))
    assert {r.id: r.status for r in bad.collect()}[2] == "ok"


# Configurations and the command line


def test_a_run_read_back_runs_again(spark, tmp_path):
    readings, who = events.readings(spark, SF, 60).where("id < 10"), events.subjects(spark, SF)
    plan = experiment.check({**PLAN, "outputs": ["rhythm", "bout_summary"]})
    first = experiment.run(readings, who, plan, 60, str(tmp_path))
    schema.save_provenance(spark, plan, str(tmp_path))
    config = schema.from_results(spark, str(tmp_path / "e"))
    again = experiment.check(config)
    assert again == experiment.check(schema.resolved(again)) and schema.faults(config, schema.schema()) == []
    second = experiment.run(readings, who, again, 60)
    for name in ("rhythm", "bout_summary"):
        assert sorted(map(str, first[name].collect())) == sorted(map(str, second[name].collect()))
    saved = spark.read.parquet(str(tmp_path / "e" / "rhythm" / "table"))
    assert carry.stale(saved, again) == [] and carry.stale(saved, experiment.check({**PLAN, "split": {"gap_threshold_minutes": 30}})) == ["Split"]
    only = schema.from_results(spark, str(tmp_path / "e" / "rhythm"))
    assert only["analyses"]["sleep"]["threshold_seconds"] == 1800 and experiment.check(only).period.methods == ["ac"]
    assert schema.detected({"x": period.run(readings, params.Period(methods=("ac",))), "y": first["bout_summary"]}) == ["period"]


def test_faults_have_places():
    rule = schema.schema()
    assert schema.faults(PLAN, rule) == []
    bad = {"analyses": {"period": {"phase": "both", "min_period": "long"}, "sleeep": {}}, "outputs": [1], "nonsense": 1, "inputs": {"readings": "a", "step_minutes": 0}}
    found = schema.faults(bad, rule)
    for said in ("analyses.period.phase: both is not one of auto, LD, DD", "analyses.period.min_period: \"long\" is not number", "analyses: unknown key sleeep", "outputs[0]: 1 is not string", "configuration: unknown key nonsense", "inputs: subjects is missing", "inputs.step_minutes: 0 is below 1"):
        assert any(said in f for f in found), said
    assert schema.check_columns({"groups": {"by": ["x"]}, "split": {}}, ["id", "t"], ["id"]) == ["inputs.readings: no column activity", "groups: no column x in inputs.subjects", "split: inputs.subjects has no column split_minute"]


def test_command_line(spark, tmp_path, capsys):
    events.readings(spark, SF, 60).where("id < 10").write.parquet(str(tmp_path / "readings.parquet"))
    events.subjects(spark, SF).write.parquet(str(tmp_path / "subjects.parquet"))
    config = tmp_path / "c.yaml"
    assert cli.main(["init", str(config)]) == 0 and cli.main(["init", str(config)]) == 1
    assert cli.main(["validate", str(config)]) == 1 and "no column genotype" in capsys.readouterr().err
    config.write_text(config.read_text().replace("genotype", "grp").replace("step_minutes: 1", "step_minutes: 60").replace("curation: {}", "curation: {immobility_proportion: 0.001}").replace("period: {}", "period: {step_minutes: 60, methods: [ac]}").replace("outputs: []", "outputs: [rhythm]"))
    assert cli.main(["validate", str(config)]) == 0 and "no faults" in capsys.readouterr().out
    assert cli.main(["run", str(config), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "experiment" / "rhythm" / "table")).count() > 0
    assert schema.from_results(spark, str(tmp_path / "out" / "experiment"))["name"] == "experiment"
    assert cli.main(["schema"]) == 0 and json.loads(capsys.readouterr().out.split("\n", 1)[1])["title"] == "diurna experiment"
    config.write_text("analyses: {hmm: {}}\n")
    assert cli.main(["validate", str(config)]) == 1 and "need sleep" in capsys.readouterr().err
    assert cli.main(["run", str(tmp_path / "none.yaml"), "--out", "x"]) == 2 and cli.main(["fly"]) == 2 and cli.main(["run", str(config)]) == 2


# Hidden states


def test_a_group_that_ends_early_and_tasks_without_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", t, float(rng.poisson(3) if (t // 40 + k) % 2 else 0)) for k in range(4) for t in range(240)]
    seen = spark.createDataFrame(rows, "id string, t int, x double")
    who = spark.createDataFrame([(f"s{k}", "flat" if k == 3 else "g") for k in range(4)], "id string, grp string")
    seen = seen.withColumn("x", F.when(F.col("id") == "s3", 0.0).otherwise(F.col("x")))
    settings = params.Hmm(n_states=2, n_restarts=2, n_iter=12)
    found = []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({r.grp: round(r.ll, 6) for r in hmm.train(seen, who, settings).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and set(found[0]) == {"g", "flat"}
    alone = hmm.fitted(seen, who, params.Hmm(n_states=2, n_restarts=1, n_iter=3, scope="subject"))[2]
    assert {r.grp for r in alone.collect()} == {"s0", "s1", "s2", "s3"}


# Exact tests of tables


def enumerated(table):
    """p by every table of the same margins (two columns)."""
    rows, first = table.sum(axis=1), table[:, 0].sum()
    weight = lambda c: math.prod(math.comb(int(n), int(k)) for n, k in zip(rows, c))
    every = [c for c in itertools.product(*[range(n + 1) for n in rows]) if sum(c) == first]
    seen, total = weight(table[:, 0]), sum(map(weight, every))
    return sum(w for c in every if (w := weight(c)) <= seen * (1 + 1e-9)) / total


def test_monte_carlo_tables(spark):
    for table in ([[3, 1], [1, 4], [5, 2]], [[0, 6], [4, 1], [3, 3], [1, 1]], [[2, 2], [2, 2], [2, 2]]):
        table = np.array(table)
        p = stats.freeman_halton(spark, table, 20000)
        wanted = enumerated(table)
        assert abs(p - wanted) < 4 * math.sqrt(max(wanted * (1 - wanted), 1e-4) / 20000) + 1e-4
    drawn = stats.tables_of_margins(np.array([[3, 1, 2], [1, 4, 0]]), 500, np.random.default_rng(0))
    assert (drawn.sum(axis=1) == [4, 5, 2]).all() and (drawn.sum(axis=2) == [6, 5]).all() and (drawn >= 0).all()
    assert stats.freeman_halton(spark, [[3, 0], [4, 0]]) == 1.0


def test_shares(spark):
    def tested(*shares):
        rows = [(f"g{g}", k < with_) for g, (with_, n) in enumerate(shares) for k in range(n)]
        return stats.compare_shares(spark.createDataFrame(rows, "grp string, rhythmic boolean")).collect()

    assert [r[2] for r in tested((10, 30), (20, 30), (15, 30))][0] == "chi-square"
    few = tested((9, 10), (1, 10), (5, 10), (1, 9), (1, 2))
    assert few[0][2] == "Fisher-Freeman-Halton (Monte Carlo)" and {r[2] for r in few[1:]} == {"Fisher-Holm", "letters"} and not any("g4" in r[3] for r in few)
    assert [r[2] for r in tested((3, 10), (4, 10), (5, 10), (4, 11))] == ["Fisher-Freeman-Halton (Monte Carlo)"]
    assert tested((0, 5), (0, 6), (0, 9)) == [] and tested((2, 5)) == []


# Phase responses


def cohort(spark, arms, n_days=11, step=10):
    """Activity of subjects with one bump a day: ``arms`` are (group, subjects, light days, shift in hours or None, periods)."""
    t = np.arange(0, n_days * 1440, step, dtype=float)
    rows, who = [], []
    for grp, n, light, shift, taus in arms:
        for k in range(n):
            tau, x = taus[k % len(taus)], np.zeros(len(t))
            for d in range(n_days + 2):
                middle = d * 1440 + 660 if d < light else light * 1440 + 660 + (d - light) * tau * 60 + (shift or 0) * 60
                x += 20 * np.exp(-0.5 * ((t - middle) / 120) ** 2)
            rows.append(pd.DataFrame({"id": f"{grp}{k}", "t": t.astype(np.int32), "activity": x}))
            who.append((f"{grp}{k}", grp, light * 1440, None if shift is None else float((light - 1) * 1440 + 900)))
    subjects = spark.createDataFrame(who, "id string, grp string, split_minute int, pulse_minute double")
    readings = spark.createDataFrame(pd.concat(rows))
    controls = subjects.select("grp").distinct().withColumn("control_grp", F.lit("ctrl"))
    return phase_shift.markers(readings, subjects, step=step).persist(), subjects, controls


@pytest.mark.parametrize("arms,wanted,within", [
    ([("ctrl", 4, 3, None, [23.5]), ("lp", 4, 2, 1.5, [23.5])], -1.5, 0.2),
    ([("ctrl", 5, 3, None, [23.3, 23.7, 24.0, 24.4, 24.9]), ("lp", 5, 3, 2.0, [24.9, 24.4, 24.0, 23.7, 23.3])], -2.0, 0.3),
    ([("ctrl", 3, 3, None, [24.2]), ("lp", 3, 3, -5.0, [24.2])], 5.0, 0.25),
])
def test_planted_shifts_are_found(spark, arms, wanted, within):
    """Cohorts released on different days, and periods that differ between subjects."""
    found, who, controls = cohort(spark, arms)
    for baseline in phase_response.BASELINES:
        rows = phase_response.regression_responses(found, who, controls, baseline=baseline).collect()
        assert [round(r.response_hours, 2) for r in rows if r.grp == "lp" and abs(r.response_hours - wanted) >= within] == [] and sum(r.grp == "lp" for r in rows) == arms[1][1]
        assert abs(np.mean([r.response_hours for r in rows if r.grp == "ctrl"])) < 1e-6 and all(23.2 < r.period_hours < 25 for r in rows)
    assert phase_response.dropped(phase_response.regression_responses(found, who, controls), who).agg(F.sum("n_dropped")).first()[0] == 0
    with pytest.raises(ValueError, match="baseline"):
        phase_response.regression_responses(found, who, controls, baseline="day")


def test_lines_keep_to_one_phase(spark):
    """A boundary inside the days before the pulse: entrained days are left out, the day it falls in as well."""
    who = spark.createDataFrame([(1, "a", 3 * 1440 + 300, 8 * 1440.0)], "id int, grp string, split_minute int, pulse_minute double")
    found = spark.createDataFrame([(1, d, d * 1440.0 + (600 if d < 4 else 600 + 60 * (d - 3))) for d in range(14)], "id int, day int, minute double")
    sides = {r.day: r.side for r in phase_shift.one_phase(found, who).collect()}
    assert sides == {**{d: "pre" for d in range(4, 8)}, **{d: "post" for d in range(9, 14)}}
    r = phase_shift.shifts(found, who).first()
    assert r.status == "ok" and abs(r.pre_period - 25) < 1e-9 and abs(r.phase_shift_hours) < 1e-9
    arm = phase_response.regression_phases(found, who, slope="arm").first()
    assert arm.status == "ok" and abs(arm.period_hours - 25) < 1e-9


def test_bootstrap_of_differences(spark):
    found, who, controls = cohort(spark, [("ctrl", 6, 3, None, [23.6, 24.0, 24.4]), ("lp", 6, 3, 2.0, [24.0, 24.3, 23.7])])
    origins = phase_response.origin_days(who)
    exact = {r.day: r for r in phase_response.phase_differences(found, who, controls.where("grp = 'lp'"), baseline_day=-2, origins=origins).collect()}
    drawn = {r.day: r for r in phase_response.bootstrap_differences(found, who, controls.where("grp = 'lp'"), resamples=60, baseline_day=-2, origins=origins).collect()}
    assert abs(exact[1].phase_difference_hours - 2) < 0.6 and drawn[1].n_ok > 50
    for d in exact:
        assert drawn[d].phase_difference_low - 0.5 <= exact[d].phase_difference_hours <= drawn[d].phase_difference_high + 0.5
    mixed = who.withColumn("split_minute", F.when(F.col("id") == "lp0", 1440).otherwise(F.col("split_minute")))
    with pytest.raises(ValueError, match="lp"):
        phase_response.origin_days(mixed)


# Scalograms


def test_scalograms_of_groups_and_subjects(spark, tmp_path):
    rng = np.random.default_rng(2)
    length = {"a": 400, "b": 300, "c": 350, "d": 5}
    rows = [(i, t * 60, float(1 + np.cos(2 * np.pi * t / 24) + 0.1 * rng.normal())) for i, n in length.items() for t in range(n)] + [("e", t * 60, 1.0) for t in range(100)]
    readings = spark.createDataFrame(rows, "id string, t int, activity double")
    who = spark.createDataFrame([("a", "g 1"), ("b", "g 1"), ("c", "h"), ("d", "h"), ("e", "h")], "id string, grp string")
    settings = params.Period(step_minutes=60, voices=8)
    found = scalograms.group_scalograms(readings, who, settings).collect()
    periods = N.wavelet_periods(16, 36, 8, 1.0)
    series = {i: np.array([x for j, _, x in rows if j == i]) for i in "abc"}
    power = {i: N.morlet_power(x - x.mean(), periods) for i, x in series.items()}
    for r in found:
        k = int(np.argmin(np.abs(periods - r.period)))
        wanted = (power["a"][k, :300] + power["b"][k, :300]) / 2 if r.grp == "g 1" else power["c"][k]
        assert r.n == (2 if r.grp == "g 1" else 1) and np.allclose(r.power, wanted)
    assert len(found) == 2 * len(periods)
    table = scalograms.group_scalograms(readings, who, settings)
    manifest = {r.grp: r for r in scalograms.save_csv(table, str(tmp_path / "s"), "DD").collect()}
    assert manifest["g 1"].path.endswith("averaged_scalogram_g_1_DD")
    lines = [r.value for r in spark.read.text(manifest["g 1"].path).collect()]
    assert lines[0].startswith("period_h,0.0,1.0") and len(lines) == 1 + len(periods) and len(lines[1].split(",")) == 301
    mine = scalograms.subject_scalograms(readings, ["b"], settings)
    best = mine.orderBy(F.desc("mean")).first()
    assert abs(best.period - 24) < 2 and np.allclose(mine.where(F.abs(F.col("period") - 16) < 0.01).first().power, power["b"][0])
    ridge = scalograms.ridges(mine).where("at = 150").first()
    assert abs(ridge.period - periods[power["b"][:, 150].argmax()]) < 1e-9
    with pytest.raises(ValueError, match="'e'"):
        scalograms.subject_scalograms(readings, ["b", "e"], settings)
    density = scalograms.ridge_density(readings, who, settings, least=1.0).where("grp = 'h'").collect()
    assert sum(r.n for r in density) <= 350 and max(density, key=lambda r: r.n).period == min(periods, key=lambda p: abs(p - 24))
