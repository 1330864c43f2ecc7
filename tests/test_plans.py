"""Configurations, files and streams."""

import pytest
from pyspark.sql import functions as F

from diurna import params
from diurna.plans import experiment
from diurna.sources import events, sinks
from diurna.streaming import windows
from tests.conftest import SF


def test_configurations_extend_and_are_checked(tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\ncuration: {min_alive_days: 1}\nanalyses: {sleep: {}}\ngroups: {keep: {grp: [A]}}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nname: own\ngroups: {by: [grp], keep: {grp: [B]}}\n")
    plan = experiment.check(experiment.load(str(tmp_path / "own.yaml")), ["grp"])
    assert plan.name == "own" and plan.curation.min_alive_days == 1 and plan.sleep == params.Sleep() and plan.keep == {"grp": ["B"]}
    (tmp_path / "base.yaml").write_text("extends: own.yaml\n")
    with pytest.raises(experiment.ConfigError, match="extend each other"):
        experiment.load(str(tmp_path / "own.yaml"))
    for bad in ({"nonsense": 1}, {"analyses": {"sleep": {}}}, {"groups": {"by": ["x"]}}, {"curation": {}, "analyses": {"hmm": {}}}):
        with pytest.raises(experiment.ConfigError):
            experiment.check(bad, ["grp"])


def test_a_plan_runs_and_its_settings_come_back(spark, tmp_path):
    readings, subjects = events.readings(spark, SF, 60), events.subjects(spark, SF)
    plan = experiment.check({"name": "e", "curation": {"immobility_proportion": 0.001}, "split": {}, "analyses": {"period": {"step_minutes": 60, "methods": ["ls"]}, "sleep": {"threshold_seconds": 1800}}, "outputs": ["rhythm", "bout_summary", "split"]})
    made = experiment.run(readings, subjects, plan, 60, str(tmp_path))
    assert set(made) == {"rhythm", "bout_summary", "split"}
    table, rows = sinks.load(spark, str(tmp_path / "e" / "rhythm"))
    assert table.count() == made["rhythm"].count() > 0 and params.Period.from_rows(rows).methods == ["ls"]


def test_board_files(spark, tmp_path):
    rows = [("1", t, None if t < 5 or t == 100 else float(t % 3)) for t in range(3 * 1440)] + [("2", t, 1.0) for t in range(600)]
    df = spark.createDataFrame(rows, "id string, t int, activity double")
    who = spark.createDataFrame([("1", "7"), ("2", "7")], "id string, monitor string")
    sinks.save_boards(sinks.board_lines(df, who), str(tmp_path / "out"))
    files = [r for r in sinks.read_board(spark, str(tmp_path / "out" / "board=7" / "id=1")).collect()]
    assert len(files) == 1 and files[0].header == "M7C1" and files[0].length == 2880 == len(files[0].counts) and files[0].counts[:3] == [2, 0, 1]
    assert sinks.half_hours(df).where("id = '1' AND block IN (0, 3)").select("value").distinct().collect()[0][0] == -1


def test_streams_equal_batches(spark, tmp_path):
    source = events.table(spark, SF, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").orderBy("ts")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for k, (f, batch_rows) in enumerate(((windows.binned, windows.binned(source)), (windows.active_spells, windows.active_spells(source)))):
        q = f(stream).writeStream.format("memory").queryName(f"s{k}").outputMode("complete" if k == 0 else "append").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
        wanted = set(map(tuple, batch_rows.select("id", "start", "n").collect()))
        found = set(map(tuple, spark.table(f"s{k}").select("id", "start", "n").collect()))
        assert found <= wanted and len(found) >= (len(wanted) if k == 0 else 0.9 * len(wanted))
