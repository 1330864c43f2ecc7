"""python -m diurna run | validate | init | schema; with spark-submit, the same arguments after this file.

Exit codes: 0 done, 1 the configuration or its tables have faults (all of them are printed), 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

TEMPLATE = """\
name: experiment
inputs:
  readings: readings.parquet   # id, t (minutes from each subject's start), activity
  subjects: subjects.parquet   # id, and what groups are made of
  step_minutes: 1
groups:
  by: [genotype]
curation: {}
split: {}
analyses:
  sleep: {}
  period: {}
outputs: []                    # all tables
"""


def _columns(path: str, spark=None) -> list[str]:
    """Names from a Parquet footer, without a Spark job; other stores and formats need a session."""
    local = path.removeprefix("file://")
    if spark is None and "://" not in local and os.path.exists(local):
        import pyarrow.dataset

        return pyarrow.dataset.dataset(local).schema.names
    from pyspark.sql import SparkSession

    return (spark or SparkSession.builder.getOrCreate()).read.parquet(path).columns


def _checked(path: str):
    """The configuration and its faults."""
    from diurna.plans import experiment, schema

    config = experiment.load(path)
    found = schema.faults(config, schema.schema())
    if found:
        return config, found
    body = {k: v for k, v in config.items() if k != "inputs"}
    try:
        experiment.check(body)
    except (ValueError, TypeError) as error:
        found.append(str(error))
    if "inputs" in config:
        base = os.path.dirname(os.path.abspath(path))
        for k in ("readings", "subjects"):
            place = config["inputs"][k]
            config["inputs"][k] = place if "://" in place else os.path.join(base, place)
        try:
            found += schema.check_columns(config, *[_columns(config["inputs"][k]) for k in ("readings", "subjects")])
        except Exception as error:
            found.append(f"inputs: {type(error).__name__}: {str(error).splitlines()[0]}")
    return config, found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="diurna", description="Experiments on activity series, from a configuration.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "check a configuration and make its tables"), ("validate", "check a configuration against its tables"), ("init", "write a configuration to start from"), ("schema", "print the JSON schema of configurations")):
        command = commands.add_parser(name, help=text)
        if name != "schema":
            command.add_argument("config")
        if name == "run":
            command.add_argument("--out", required=True, help="folder for the tables; a second run replaces them")
    try:
        asked = parser.parse_args(argv)
    except SystemExit as end:
        return int(end.code or 0)
    if asked.command == "schema":
        from diurna.plans import schema

        print(json.dumps(schema.schema(), indent=2))
        return 0
    if asked.command == "init":
        if os.path.exists(asked.config):
            print(f"{asked.config} is there already", file=sys.stderr)
            return 1
        with open(asked.config, "w") as f:
            f.write(TEMPLATE)
        return 0
    if not os.path.exists(asked.config):
        print(f"no file {asked.config}", file=sys.stderr)
        return 2
    try:
        config, found = _checked(asked.config)
    except Exception as error:
        config, found = {}, [f"{type(error).__name__}: {error}"]
    if asked.command == "run" and not found and "inputs" not in config:
        found = ["inputs: nothing is stated to run on"]
    if found:
        print("\n".join(found), file=sys.stderr)
        return 1
    if asked.command == "validate":
        print(f"{config.get('name', 'experiment')}: no faults")
        return 0
    from pyspark.sql import SparkSession

    from diurna.operators import state
    from diurna.plans import experiment, schema

    spark = SparkSession.builder.appName("diurna").getOrCreate()
    readings, subjects = (spark.read.parquet(config["inputs"][k]) for k in ("readings", "subjects"))
    plan = experiment.check({k: v for k, v in config.items() if k != "inputs"}, subjects.columns)
    made = experiment.run(readings, subjects, plan, config["inputs"].get("step_minutes", 1), asked.out)
    schema.save_provenance(spark, plan, asked.out, fingerprint=state.fingerprint(readings, experiment.members(subjects, plan), *plan.settings))
    print("\n".join(f"{asked.out}/{plan.name}/{name}" for name in made))
    return 0


if __name__ == "__main__":
    sys.exit(main())
