"""A configuration's schema, its form with every default written out, and the configuration that made a folder of results."""

from __future__ import annotations

import dataclasses
import json
import typing

from pyspark.sql import DataFrame, SparkSession

from ..operators import phase
from ..params import Curation, Settings, Split
from ..sources import sinks
from . import experiment

#: Columns that tables of an experiment have to have.
READINGS, SUBJECTS = {"id", "t", "activity"}, {"id"}
STEPS: dict[str, type[Settings]] = {"curation": Curation, "split": Split, **experiment.ANALYSES}


def _kind(hint) -> dict:
    if typing.get_origin(hint) in (list, tuple):
        return {"type": "array", "items": _kind(typing.get_args(hint)[0])}
    if type(None) in typing.get_args(hint):
        inner = _kind(next(a for a in typing.get_args(hint) if a is not type(None)))
        return {**inner, "type": [inner["type"], "null"]}
    return {"type": {int: "integer", float: "number", str: "string", bool: "boolean"}.get(hint, "object")}


def step_schema(kind: type[Settings], name: str) -> dict:
    """The JSON schema of one step's settings, from its fields."""
    hints = typing.get_type_hints(kind)
    fields = {f.name: {**_kind(hints[f.name]), "default": json.loads(json.dumps(f.default))} for f in dataclasses.fields(kind)}
    if name in phase.POLICY and "phase" in fields:
        fields["phase"]["enum"] = ["auto", *phase.POLICY[name][1]]
    return {"type": "object", "additionalProperties": False, "properties": fields}


def schema() -> dict:
    """The JSON schema of a whole configuration."""
    texts = {"type": "array", "items": {"type": "string"}}
    sections = {
        "name": {"type": "string"},
        "extends": {"anyOf": [{"type": "string"}, texts]},
        "inputs": {"type": "object", "additionalProperties": False, "properties": {"readings": {"type": "string"}, "subjects": {"type": "string"}, "step_minutes": {"type": "integer", "minimum": 1}}, "required": ["readings", "subjects"]},
        "groups": {"type": "object", "additionalProperties": False, "properties": {"by": texts, "keep": {"type": ["object", "array"]}}},
        "curation": step_schema(Curation, "curation"),
        "split": step_schema(Split, "split"),
        "analyses": {"type": "object", "additionalProperties": False, "properties": {k: step_schema(v, k) for k, v in experiment.ANALYSES.items()}},
        "outputs": texts,
    }
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "diurna experiment", "type": "object", "additionalProperties": False, "properties": sections}


def faults(value, rule: dict, where: str = "") -> list[str]:
    """What in ``value`` breaks ``rule``, each with its place: types, unknown and missing keys, values that are not allowed."""
    if "anyOf" in rule:
        found = [faults(value, r, where) for r in rule["anyOf"]]
        return [] if any(not f for f in found) else found[0]
    kinds = rule.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_a = {"object": isinstance(value, dict), "array": isinstance(value, (list, tuple)), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "integer": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, (int, float)) and not isinstance(value, bool)}
    place = where or "configuration"
    if kinds and not any(is_a[k] for k in kinds):
        return [f"{place}: {json.dumps(value, default=str)} is not {' or '.join(kinds)}"]
    out = [f"{place}: {value} is not one of {', '.join(rule['enum'])}"] if "enum" in rule and value not in rule["enum"] else []
    if "minimum" in rule and is_a["number"] and value < rule["minimum"]:
        out.append(f"{place}: {value} is below {rule['minimum']}")
    if isinstance(value, dict) and "properties" in rule:
        out += [f"{place}: {k} is missing" for k in rule.get("required", []) if k not in value]
        for k, v in value.items():
            if k not in rule["properties"]:
                out.append(f"{place}: unknown key {k}; known are {', '.join(sorted(rule['properties']))}")
            elif v is not None or k in ("curation", "split"):
                out += faults({} if v is None else v, rule["properties"][k], f"{where}.{k}".lstrip("."))
    if isinstance(value, (list, tuple)) and "items" in rule:
        for n, v in enumerate(value):
            out += faults(v, rule["items"], f"{where}[{n}]")
    return out


def check_columns(config: dict, readings: list[str], subjects: list[str]) -> list[str]:
    """What the tables of a configuration lack; names only, so that nothing has to be read."""
    out = [f"inputs.readings: no column {c}" for c in sorted(READINGS - set(readings))] + [f"inputs.subjects: no column {c}" for c in sorted(SUBJECTS - set(subjects))]
    groups, analyses = config.get("groups") or {}, config.get("analyses") or {}
    asked = list(groups.get("by") or [])
    keep = groups.get("keep") or {}
    asked += list(keep) if isinstance(keep, dict) else [c for row in keep for c in row]
    out += [f"groups: no column {c} in inputs.subjects" for c in dict.fromkeys(asked) if c not in subjects]
    if not groups.get("by") and "grp" not in subjects:
        out.append("groups.by: no groups are stated, and inputs.subjects has no column grp")
    cut = [k for k, v in analyses.items() if (v or {}).get("phase", "auto") in ("LD", "DD")]
    if ("split" in config or cut) and "split_minute" not in subjects:
        out.append(f"{', '.join(['split'] * ('split' in config) + cut)}: inputs.subjects has no column split_minute")
    return out


def resolved(plan: experiment.Plan) -> dict:
    """The configuration of ``plan`` with every default written out; checked again it is the same plan."""
    steps = {k: json.loads(json.dumps(dataclasses.asdict(getattr(plan, k)))) for k in STEPS if getattr(plan, k) is not None}
    config: dict = {"name": plan.name, "groups": {"by": list(plan.group_by)}, "outputs": list(plan.outputs)}
    if plan.keep:
        config["groups"]["keep"] = plan.keep
    config |= {k: steps[k] for k in ("curation", "split") if k in steps}
    config["analyses"] = {k: steps[k] for k in experiment.ANALYSES if k in steps}
    return config


def save_provenance(spark: SparkSession, plan: experiment.Plan, folder: str, **more: str) -> None:
    """The resolved configuration beside the tables it made, and what else is told (versions, a fingerprint)."""
    rows = [("config", json.dumps(resolved(plan), sort_keys=True)), ("spark", spark.version), *more.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/{plan.name}/provenance")


def from_results(spark: SparkSession, folder: str) -> dict:
    """The configuration that made the tables in ``folder`` (one experiment's): from its provenance, or, without one, the steps
    of the settings that lie beside a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/provenance")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{folder}/provenance").collect()}
        return json.loads(rows["config"])
    return config_of_settings(sinks.load(spark, folder)[1])


def config_of_settings(rows: list[tuple[str, str, str]]) -> dict:
    """A configuration from settings rows (step, key, value), as they travel with a table."""
    told = {step for step, _, _ in rows}
    steps = {k: json.loads(json.dumps(dataclasses.asdict(kind.from_rows(rows)))) for k, kind in STEPS.items() if kind.__name__ in told}
    config: dict = {k: steps[k] for k in ("curation", "split") if k in steps}
    return {**config, "analyses": {k: steps[k] for k in experiment.ANALYSES if k in steps}}


def detected(tables: dict[str, DataFrame]) -> list[str]:
    """The analyses whose results are among ``tables``, by the columns they have: names may be anything."""
    signs = {"period": {"method", "period", "strength", "rhythmic_power"}, "sleep": {"bout", "start_t", "end_t", "duration_min"}, "hmm": {"state", "hmm_sleep", "confidence"}, "phase_shift": {"phase_shift_hours"}, "phase_response": {"response_hours", "control_grp"}}
    return sorted({k for t in tables.values() for k, sign in signs.items() if sign <= set(t.columns)})
