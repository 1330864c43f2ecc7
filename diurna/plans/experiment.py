"""An experiment from a configuration: which steps run, with which settings, into which tables.

A configuration is a mapping (or a YAML file, which may extend others). It is checked as a whole before
anything runs, and the settings are written beside every table.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import bins, curate, groups, hmm, period, phase, sleep, state, states
from ..params import Curation, Hmm, Period, Settings, Sleep, Split
from ..sources import sinks

SECTIONS = ("name", "groups", "curation", "split", "analyses", "outputs")
ANALYSES = {"period": Period, "sleep": Sleep, "hmm": Hmm}


class ConfigError(ValueError):
    pass


def merged(base: dict, over: dict) -> dict:
    """Deep merge; the later value wins, and lists and ``keep`` are replaced whole."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if k != "keep" and isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, chain: tuple[str, ...] = ()) -> dict:
    """A YAML configuration with what it extends, nearest last."""
    import yaml

    path = os.path.abspath(path)
    if path in chain:
        raise ConfigError(f"configurations extend each other: {' -> '.join([*chain, path])}")
    with open(path) as f:
        own = yaml.safe_load(f) or {}
    parents = own.pop("extends", [])
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merged(out, load(os.path.join(os.path.dirname(path), parent), (*chain, path)))
    return merged(out, own)


@dataclass(frozen=True)
class Plan:
    name: str = "experiment"
    group_by: list[str] = field(default_factory=list)
    keep: object = None
    curation: Curation | None = None
    split: Split | None = None
    period: Period | None = None
    sleep: Sleep | None = None
    hmm: Hmm | None = None
    outputs: list[str] = field(default_factory=list)

    @property
    def settings(self) -> list[Settings]:
        return [s for s in (self.curation, self.split, self.period, self.sleep, self.hmm) if s is not None]


def check(config: dict, columns: list[str] | None = None) -> Plan:
    """The plan of a configuration; unknown keys, missing columns and steps that lack their input raise."""
    if unknown := sorted(set(config) - set(SECTIONS)):
        raise ConfigError(f"unknown sections: {unknown}")
    analyses = config.get("analyses") or {}
    if unknown := sorted(set(analyses) - set(ANALYSES)):
        raise ConfigError(f"unknown analyses: {unknown}")
    by = list((config.get("groups") or {}).get("by") or [])
    if columns is not None and (lost := [c for c in by if c not in columns]):
        raise ConfigError(f"no such columns: {lost}")
    of = lambda kind, values: None if values is None else kind.of(dict(values))
    parts = {k: of(kind, analyses.get(k)) for k, kind in ANALYSES.items()}
    curation = of(Curation, config.get("curation"))
    if parts["hmm"] and not parts["sleep"]:
        raise ConfigError("hidden states need sleep")
    if parts["sleep"] and curation is None:
        raise ConfigError("sleep needs curation")
    for name, settings in parts.items():
        if settings:
            phase.resolve_phase(settings.phase, name)
    return Plan(config.get("name", "experiment"), by, (config.get("groups") or {}).get("keep"), curation, of(Split, config.get("split")), **parts, outputs=list(config.get("outputs") or []))


def members(subjects: DataFrame, plan: Plan) -> DataFrame:
    """The subjects of a plan, in its groups."""
    who = groups.subset(subjects, plan.keep) if plan.keep else subjects
    return groups.regroup(who, plan.group_by) if plan.group_by else who


def run(readings: DataFrame, subjects: DataFrame, plan: Plan, step: int = 1, folder: str | None = None, *, only: set[str] | None = None, given: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a plan by name; written below ``folder`` where there is one, with the settings that made them.

    ``only`` names the tables that are wanted; ``given`` are tables that were made before and are used as they are. A
    period method whose fit throws for every subject raises once its table is written, or when ``period.judge`` is called.
    """
    who, given = members(subjects, plan), given or {}
    rows = curate.with_moving(readings.join(who.select("id"), "id", "left_semi"))
    out: dict[str, DataFrame] = {"subjects": who}
    if plan.curation:
        marked = curate.alive(rows, plan.curation, step)
        out["curation"] = curate.curation_counts(marked)
        rows = marked.where("is_alive = 1").drop("is_alive")
    out["profile"] = bins.zt_profile(bins.zt_bins(rows, "activity", max(30, step)), who, max(30, step))
    split = "split_minute" in who.columns

    def view(name: str, given: str, values: list[str]) -> DataFrame:
        chosen = phase.resolve_phase(given, name, split)
        return phase.select_phase(rows, who, chosen, values, bool(plan.split and plan.split.discard_first_dd_day)) if split else rows

    if plan.split:
        out["split"] = phase.split_report(rows, who)
    watched = None
    if plan.period:
        if "period" in given:
            calls = given["period"]
        else:
            results, watched = period.watched(period.run(view("period", plan.period.phase, ["activity"]), plan.period), plan.period.methods)
            calls = period.classify(results)
        out |= {"period": calls, "rhythm": period.rhythm_summary(calls, who)}
    if plan.sleep:
        marked = sleep.marked_minutes(view("sleep", plan.sleep.phase, ["activity", "moving"]), plan.sleep, step)
        bouts, minutes = sleep.bouts(marked), sleep.minutes(marked)
        out |= {"bouts": bouts, "bout_summary": sleep.bout_summary(bouts), "states": states.group_profiles(states.profiles(minutes, max(30, step)), who)}
    if plan.hmm:
        seen = hmm.observations(view("hmm", plan.hmm.phase, ["activity"]), "binary" if plan.hmm.emission == "categorical" else "counts")
        fitted, parts, models = hmm.fitted(seen, who, plan.hmm)
        out |= {"hmm_models": models, "hmm_minutes": hmm.decode(fitted, parts, models, plan.hmm)}
    wanted = {k: state.made_with(v, *plan.settings) for k, v in out.items() if (not plan.outputs or k in plan.outputs) and (only is None or k in only)}
    if folder:
        for name, table in wanted.items():
            sinks.save(table, f"{folder}/{plan.name}/{name}", *plan.settings)
            if name == "period" and watched is not None:
                period.judge(watched)
    return wanted
