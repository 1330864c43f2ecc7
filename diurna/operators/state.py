"""Facts about a table that travel with it: as metadata of its columns, through selects, joins and Parquet files."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "diurna"
WHOLE = "full"


class PhaseError(ValueError):
    pass


def facts(df: DataFrame) -> dict[str, dict]:
    """What is known of each column that carries facts."""
    return {f.name: dict(f.metadata[KEY]) for f in df.schema if KEY in f.metadata}


def stamp(df: DataFrame, columns: list[str], **known) -> DataFrame:
    """``df`` with more facts on ``columns``; what they carried stays, newer facts win."""
    for c in columns:
        old = df.schema[c].metadata
        df = df.withMetadata(c, {**old, KEY: {**old.get(KEY, {}), **known}})
    return df


def phase_of(df: DataFrame, columns: list[str] | None = None) -> str:
    """"LD" or "DD" where the columns were cut to it, else "full"; columns of several phases raise."""
    found = {known.get("phase", WHOLE) for c, known in facts(df).items() if columns is None or c in columns} - {WHOLE}
    if len(found) > 1:
        raise PhaseError(f"columns of several phases: {', '.join(sorted(found))}")
    return found.pop() if found else WHOLE


def split_applied(df: DataFrame) -> bool:
    """Whether any column has been cut to a phase, or is marked as divided without a cut."""
    return any(known.get("phase", WHOLE) != WHOLE or known.get("split_applied") for known in facts(df).values())


def can_give(df: DataFrame, phase: str, columns: list[str]) -> bool:
    """Whether ``df`` is of ``phase`` already; a table that was cut to another phase cannot give it and raises."""
    now = phase_of(df, columns)
    if now == WHOLE or now == phase:
        return now == phase
    raise PhaseError(f"the table was cut to {now}: it has nothing of {phase} left. Select from the whole record")


def settings_digest(*settings) -> str:
    """The same for the same settings, in any order of steps and keys."""
    steps = sorted((type(s).__name__, json.dumps(dataclasses.asdict(s), sort_keys=True)) for s in settings)
    return hashlib.sha256(json.dumps(steps).encode()).hexdigest()


def made_with(df: DataFrame, *settings) -> DataFrame:
    """``df`` whose first column tells the digest of the settings of each step that made it."""
    return stamp(df, df.columns[:1], settings={type(s).__name__: settings_digest(s) for s in settings})


def differing(df: DataFrame, *settings) -> list[str]:
    """The steps that made ``df`` with other settings than these; steps that it tells nothing of are not named."""
    told: dict[str, str] = {}
    for known in facts(df).values():
        told |= known.get("settings", {})
    return sorted(n for s in settings if (n := type(s).__name__) in told and told[n] != settings_digest(s))


def fingerprint(readings: DataFrame, subjects: DataFrame, *settings) -> str:
    """One digest of whom, when, in which groups, phase and settings: two tables that differ in any of these differ in it.

    Values of readings do not count, their extent does. Two aggregates, which hash rows where they lie.
    """
    who = subjects.select("id", *[c for c in ("grp", "split_minute") if c in subjects.columns])
    ids = who.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*who.columns).cast("decimal(38,0)")).cast("string")).first()
    span = readings.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    told = [list(map(str, ids)), list(map(str, span)), sorted((c, json.dumps(k, sort_keys=True)) for c, k in facts(readings).items()), settings_digest(*settings), sorted(subjects.columns)]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()
